"""A corpus pipeline of five stages over ``documents``; it belongs to the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of
``documents``: toxicity and quality rules drop the rows that they reject, the near-copy stage keeps the row
with the smallest id of each group (sets of five words, similarity 0.8; SimHash by covering masks, MinHash keys for links beyond
its radius, each link checked exactly), suffix dedup cuts repeated passages out of the texts (characters that are cut
in two go as a whole; emptied documents stay as empty texts), and packing returns the pieces and places.
The stages need doc_id and text; n_chars, if there, is counted anew when a text is cut. Operators see doc_id, text and one struct
of all other columns, so no name of a caller's column meets one of theirs, and each column comes out as it went in.

Defined cases: null texts count as empty, so the quality rules reject them; rows without an id are judged like others, and of copies one with an id stays;
repeated rows are copies, of which one stays; ties go to the smaller id; very long texts are read whole, in windows; empty tables give an empty result.

SQL cannot state the trained scores, the components or the packing, so ``ORACLE_SQL`` is None and the
tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import near_copies, packing, quality_rules, suffix_dedup, toxicity
from brindle.session import checkpointed

ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``own``, a struct of the other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("own"))


def _unpacked(packed: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` from a packed frame, in their order; ``text`` names the column that holds the texts."""
    there = {"doc_id": F.col("doc_id"), "text": F.col(text).alias("text")}
    return packed.select(*[there[c] if c in there else F.col("own").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    packed = _packed(docs)
    return _unpacked(toxicity.score(packed, toxicity.train(packed, labels)).filter("predicted = 0"), docs)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(quality_rules.judge(_packed(docs)).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(near_copies.dedup(_packed(docs)), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = _unpacked(suffix_dedup.cut_repeats(_packed(docs), as_text=True), docs, "kept")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, str(public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
