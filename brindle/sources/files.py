"""Folders as sources and sinks: scans by suffix, paging, fingerprints, ranked folder match, and numbered names."""

from __future__ import annotations

import os
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import base_name, context_names, natural_key, path_parts

MOST_FOLDERS = 100_000

# The suffixes of images.
SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, suffixes=SUFFIXES) -> DataFrame:
    """path, length and modificationTime of the images of a folder; those of all folders below if it has none itself."""

    def read(deep: bool) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(folder)
        return files.select("path", "length", "modificationTime").filter(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$"))

    found = read(recursive)
    if not recursive and found.isEmpty():
        found = read(True)
    if found.isEmpty():
        raise ValueError(f"no images in {folder}")
    return found


def numbered(files: DataFrame) -> DataFrame:
    """``pos`` from 0 in natural order of the path. A folder's listing is small; this is one window."""
    return files.withColumn("pos", F.row_number().over(Window.orderBy(natural_key(F.col("path")), "path")) - 1)


def page(files: DataFrame, index: int, step: int, mode: str = "increment") -> DataFrame:
    """``step`` files from ``index`` on (backward for ``decrement``), round the end; ``turn`` gives their order."""
    ordered = numbered(files)
    n = ordered.count()
    sign = -1 if mode == "decrement" else 1
    turns = files.sparkSession.range(step).select(F.col("id").alias("turn"), F.pmod(F.lit(index) + sign * F.col("id"), F.lit(max(n, 1))).cast("int").alias("pos"))
    return turns.join(ordered, "pos").orderBy("turn")


def fingerprint(files: DataFrame, parameters: str) -> DataFrame:
    """One digest of the parameters and of each path, size and time."""
    line = F.concat_ws("|", "path", "length", F.col("modificationTime").cast("string"))
    return files.agg(F.sha2(F.concat_ws("\n", F.lit(parameters), F.array_sort(F.collect_list(F.sha2(line, 256)))), 256).alias("digest"))


def _composed() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and those letters."""
    parts = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") for c in map(chr, range(0xC0, 0x3100))}
    pairs = [(c, p) for c, p in parts.items() if len(p) == 1 and p != c]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


_COMPOSED = _composed()


def _normal(text: Column) -> Column:
    """Lower case without marks, ``_`` and ``-`` as spaces, single spaces."""
    plain = F.regexp_replace(F.translate(F.lower(text), *_COMPOSED), r"\p{Mn}", "")
    return F.btrim(F.regexp_replace(plain, r"[_\-\s]+", " "))


def _run_length(a: Column, b: Column) -> Column:
    """Longest run of equal neighbours of two arrays."""
    lengths = F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda j: F.aggregate(F.sequence(F.lit(0), F.least(F.size(a) - i, F.size(b) - j) - 1), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, k: F.struct((s["n"] + F.when(s["on"] & (F.get(a, i + k) == F.get(b, j + k)), 1).otherwise(0)).alias("n"), (s["on"] & (F.get(a, i + k) == F.get(b, j + k))).alias("on")), lambda s: s["n"]))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.coalesce(F.array_max(lengths), F.lit(0))).otherwise(0)


def _ordered_overlap(a: Column, b: Column) -> Column:
    """How many of ``a``, from the first on, occur in ``b`` in order, up to the first that does not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        rest = F.slice(b, s["at"] + 1, F.greatest(F.size(b) - s["at"], F.lit(0)))
        spot = F.array_position(rest, x).cast("int")
        return F.when((s["at"] < 0) | (spot == 0), F.struct(s["n"].alias("n"), F.lit(-1).alias("at"))).otherwise(F.struct((s["n"] + 1).alias("n"), (s["at"] + spot).alias("at")))

    return F.aggregate(a, start, step, lambda s: s["n"])


def match_folders(folders: DataFrame, wanted: DataFrame, mode: str = "contains") -> DataFrame:
    """For each wanted (text, context) the best folder path: 100 x longest common run + ordered overlap + 10 or 5 for the tail.

    Every wanted text is compared with every folder name, so ``folders`` is a listing of ``MOST_FOLDERS`` rows at most."""
    if folders.limit(MOST_FOLDERS + 1).count() > MOST_FOLDERS:
        raise ValueError(f"the listing has more than {MOST_FOLDERS} folders")
    f = folders.withColumn("name", _normal(base_name(F.col("path")))).withColumn("fp", F.transform(path_parts(F.col("path")), _normal))
    w = wanted.withColumn("m", _normal(F.col("text"))).withColumn("cp", F.transform(path_parts(F.col("context")), _normal))
    exact = F.col("name") == F.col("m")
    fits = exact if mode == "exact" else exact | F.contains(F.col("name"), F.col("m"))
    tail, above = F.get("cp", F.size("cp") - 1), F.get("cp", F.size("cp") - 2)
    last = F.get("fp", F.size("fp") - 1)
    bonus = F.when((F.size("cp") >= 2) & (last == above), 10).when(last == tail, 5).otherwise(0)
    scored = w.join(F.broadcast(f), fits).withColumn("score", F.when(F.size("cp") > 0, _run_length(F.col("fp"), F.col("cp")) * 100 + _ordered_overlap(F.col("fp"), F.col("cp")) + bonus).otherwise(0))
    best = Window.partitionBy("text", "context").orderBy(F.desc("score"), natural_key(F.col("path")), "path")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").select("text", "context", "path", "score")


def free_names(spark: SparkSession, taken: list[str], count: int, prefix: str, suffix: str = "png", number_suffix: bool = True) -> list[str]:
    """Names for ``count`` new files: the smallest numbers from 1 that are free, with four digits if ``number_suffix``;
    otherwise the bare name first, if nothing is there."""
    ending = r"\.(?:png|jpe?g|webp|avif)$"
    own = re.compile(rf"^{re.escape(prefix)}(\d+){ending}", re.I)
    old = re.compile(rf"^(?:{re.escape(prefix)})?(\d+){ending}", re.I)
    bare = any(re.match(rf"^{re.escape(prefix)}{ending}", t, re.I) for t in taken)
    used = {int(m[1]) for t in taken if (m := own.match(t) or (old.match(t) if number_suffix else None))}
    names, n = [], 0
    while len(names) < count:
        if not number_suffix and not bare and not used:
            names.append(f"{prefix}.{suffix}")
            bare = True
            continue
        n += 1
        if n not in used:
            used.add(n)
            names.append(f"{prefix}{n:04d}.{suffix}" if number_suffix else f"{prefix}{n}.{suffix}")
    return names


def child_folder(base: str, name: str) -> str:
    """A folder below ``base``; a name that leads out of it is an error."""
    root = os.path.realpath(base)
    path = os.path.realpath(os.path.join(root, name.strip()))
    if path != root and not path.startswith(root + os.sep):
        raise ValueError(f"{name!r} lies outside the folder")
    return path


def contexts(text: Column) -> Column:
    return context_names(text)
