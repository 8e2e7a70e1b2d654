"""URL verdicts: allow and block rules first, then a logistic regression on hashed character n-grams.

Everything that touches the rows is built-in functions: the url is split by one pattern, the rules are one
CASE ordered by length, and the score adds up the weights of the distinct buckets of the n-grams of host
and path, looked up in one array literal of ``BUCKETS`` whole numbers (millionths, so that sums are exact
in any order). There is no shuffle and no user function.

``train`` hashes a small labelled table (at most ``MAX_LABELLED`` rows, else an error) by the same
expressions and fits the weights on the driver by full-batch gradient descent with L2. The table has four
clean names of known words and made-up ones for each bad one, so a url of which nothing is known is taken as clean.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of
the model on no features; rules compare the host with A-Z lower-cased and the path as it is; of rules of one length
the first given wins; repeated rows get equal results; further columns pass through and columns named like
a result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import let

BUCKETS = 4096  # three hexadecimal digits
SIZES = (3, 4)
MAX_LABELLED = 10_000
ROUNDS, RATE, SHRINK = 400, 2.0, 1e-4
UNIT = 1_000_000

# The rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# The labelled table is made from these parts. They share no word with a host of the test tables.
BAD = (
    "poker-bonus slot-jackpot roulette-royal payday-loan quick-cash pharmacy-rx escort-service xxx-video porn-tube sexy-dates popup-banner "
    "banner-server lottery-prize sportsbook-odds replica-watches replica-bags seo-backlinks link-exchange hot-singles crypto-giveaway "
    "keygen-crack warez-download viagra-store weightloss-miracle malware-update phishing-login fake-antivirus torrent-cracks"
).split()
GOOD = (
    "news library museum weather garden kitchen science history physics biology city-council school university journal gazette recipes "
    "travel-notes openmaps wiki docs archive theatre orchestra cycling hiking astronomy chemistry parish railway harbour village forest river"
).split()


KINDS = ("", "city-", "open", "old-")
MADE_UP = 200


def made_up_names() -> list[str]:
    """Names of two to four syllables of a consonant and a vowel: hosts that no word of a list tells of."""
    draw = random.Random(5)
    return ["".join(draw.choice("bdfgklmnprsvz") + draw.choice("aeiou") for _ in range(draw.randint(2, 4))) for _ in range(MADE_UP)]


def labelled() -> list[tuple[str, int]]:
    """Urls with label 1 (to block) and 0, both with like subdomains, endings and paths."""
    before, ends = ("", "www.", "m.", "blog."), ("com", "net", "org")
    paths = ("/en/120", "/de/7.html", "/fr/844/", "/es/39?page=2&ref=x", "/en/601#top", "/about", "/2019/05/index.html")
    rows = []
    for label, names in ((1, BAD), (0, [kind + name for kind in KINDS for name in GOOD] + made_up_names())):
        for name in names:
            for j in range(3):
                i = int(hashlib.md5(f"{name}{j}".encode()).hexdigest()[:8], 16)  # so that no ending or path goes with a label
                site = f"{name}.example.{ends[i % 3]}" if j else f"{name}.{ends[i % 3]}"
                rows.append((f"https://{before[i // 21 % 4]}{site}{paths[i // 3 % 7]}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, labelled()))} AS t(url, label)")


_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def _grams(text: Column, mark: str) -> Column:
    """Buckets of the n-grams of a text with a border sign at both ends; none if it is empty."""

    def of(chars: Column) -> Column:
        parts = []
        for n in SIZES:
            spots = F.sequence(F.lit(0), F.size(chars) - n)
            gram = lambda i, n=n: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])
            parts.append(F.when(F.size(chars) >= n, F.transform(spots, lambda i: F.conv(F.substring(F.md5(gram(i).cast("binary")), 1, 3), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>")))
        return F.concat(*parts)

    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    return F.when(F.length(text) > 0, let(chars, of)).otherwise(F.array().cast("array<int>"))


def buckets(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))


def fit(rows: list[tuple[list[int], int]]) -> tuple[list[int], int]:
    """Weights of the buckets and the intercept, in millionths."""
    x, y = np.zeros((len(rows), BUCKETS)), np.array([label for _, label in rows], float)
    for k, (found, _) in enumerate(rows):
        x[k, found] = 1
    weights, base = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS if rows else 0):
        gap = y - 1 / (1 + np.exp(-np.clip(x @ weights + base, -30, 30)))
        base += RATE * gap.mean()
        weights += RATE * (gap @ x / len(rows) - SHRINK * weights)
    return np.rint(weights * UNIT).astype(int).tolist(), round(base * UNIT)


def train(table: DataFrame) -> tuple[list[int], int]:
    rows = table.select(buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("x"), F.col("label").cast("int").alias("y")).limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    return fit([(r["x"], r["y"]) for r in rows])


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last one set wins
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: tuple[list[int], int], rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) with host, path, rule, score (of the model) and verdict."""
    weights, base = model
    own = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<bigint>")
    parts = pages.select(*[F.col(f"`{c}`") for c in own], F.struct(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).alias("__u"))
    host, path = F.col("__u.h"), F.col("__u.p")
    total = F.aggregate(buckets(host, path), F.lit(base).cast("long"), lambda s, b: s + F.get(table, b))
    rule, said = rule_of(host, path, rules)
    scored = parts.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"), rule.alias("rule"), (1 / (1 + F.exp(-total / UNIT))).alias("score"), (total >= 0).alias("__bad"), said.alias("__said"))
    verdict = F.coalesce("__said", F.when(F.col("__bad"), "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("__said", "__bad")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark)), keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """The query in SQL; the weights are fitted here, on the same table, by a plain restatement of the hashing."""

    def hashed(url: str) -> list[int]:
        rest = url.split("://", 1)[1]
        host, slash, path = rest.partition("/")
        parts = (("h", f"^{host}$"), ("p", f"^{(slash + path).split('?')[0].split('#')[0]}$"))
        grams = [mark + c[i : i + n] for mark, c in parts for n in SIZES for i in range(len(c) - n + 1)]
        return list({int(hashlib.md5(g.encode()).hexdigest()[:3], 16) for g in grams})

    weights, base = fit([(hashed(url), label) for url, label in labelled()])
    cases = lambda say: " ".join(f"WHEN (host = '{s}' OR host LIKE '%.{s}') AND starts_with(path, '/{r}') THEN '{say(v, s + '/' + r)}'" for v, (s, r) in sorted(((v, t.split("/", 1)) for v, t in RULES), key=lambda x: -len("/".join(x[1]))))
    grams = " UNION ALL ".join(f"SELECT page_id, '{mark}' || substring('^' || {part} || '$', i::INT, {n}) AS g FROM u, range(1, length({part}) + {4 - n}) r(i) WHERE {part} <> ''" for mark, part in (("h", "host"), ("p", "path")) for n in SIZES)
    return f"""WITH x AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM x),
w AS (SELECT unnest(range({BUCKETS})) AS k, unnest({weights}) AS v), g AS ({grams}),
b AS (SELECT DISTINCT page_id, CAST('0x' || substring(md5(g), 1, 3) AS INT) AS k FROM g), s AS (SELECT page_id, sum(v) AS s FROM b JOIN w USING (k) GROUP BY page_id)
SELECT page_id, host, path, CASE {cases(lambda v, t: t)} END AS rule, CASE {cases(lambda v, t: v)} WHEN coalesce(s, 0) + {base} >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM u LEFT JOIN s USING (page_id)"""
