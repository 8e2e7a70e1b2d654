"""The labelled urls share no host, and no word of a bad host, with the tables on which the url filter is measured."""

import re

import pandas as pd
import pytest
from test_operators import SF

from brindle.llm import url_filter

HOSTS = [url.split("://", 1)[1].split("/")[0] for folder in ("sf0.001", "sf0.01", "sf0.1") for url in pd.read_parquet(f"/root/testdata/{folder}/pages.parquet", columns=["url"])["url"].dropna() if "://" in url]
# Words that every url may have.
COMMON = {"www", "com", "net", "org", "example", "m", "blog"}


def words(host):
    return {w for w in re.split("[^a-z]+", host.lower()) if w} - COMMON


def test_labelled_hosts_are_not_test_hosts():
    made = {url.split("://", 1)[1].split("/")[0] for url, _ in url_filter.labelled()}
    assert made.isdisjoint(HOSTS)


def test_bad_names_share_no_word():
    seen = set().union(*map(words, HOSTS))
    for name in url_filter.BAD:
        assert not words(name) & seen, name
        assert not [(a, b) for a in words(name) for b in seen if len(b) >= 4 and b in a or len(a) >= 4 and a in b], name


def test_known_words_are_blocked(spark):
    rows = [(k, f"https://shop.{name}.example.info/about/{k}") for k, name in enumerate(url_filter.BAD)] + [(1000 + k, f"https://{name}.example.info/about") for k, name in enumerate(url_filter.GOOD)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.train(url_filter.labelled_urls(spark)), rules=()).collect()}
    assert sum(got[k] == "block" for k in range(len(url_filter.BAD))) >= 0.8 * len(url_filter.BAD)
    assert all(got[1000 + k] == "allow" for k in range(len(url_filter.GOOD)))


def test_sql_and_cases(spark):
    """The SQL gives the same rows; of rules of one length the first wins; long, repeated and odd urls."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = c.sql(url_filter.oracle_sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in url_filter.query(spark, SF).collect())
    model = url_filter.train(url_filter.labelled_urls(spark))
    rows = spark.createDataFrame([("http://a.com/x" + "y" * 200_000, "old")] * 2 + [("http://a.com/xz", None)], "url string, verdict string")
    got = url_filter.judge(rows, model, (("allow", "a.com/xy"), ("block", "a.com/xy"), ("block", "a.com/xz"), ("allow", "a.com/xz"))).collect()
    assert [r.verdict for r in got] == ["allow", "allow", "block"] and got[0].score == got[1].score
