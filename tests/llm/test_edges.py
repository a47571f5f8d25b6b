"""Very long rows, ties and clashing columns of the URL filter and the n-gram join."""

from pyspark.sql import functions as F

from tests.llm.test_links import judge
from weftline.llm import jaccard_join, url_filter


def test_url_filter_long_urls_and_rules_of_one_length(spark):
    rules = [("x.net", "/a/", "allow"), ("net", "/a/bb", "block"), ("org", "/", "allow"), ("org", "/", "block")]
    urls = ["http://x.net/a/bb", "http://net/a/bb", "http://org/", "http://x.net/a/" + "b" * 10**6, "http://" + "w." * 10**5 + "net/a/bb", "http://x.net/" + "a/" * 10**5 + "?" + "q" * 10**6, "http" * 10**5]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit(1), "verdict": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert got[0][2:] == ("x.net/a/", "allow") and got[2][2:] == ("org/", "block")


def test_jaccard_join_long_texts_and_clashing_columns(spark):
    long = [f"w{i}" for i in range(60_000)]
    rows = [(7, " ".join(long)), (3, " ".join(long[:59_000])), (5, " ".join(reversed(long))), (9, "a b c d"), (8, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("id", "n", "keys", "fine", "h1", "h2", "a", "b", "c", "key", "label", "component_id", "n_shingles")})
    got = {tuple(r) for r in jaccard_join.jaccard_components(df, 3, 90).collect()}
    assert got == {(7, 59_998, 3), (3, 58_998, 3), (5, 59_998, 5), (9, 2, 8), (8, 2, 8)}
