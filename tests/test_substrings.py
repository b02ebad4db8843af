"""Substring search by trigrams against LIKE on every text."""

import random

from pyspark.sql import functions as F

from webkb.operators import substrings


def test_search(spark, tmp_path):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeE ") for _ in range(r.randint(0, 90))) for _ in range(300)] + [None, "", "ab", "100% a_b c\\d", "Übung ÜBER"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = ["%abc%", "%ABC%", "abc%", "%e ", "%ab_de%", "%abcd%eab%", "%a%", "_", "", "%", "%über%", "%100\\% a\\_b%", "%nowhere%", "%c\\\\d%"]
    patterns = spark.createDataFrame(list(enumerate(asked)), "query_id int, pattern string")
    substrings.build(rows, "doc_id", "text", str(tmp_path / "p"), 8)
    postings = substrings.read(spark, str(tmp_path / "p"))
    got = sorted(map(tuple, substrings.search(postings, rows, patterns, "doc_id", "text", 8).collect()))
    want = rows.crossJoin(patterns).where(F.expr("lower(text) LIKE lower(pattern)")).select("query_id", "doc_id")
    assert got == sorted(map(tuple, want.collect()))
    assert {q for q, _ in got} >= set(range(12)) - {2, 8} and 12 not in {q for q, _ in got}
    few = patterns.where("query_id IN (0, 5)")
    share = substrings.candidates(postings, few, 8).count() / (2 * len(texts))
    assert share < 0.3
    assert substrings.search(postings, rows, patterns.limit(0), "doc_id", "text", 8).count() == 0
