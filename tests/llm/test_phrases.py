"""Phrase mining against plain counts of all phrases."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tests.llm.test_operators import empty_docs, odd_docs
from webkb.llm import phrases, queries


def brute(rows, least=30, longest=4, most=2000):
    """rows: (text, lang). The contract, step by step."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in candidates.items():
        inside = any(100 * f >= 80 * a and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), f in candidates.items() if g == lang)
        if not inside:
            cuts = [(2_000_000 * a // (l + r), k, l, r) for k in range(1, len(w)) for l, r in [(counts[lang, w[:k]], counts[lang, w[k:]])]]
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -score) for lang, found in out.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:most]))


def plain(df):
    return sorted(map(tuple, df.collect()))


def texts(seed, docs=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "é", "Zoo"]
    lines = [[r.choice(vocabulary) for _ in range(r.randint(2, 6))] for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(r.randint(0, 25)):
            words += r.choice(lines) if r.random() < 0.6 else [r.choice(vocabulary)]
            words.append(r.choice(["", "", "", ".", ",", " \n", "!", "\t", " : "]))
        rows.append((i, " ".join(words), r.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed,least,sample,chunk", [(1, 6, 1, phrases.CHUNK), (2, 6, 16, 50), (3, 4, 1_000_000, phrases.CHUNK), (4, 12, 3, 200)])
def test_mine(spark, monkeypatch, seed, least, sample, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SLICE", min(chunk, phrases.SLICE))
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute([x[1:] for x in rows], least)
    assert plain(phrases.mine(docs, least=least, sample=sample)) == want
    assert len(want) > 10
    assert plain(phrases.mine(docs, least=least, sample=sample, most=3)) == [w for w in want if w[1] <= 3]


@pytest.mark.parametrize("held", [1, 300, 1_000_000])
def test_summed_in_tasks(spark, monkeypatch, held):
    """A task sums its own phrases across chunks, with no hash table of rows ahead of the shuffle."""
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "SLICE", 50)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "HELD_WORDS", held)
    rows = texts(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = phrases._count(docs.selectExpr("coalesce(lang, 'und') AS lang", "text"), 4)
    assert re.search(r"Exchange hashpartitioning[^\n]*\n *\+- MapInArrow", counted._jdf.queryExecution().executedPlan().toString())
    assert counted.count() == counted.groupBy("k", "prefix", "last", "lang", "word").count().count() > 300
    assert plain(phrases.mine(docs, least=6)) == brute([x[1:] for x in rows], 6)


def test_full_bits(spark, monkeypatch):
    """A bitmap with every bit set counts everything, with the same result."""
    real = phrases.Bits.of
    monkeypatch.setattr(phrases.Bits, "of", staticmethod(lambda keys: ~(real(keys) * 0)))
    rows = texts(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert plain(phrases.mine(docs, least=8)) == brute([x[1:] for x in rows], 8)


def test_odd(spark):
    docs = odd_docs(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert plain(phrases.mine(docs, least=2, sample=2)) == brute(rows, 2)
    renamed = docs.withColumnRenamed("doc_id", "f").withColumnRenamed("text", "lang_").withColumnRenamed("lang", "key_")
    assert plain(phrases.mine(renamed, "f", "lang_", "key_", least=2)) == brute(rows, 2)
    assert phrases.mine(empty_docs(spark)).count() == 0


def test_query(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = queries.QUERIES["op13_phrases"](spark, sf)
    rows = db.execute(queries.ORACLE_SQL["op13_phrases"])
    names = [d[0] for d in rows.description]
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert plain(found.select(*names)) == sorted(rows.fetchall())
