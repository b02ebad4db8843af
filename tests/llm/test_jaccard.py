"""The Jaccard join against all pairs of sets."""

import random

import duckdb
import numpy as np
import pytest

from tests.llm.test_operators import empty_docs, odd_docs
from webkb.llm import jaccard, queries


def word_sets(rows, shingle=4):
    found = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        n = min(shingle, len(words))
        found.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    return found


def brute(rows, threshold=85):
    sets = word_sets(rows)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= threshold * max(len(a), len(b)) and 100 * len(a & b) >= threshold * len(a | b):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    return sorted(((k, len(sets[i]), min((x for x in groups[top(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)), key=str)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def families(seed, count=14):
    """Chains and stars of edited texts of many sizes, with shared passages and unrelated texts."""
    r, rows = random.Random(seed), []
    word = lambda: f"w{r.randint(0, 4000)}"
    passage = [word() for _ in range(30)]
    for n in [3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 27, 40, 60, 90, 150, 300]:
        base = [word() for _ in range(n)]
        for k in range(count):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3, max(1, n // 40)])):
                at, what = r.randrange(len(words)), r.randint(0, 2)
                words[at : at + (what > 0)] = [word()] * (what < 2)
                words = words or [word()]
            base = words if r.random() < 0.3 else base
            rows.append(" ".join(words))
    rows += [" ".join(passage + [word() for _ in range(r.choice([3, 6, 9]))]) for _ in range(60)]
    rows += rows[:20] + ["", None, " \t", "Aa Bb", "aA bB", "ÄB c", "äb c"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_slabs_agree():
    """Any two sets that link share a bucket."""
    r, bands = np.random.default_rng(2), jaccard.Bands()
    for _ in range(3000):
        n = int(r.integers(1, 12)) if r.random() < 0.5 else int(r.integers(12, 400))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = int(r.integers(0, n // 6 + 2)), int(r.integers(0, n // 6 + 2))
        b = np.unique(np.concatenate((r.permutation(a)[gone:], r.integers(0, 1 << 63, new).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 85 * (len(a) + len(b) - same) and same < max(len(a), len(b)):
            assert set(jaccard.slab_keys(a, bands).tolist()) & set(jaccard.slab_keys(b, bands).tolist())


def test_bands_cover():
    bands = jaccard.Bands()
    for n in range(1, 3000):
        for m in {n, n + 1, 100 * n // 85}:
            if 100 * n >= 85 * m:
                assert set(bands.at(n)) & set(bands.at(m))
                tau = 15 * (n + m) // 185
                shared = max(set(bands.at(n)) & set(bands.at(m)))
                slabs, spare = bands.slabs(shared)
                assert not tau or slabs > tau + spare


@pytest.mark.parametrize("n,m", [(5, 5), (40, 3), (200, 130), (1, 100)])
def test_tree_join(n, m):
    r = np.random.default_rng(n)
    center = r.integers(0, 9, (6, jaccard.GROUPS))
    make = lambda k: np.maximum(0, center[r.integers(0, 6, k)] + r.integers(-1, 2, (k, jaccard.GROUPS)) * (r.random((k, jaccard.GROUPS)) < 0.2)).astype(np.int32)
    a, b = (jaccard.BoxTree(make(k), r.integers(0, 5, k)) for k in (n, m))
    for x, y in ((a, b), (a, a)):
        want = {
            (i, j) for i in range(len(x.points)) for j in range(i + 1 if x is y else 0, len(y.points))
            if x.labels[i] != y.labels[j] and 185 * np.minimum(x.points[i], y.points[j]).sum() >= 85 * (x.sizes[i] + y.sizes[j])
        }
        u, v = jaccard.tree_join(x, y)
        got = {(min(p), max(p)) if x is y else p for p in zip(u.tolist(), v.tolist())}
        assert got == want and len(u) == len(want)


@pytest.mark.parametrize("seed,block", [(1, jaccard.BLOCK), (2, 3)])
def test_families(spark, seed, block):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert plain(jaccard.near_duplicates(docs, block=block)) == want
    assert 20 < len({w[2] for w in want}) < len(rows) - 50


@pytest.mark.parametrize("block", [100, 2])
def test_mixed(spark, block):
    """Members of buckets with several labels, whole buckets of any size; buckets of up to a block take one shuffle."""
    r = random.Random(4)
    rows = [(b, 100 * b + i, n, r.choice([7, 8]) if b % 2 else 7) for b in range(60) for n in [r.choice([2, 3, 5])] for i in range(n)]
    late = spark.createDataFrame(rows, "bucket long, id long, n int, label long")
    found = jaccard._mixed(late, block)
    assert plain(found) == sorted((x for x in rows if len({y[3] for y in rows if y[0] == x[0]}) > 1), key=str) != []
    plan = jaccard._mixed(late.where(f"n <= {block}"), block)._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == late.columns and "Window" in plan


def test_odd(spark):
    docs = odd_docs(spark)
    assert plain(jaccard.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    renamed = docs.withColumnRenamed("doc_id", "bucket").withColumnRenamed("text", "key_")
    assert jaccard.near_duplicates(renamed, "bucket", "key_").columns == ["bucket", "n_shingles", "component_id"]
    assert plain(jaccard.near_duplicates(renamed, "bucket", "key_")) == plain(jaccard.near_duplicates(docs))
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0


def test_query(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.sql(queries.ORACLE_SQL["op12_jaccard"]).fetchall(), key=str)
    found = queries.QUERIES["op12_jaccard"](spark, sf)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert plain(found) == want
