"""The segment store against a plain dict: random adds and removes, merges, versions and refused changes."""

import random

import pytest

from webkb.operators import vectors as V
from webkb.sources.segments import VectorStore, exists, tier, to_merge

ROW = "vec_id long, vector array<double>"


def rows_of(store):
    live = store.rows()
    return {} if live is None else {r["vec_id"]: list(r["vector"]) for r in live.collect()}


def test_tiers():
    assert [tier(n) for n in (0, 1, 3, 4, 15, 16, 64)] == [0, 0, 0, 1, 1, 2, 3]
    assert to_merge([(1, 2), (2, 3), (3, 40), (4, 1)]) == [] and to_merge([(1, 2), (2, 3), (3, 40), (4, 1), (9, 2)]) == [1, 2, 4, 9]
    assert to_merge([(i, 20) for i in range(4)] + [(9 + i, 1) for i in range(5)]) == [9, 10, 11, 12, 13]


def test_store_equals_rebuilt_index(spark, tmp_path):
    rng, want, path = random.Random(3), {}, f"file://{tmp_path}/store"
    assert not exists(spark, path)
    store = VectorStore.create(spark, path, 3)
    assert exists(spark, path) and store.rows() is None and store.remove(spark.range(3).withColumnRenamed("id", "vec_id")) == 0
    older = {}
    for step in range(9):
        free = [i for i in range(60) if i not in want]
        new = {i: [rng.gauss(0, 1) for _ in range(3)] for i in rng.sample(free, rng.randint(1, 9))}
        assert store.add(spark.createDataFrame(list(new.items()), ROW)) == len(new)
        want |= new
        if step % 3 == 1:
            gone = rng.sample(sorted(want), 4)
            ids = [(i,) for i in [*gone, gone[0], 777, None]]
            assert store.remove(spark.createDataFrame(ids, "vec_id long")) == 4
            for i in gone:
                del want[i]
            older[store.stats()["version"]] = dict(want)
    assert rows_of(store) == want
    stats = store.stats()
    assert stats["vectors"] == len(want) and stats["segments"] < 9 and stats["dimensions"] == 3
    for version, then in older.items():
        assert rows_of(VectorStore(spark, path, version)) == then
    queries = spark.createDataFrame([(1, [1.0, 0.2, 0.0]), (2, [0.0, -1.0, 1.0])], "query_id long, vector array<double>")
    rebuilt = V.top_k(queries, spark.createDataFrame(list(want.items()), ROW), 5)
    assert sorted(map(tuple, store.search(queries, 5).collect())) == sorted(map(tuple, rebuilt.collect()))
    assert store.merge(everything=True) and not store.merge(everything=True) and rows_of(store) == want
    assert store.stats()["deletions"] == 0 and store.stats()["stored"] == len(want)
    assert {r["vec_id"] for r in store.get(spark.createDataFrame([(i,) for i in [*sorted(want)[:2], 999]], "vec_id long")).collect()} == set(sorted(want)[:2])
    store.clear()
    assert rows_of(store) == {} and store.stats()["vectors"] == 0
    assert store.add(spark.createDataFrame([(5, [1.0, 2.0, 3.0])], ROW)) == 1 and rows_of(store) == {5: [1.0, 2.0, 3.0]}


@pytest.mark.parametrize("bad", [[(1, [1.0, 2.0])], [(9, [1.0])], [(9, None)], [(None, [1.0, 2.0])], [(9, [1.0, 2.0]), (9, [1.0, 3.0])]])
def test_refused_changes_leave_the_store(spark, tmp_path, bad):
    store = VectorStore.create(spark, f"file://{tmp_path}/s", 2, "euclidean")
    store.add(spark.createDataFrame([(1, [0.0, 1.0])], ROW))
    before = store.stats()
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame(bad, ROW))
    assert store.stats() == before and rows_of(store) == {1: [0.0, 1.0]}
    assert store.add(spark.createDataFrame([], ROW)) == 0 and store.stats() == before
    with pytest.raises(ValueError):
        VectorStore(spark, store.path, 0).add(spark.createDataFrame([(2, [0.0, 1.0])], ROW))
    with pytest.raises(Exception):  # a second writer of the same version
        store._commit(before["version"], [(1, "empty", 0, "")], 2, "euclidean")


def test_two_writers(spark, tmp_path):
    """The writer that comes second fails, and what the first has written stays."""
    path = f"file://{tmp_path}/s"
    first, second = VectorStore.create(spark, path, 1), VectorStore(spark, path)
    state = second._manifest()
    first.add(spark.createDataFrame([(1, [1.0])], ROW))
    second._manifest = lambda: state
    with pytest.raises(Exception):
        second.add(spark.createDataFrame([(2, [2.0])], ROW))
    assert rows_of(first) == {1: [1.0]} and rows_of(VectorStore(spark, path)) == {1: [1.0]}
