"""Queues of urls: the stream against the batch, and both against a plain queue."""

import random
import uuid

import pytest

from webkb.streaming import urlqueue

EVENTS = "queue string, seq long, ts double, event string, url string, priority int, depth int, parent string"


def log(seed, n=160, queues=("a", "b", None)):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        event = r.choices(["put", "get", "complete", "fail", "requeue"], [5, 4, 1, 2, 1])[0]
        url = r.choice([None, *[f"u{j}" for j in range(12)]]) if event != "get" else None
        rows.append((r.choice(queues), i, float(i), event, url, r.choice([None, 0, 10, 50, 80]), r.choice([None, 0, 3, 11]), r.choice([None, "p"])))
    return rows


def plain(rows, retries=3, delay=0.0):
    """One list for each queue, sorted anew at every get."""
    queues, out = {}, []
    for q, seq, ts, event, url, priority, depth, parent in rows:
        s = queues.setdefault(q or "", {"wait": [], "seen": set(), "done": set(), "failed": {}})
        depth = depth or 0
        priority = priority if priority is not None else 100 if event == "requeue" else 50
        tries = s["failed"].get(url, 0)
        if event == "put":
            ok = depth <= 10 and url not in s["seen"]
            if ok:
                s["seen"].add(url)
                s["wait"].append((priority, ts, seq, url, depth, parent, 0, ts))
            res = (url, ok, priority, depth, parent, 0 if ok else tries)
        elif event == "get":
            ready = sorted((x for x in s["wait"] if x[7] <= ts and x[3] not in s["done"]), key=lambda x: (x[0], max(x[7], x[1]), x[2]))
            if ready:
                s["wait"].remove(ready[0])
                p, _, _, u, d, f, t, _ = ready[0]
                res = (u, True, p, d, f, t)
            else:
                res = (None, False, None, None, None, None)
        elif event == "complete":
            s["seen"].add(url)
            s["done"].add(url)
            res = (url, True, None, None, None, tries)
        elif event == "fail":
            s["seen"].add(url)
            s["failed"][url] = tries = tries + 1
            if tries <= retries:
                s["wait"].append((100, ts, seq, url, 0, None, tries, ts + delay))
            res = (url, True, 100, 0, None, tries) if tries <= retries else (url, False, None, None, None, tries)
        else:
            s["seen"].add(url)
            s["wait"].append((priority, ts, seq, url, 0, None, 0, ts))
            res = (url, True, priority, 0, None, 0)
        out.append((q or "", seq, event, *res))
    return sorted(out)


@pytest.mark.parametrize("seed,retries", [(1, 3), (2, 0), (3, 1)])
def test_batch(spark, seed, retries):
    rows = log(seed)
    got = urlqueue.replay_queue(spark.createDataFrame(rows, EVENTS).repartition(3), retries=retries)
    assert sorted(map(tuple, got.collect())) == plain(rows, retries)
    assert got.columns == [c.split()[0] for c in urlqueue.OUT.split(", ")]
    assert urlqueue.replay_queue(spark.createDataFrame([], EVENTS)).count() == 0


def test_delay(spark):
    """A failed url can't be taken before its delay has passed."""
    rows = [("a", 1, 1.0, "put", "x", 0, 0, "p"), ("a", 2, 2.0, "get", None, None, None, None), ("a", 3, 3.0, "fail", "x", None, None, None)]
    rows += [("a", i, float(i), "get", None, None, None, None) for i in (4, 7, 8, 9)]
    got = sorted(map(tuple, urlqueue.replay_queue(spark.createDataFrame(rows, EVENTS), delay=5.0).collect()))
    assert [(r[1], r[3], r[5], r[6], r[7], r[8]) for r in got if r[2] == "get"] == [(2, "x", 0, 0, "p", 0), (4, None, None, None, None, None), (7, None, None, None, None, None), (8, "x", 100, 0, None, 1), (9, None, None, None, None, None)]


@pytest.mark.parametrize("delay", [0.0, 7.0])
def test_stream_equals_batch(spark, tmp_path, delay):
    """Three triggers, the query stopped and started again after the second."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, source, name = log(4, 90), tmp_path / "in", f"queue_{uuid.uuid4().hex}"
    want = sorted(map(tuple, urlqueue.replay_queue(spark.createDataFrame(rows, EVENTS), delay=delay).collect()))
    try:
        for k in range(0, 90, 30):
            spark.createDataFrame(rows[k : k + 30], EVENTS).coalesce(1).write.mode("append").json(str(source))
            if k:
                out = urlqueue.replay_queue_stream(spark.readStream.schema(EVENTS).json(str(source)), delay=delay)
                run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / name))
                assert run.awaitTermination(120) and run.exception() is None
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
