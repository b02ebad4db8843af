"""The pipeline's stages on small tables."""

import re

import duckdb

import corpus_pipeline
from webkb.llm import queries, simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = corpus_pipeline.materialise(docs)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length").collect()))


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()))


def test_odd_rows(spark, sf):
    """Each stage alone on nulls, repeats, ties, long texts and columns with the operators' own names, against plain Python."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(3000))
    texts = [None, "", " \t ", "a b c d e", "a  b\tc d e", words, words + " tail", "é😀 ü q r", "Tea, at 12 sharp."]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or ""), "k", i, 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[8], (None, "a b c d e", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    docs = corpus_pipeline.materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, size long, score double").coalesce(1))
    stages = dict(corpus_pipeline.STAGES)
    shown = lambda df: sorted(map(str, df.collect()))
    assert all(stages[n](spark, docs, sf).columns == docs.columns for n in ("quality", "exact_dedup", "near_dedup", "mix_sources"))
    kept = stages["quality"](spark, docs, sf).collect()
    assert all(kept.count(r) <= docs.collect().count(r) for r in kept)

    def smallest(groups):
        """The row of each group with the smallest id, nulls last; equal rows are one."""
        return sorted((-1 if (best := min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))["doc_id"] is None else best["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", best["text"] or "")) for g in groups.values())

    brief = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in df.collect())
    by_text, by_component = {}, {}
    for r in docs.collect():
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r)
    assert brief(stages["exact_dedup"](spark, docs, sf)) == smallest(by_text)
    prints = {t: simhash.fingerprint(t) for t in {r["text"] for r in docs.collect()}}
    root = {t: t for t in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b], key=str)
    for r in docs.collect():
        by_component.setdefault(root[r["text"]], []).append(r)
    near = stages["near_dedup"](spark, docs, sf)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in near.collect()) == [k for k, _ in smallest(by_component)]
    mixed = stages["mix_sources"](spark, docs, sf)
    assert shown(mixed) == shown(stages["mix_sources"](spark, docs, sf)) and all(mixed.collect().count(r) <= 3 * docs.collect().count(r) for r in mixed.collect())
    packed = stages["pack"](spark, docs, sf).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
