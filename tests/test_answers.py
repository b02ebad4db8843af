"""Models, prompts, memory, index files, streams that go on, and parsers of what models write."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webkb.functions import urls as U
from webkb.operators import answers, chunking, crawl, graph, memory, navigation, pages, prompts, questions, search, understanding, vectors
from webkb.operators import relational as R
from webkb.sources import tables
from webkb.streaming import ratelimit as L


def test_prompts(spark):
    assert prompts.fields("refine_answer") == ["question", "answer", "context"] and len(prompts.TEMPLATES) == 21
    row = spark.createDataFrame([("{x} $1", None)], "a string, b string").select(prompts.render("compare_pages", first=F.col("a"), second="S", context=F.col("b"), question="Q?"))
    assert row.first()[0] == "Compare {x} $1 with S.\n\nContext:\n\n\nQuestion: Q?\nComparison:"
    with pytest.raises(ValueError):
        prompts.render("summarize", text="x")


def test_answers(spark):
    echo = lambda prompt, system: f"{len(prompt)}|{prompt.splitlines()[0]}"
    rows = spark.createDataFrame([(1, "Q?", ["c1", "c2", "c3", "c4"])], "query_id int, question string, contexts array<string>")
    assert answers.direct(rows.withColumn("context", F.col("contexts")[0]), echo).first()["answer"].endswith("|Context:")
    assert answers.refine(rows, echo).first()["answer"].endswith("|Question: Q?" if False else "|Existing answer:")
    knows = lambda prompt, system: "no information" if "c2" in prompt and "c1" not in prompt else prompt.count("c")
    assert answers.map_reduce(rows, lambda p, s: str(knows(p, s))).count() == 1
    cited = answers.with_sources(spark.createDataFrame([("Q?", [("A", "x"), ("Bee", "y")])], "question string, sources array<struct<title:string,text:string>>"), lambda p, s: "says Bee [1]").first()
    assert cited["cited"] == [1, 2]
    follow = spark.createDataFrame([("Q?", "User: hi", "ctx", "A", "B")], "question string, history string, context string, first string, second string")
    assert answers.follow_up(follow, echo).first()["answer"].endswith("|Conversation:") and answers.compare(follow, echo).first()["answer"].endswith("|Compare A with B.")


def test_understand(spark):
    def model(prompt, system):
        if prompt.startswith("List the people"):
            return "PERSON: Ann Lee\nperson: ANN LEE\nORG: Acme" if "first" in prompt else "PERSON: Ann Lee"
        if prompt.startswith("List the key facts"):
            return "- A fact that is long enough\n- a FACT that is long enough"
        if prompt.startswith("Name the category"):
            raise RuntimeError("busy")
        return "Short." if prompt.startswith("Sum up") else "a -> b -> c"

    text = "The first sentence is here. " * 60
    rows = spark.createDataFrame([(1, text, "own", "article"), (2, "", "own", "index")], "page_id long, main_text string, summary string, content_type string")
    one, two = understanding.understand(rows, model, relationships=True).orderBy("page_id").collect()
    assert one["summary"] == "Short." and one["category"] == "article" and one["errors"] == ["RuntimeError: busy"]
    assert [(e["type"], e["name"]) for e in one["entities"]] == [("person", "Ann Lee"), ("organization", "Acme")] and one["entities"][0]["mentions"] == 2 * one["chunk_count"]
    assert one["facts"] == ["A fact that is long enough"] and len(one["relationships"]) == min(3, one["chunk_count"])
    assert two["chunk_count"] == 0 and two["entities"] is None


def test_synonyms(spark):
    lookup = questions.synonym_lookup()
    assert lookup["support"] == ["service", "help"] and lookup["cost"] == ["price"]
    assert questions.synonym_lookup(questions.add_synonyms({"a": ["b"]}, "C", ["b", "d"])) == {"a": ["b"], "b": ["a", "c"], "c": ["b", "d"], "d": ["c"]}
    rows = spark.createDataFrame([("buy product",), ("Compare price and cost of 'Big Box' latest",), ("",), (None,)], "query string")
    got = questions.expand(questions.parse(rows), expander=lambda q: [q + "!"] if q else []).collect()
    assert got[0]["search_queries"] == ["buy product", "buy item", "purchase product"] and got[0]["keyword_queries"][:2] == ["buy product", "purchase product"]
    assert got[1]["entities"][0] == "Big Box" and got[1]["search_queries"][-1].startswith("latest compare") and got[1]["reformulations"][-1].endswith("latest!")
    assert got[2]["search_queries"] == [] and got[2]["keyword_queries"] == []


def test_chunks_cover():
    """Whatever the limits, chunks hold every segment in order."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        parts = ["".join(rng.choice(list("abc"), rng.integers(1, 40))) for _ in range(rng.integers(1, 20))]
        least = int(rng.integers(0, 30))
        chunks = chunking.pack_segments(parts, " ".join(parts), int(rng.integers(20, 80)), 0, least)
        joined = " ".join(c[3] for c in chunks)
        assert joined == " ".join(parts) or not chunks and len(" ".join(parts)) < least


def test_memory(spark):
    entries = spark.createDataFrame([("s", 1, "user", "hello there", 1500), ("s", 2, "assistant", "hi", 700), ("t", 1, "user", "x", 5), ("t", 2, "system", "y", 5)], "session string, position int, role string, content string, tokens int")
    summed = memory.summarize_if_needed(entries, lambda t: t.upper())
    assert [tuple(r) for r in summed.collect()] == [("s", "USER: HELLO THERE\nASSISTANT: HI")]
    sessions = spark.createDataFrame([("s", None), ("t", "old")], "session string, summary string")
    assert sorted(tuple(r) for r in memory.set_summary(sessions, summed).collect()) == [("s", "USER: HELLO THERE\nASSISTANT: HI"), ("t", "old")]
    assert memory.messages(entries, ["system"]).count() == 1


def test_index_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, vector array<double>")
    listed, centers = vectors.build_lists(rows, 5)
    tables.save_index(listed, centers, str(tmp_path / "i"))
    loaded, again, meta = tables.load_index(spark, str(tmp_path / "i"))
    assert loaded.count() == 60 and np.allclose(again, centers) and (meta["dimensions"], meta["kind"], meta["clusters"]) == (4, "ivf", 5)
    queries = rows.limit(3).withColumnRenamed("vec_id", "query_id")
    assert sorted(vectors.probe(queries, loaded, np.array(again), probes=5).collect()) == sorted(vectors.top_k(queries, rows).collect())
    tables.compact(spark, str(tmp_path / "i/meta"), str(tmp_path / "m"), 1)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    with pytest.raises(Exception, match="duplicate"):
        vectors.add(rows, rows.limit(1), 4).collect()
    assert vectors.add(rows, rows.limit(1).withColumn("vec_id", F.lit(99).cast("long")), 4).count() == 61
    assert [vectors.wants_lists(n) for n in (500, 1000, 5000)] == [0, 100, 100]
    small = vectors.select_vectors(rows.withColumn("page_id", F.col("vec_id") % 3), [1], F.col("vec_id") > 10, rows.limit(20).select("vec_id"))
    assert {r["vec_id"] for r in small.collect()} == {i for i in range(60) if i % 3 == 1 and i > 10} - {r["vec_id"] for r in rows.limit(20).collect()}


def test_stream_goes_on(spark, tmp_path):
    """Stopped and started again, a page stream hands on only what is new."""
    seen = []
    write = lambda name, ids: spark.createDataFrame([(i, f"http://a/{i}", "<p>x</p>") for i in ids], tables.PAGES).write.mode("append").parquet(str(tmp_path / name))
    write("in", [1, 2])
    for more in ([], [3]):
        if more:
            write("in", more)
        run = tables.on_page(tables.page_stream(spark, str(tmp_path / "in")), lambda df, n: seen.append(sorted(r["page_id"] for r in df.collect())), str(tmp_path / "c"))
        run.awaitTermination(60)
    assert [s for s in seen if s] == [[1, 2], [3]]
    tables.write_pages(spark.createDataFrame([(1, "u", "x" * 60_000)], tables.PAGES), str(tmp_path / "out"))
    assert len(spark.read.parquet(str(tmp_path / "out")).first()["html"]) == 50_000


def test_bm25_joins_where_terms_are_many(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish"), (3, None), (4, "blue whale")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "blue fish"), (2, "whale"), (3, "")], "query_id long, query string")
    assert sorted(search.bm25(asked, docs).collect()) == sorted(search.bm25(asked, docs, most_terms=1).collect())
    assert search.bm25(asked.where("query_id = 3"), docs).count() == 0


def test_retrieve_edges(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish", "p"), (2, "one fish", "p"), (3, None, None)], "doc_id long, text string, page_id string")
    asked = spark.createDataFrame([(1, ["fish", "red"], ["fish"]), (2, [], [])], "query_id long, semantic array<string>, keywords array<string>")
    got = search.retrieve(asked, docs, vectors.hash_embedding).collect()
    assert {r["query_id"] for r in got} == {1} and {r["id"] for r in got} == {1, 2}


def test_replay_hot_domain(spark):
    """One domain with nearly all rows, read in order across batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        log = spark.range(2000).select(F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("domain"), F.col("id").alias("seq"), (F.col("id") * 0.3).alias("ts"), (F.col("id") % 7 != 0).alias("ok"), F.lit(None).cast("double").alias("retry_after"))
        got = {r["seq"]: (r["wait"], r["delay"]) for r in L.replay(log).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for domain in (0, 1):
        state = L.DomainState()
        for i in (i for i in range(2000) if (i % 50 == 0) == (domain == 0)):
            wait = L.step(state, i * 0.3, i % 7 != 0, None, L.Limits())
            assert got[i] == (round(wait, 6), round(state.delay, 6))


def test_parsers(spark):
    texts = ["1. Yes, it is relevant\n2. Found: prices, phone\n3. Continue: yes", "Partially so\nfound: none", "3: 8 - good\n1: 9.5 – best\n7: 10", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(navigation.parsed_assessment(F.col("t"))).collect()]
    assert [(f["relevance"], f["found"]) for f in found[:2]] == [("yes", ["prices", "phone"]), ("partially", [])] and found[3]["relevance"] == "no"
    best = rows.select(navigation.parsed_priorities(F.col("t"), F.lit(3))).collect()[2][0]
    assert [(b["number"], b["score"], b["reason"]) for b in best] == [(1, 0.95, "best"), (3, 0.8, "good")]
    urls = spark.createDataFrame([("http://a/?page=3&x=1",), ("http://a/page/7",), ("http://a/",)], "u string").select(U.pagination_urls(F.col("u"), 2)).collect()
    assert [r[0] for r in urls[:2]] == [["http://a/?page=4&x=1", "http://a/?page=5&x=1"], ["http://a/page/8", "http://a/page/9"]]
    html = spark.createDataFrame([(1, "http://a.org/x", "<head><title>t</title></head><script>no</script><A HREF='/b' rel=next title=T>go <b>on</b></A><a href=http://c.org/>c</a><a name=x>n</a><details>")], "page_id long, url string, html string")
    assert [tuple(r)[2:] for r in pages.raw_links(html).collect()] == [("/b", "next", "T", "go on", True), ("http://c.org/", "", "", "c", False)]
    assert html.select(pages.visible_text(F.col("html"))).first()[0] == "go on c n"
    signs = html.select(*[c.alias(n) for n, c in pages.navigation_patterns(F.col("html")).items()]).first()
    assert signs["pagination"] and signs["accordion"] and not signs["tabs"]


def test_graph_paths(spark):
    edges = spark.createDataFrame([(1, "A", "x", "B", 1.0, 7), (2, "C", "y", "B", 0.5, 7), (3, "C", "z", "D", 1.0, 8)], "id long, subject_name string, predicate string, object_name string, confidence double, source_page_id int")
    found = graph.find_path_to(edges, "a", "D").first()
    assert (found["depth"], found["entities"], found["description"]) == (3, ["a", "b", "c", "d"], "a -[x]-> b <-[y]- c -[z]-> d")
    assert graph.find_path_to(edges, "a", "nowhere").count() == 0 and graph.find_path_to(edges, "A", "a").first()["depth"] == 0
    assert [r["id"] for r in graph.edges_by(edges, page=7).orderBy("id").collect()] == [1, 2] and graph.edges_by(edges, ids=[3]).count() == 1
    nodes = spark.createDataFrame([("a", 5, "person")], "normalized_name string, id long, entity_type string")
    assert {tuple(r) for r in graph.nodes_of(graph.edges_by(edges, predicate="x"), nodes).collect()} == {("a", 5, "person"), ("b", 0, "unknown")}
    ents = spark.createDataFrame([(1, "Apple Inc", "org", "apple inc", 3, 1), (2, "APPLE inc", "fruit", "apple inc", 4, 2), (3, "Pear", "fruit", "pear", 9, 1)], "id long, name string, entity_type string, normalized_name string, mentions int, page_id int")
    assert [(r["name"], r["entity_type"], r["page_ids"], r["mentions"]) for r in R.search_entities(ents, "apple").collect()] == [("Apple Inc", "org", "1,2", 7)]
    assert R.search_entities(ents, "apple", "fruit").first()["mentions"] == 4


def test_navigate_and_progress(spark):
    known = spark.createDataFrame([(1, "http://a/"), (2, "http://a/pricing"), (3, "http://a/x")], "page_id long, norm_url string")
    links = spark.createDataFrame([(1, "http://a/pricing", "Pricing plans"), (1, "http://a/x", "Else"), (2, "http://a/contact", "Contact us")], "source_page_id long, target_url string, anchor_text string")
    got = crawl.navigate(known, links, "http://a/", "find pricing plans", max_pages=3, beam=1).orderBy("round").collect()
    assert [r["norm_url"] for r in got][:2] == ["http://a/", "http://a/pricing"] and len(got) == 3
    row = crawl.progress(spark.createDataFrame([("ok",), ("failed",), ("ok",)], "status string"), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:00").cast("timestamp")).first()
    assert (row["crawled"], row["failed"], row["pages_per_minute"]) == (2, 1, 2.0)


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """Slices of a batch give the rows that whole batches gave, and empty pages theirs."""
    html = [f"<html lang=en><title>T{i}</title><body><h1 id=a{i}>H</h1><p>Some text {i} <a href=/x{i}>l</a></p></body></html>" for i in range(7)] + [None, ""]
    frame = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    assert pages.PAGES < 1000
    monkeypatch.setattr(pages, "PAGES", 2)
    got = frame.select("page_id", pages.parse_page("html", "url").alias("p")).orderBy("page_id").collect()
    assert [r["p"]["title"] for r in got[:7]] == [f"T{i}" for i in range(7)] and got[3]["p"]["blocks"][0]["attributes"] is not None
    assert [x["url"] for r in got[:7] for x in r["p"]["links"]] == [f"http://a.org/x{i}" for i in range(7)] and got[8]["p"]["blocks"] == []
