"""The training-data operators against brute force, and on odd tables."""

import bisect
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webkb.llm import chroma, exact_dedup, html_text, lm_score, mixing, packing, pii, quality, queries, simhash, substring_dedup
from webkb.llm.suffix import suffix_array

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use themselves."""
    words = [f"w{i % 977}x{i % 31}" for i in range(20_000)]
    texts = [None, "", " \t ", "a b c", "a  b\tc", "a b c", "x" * 3000, " ".join(words), "é😀 ü", "Tea, at 12."]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or ""), "k", i, [1]) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a b c", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC + ", key string, _id long, score array<int>").coalesce(1)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def test_suffix_array():
    for seed in range(400):
        r = random.Random(seed)
        text = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 60))] * r.choice([1, 3]) + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([]) == []


def removed(rows):
    """Brute force over all windows in the order of (id, start)."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [2000, 3])
def test_substring_dedup(spark, sf, limit):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120)
    more = [(10_000 + i, t) for i, t in enumerate([None, "", "ab" * 300, "a" * 99, "a" * 100, "a" * 101, "z" * 400 + "ab" * 100] + [f"begin {i} " + "shared passage of some length, " * 6 + f" end {i}" for i in range(9)])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(docs, limit=limit).drop("kept").collect())
    assert got == removed(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_substring_dedup_odd(spark):
    docs = odd_docs(spark)
    got = substring_dedup.remove_repeats(docs).drop("kept").collect()
    ordered = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or ""))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed(ordered)))
    assert substring_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_exact_dedup(spark):
    docs = odd_docs(spark)
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.label_duplicates(docs).collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    for key, text in rows:
        group = [i for i, t in rows if t == text]
        keep = min((i for i in group if i is not None), default=None)
        assert got[key, hashlib.sha256(text.encode()).hexdigest()] == (keep, len(group), key == keep)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((norm(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in kept.collect()) == sorted(first_ids(rows).items())
    again = spark.createDataFrame([(2, "x y  z w", "a"), (2, "x y z w", "b"), (None, "x y z w", "c"), (None, "q", "d"), (None, "q", "d"), (9, "x y z w", "e")], "doc_id long, text string, _row string")
    assert sorted((norm(r["text"]), r["doc_id"]) for r in exact_dedup.drop_duplicates(again).collect()) == [("q", None), ("x y z w", 2)]
    assert exact_dedup.drop_duplicates(empty_docs(spark)).count() == 0


def first_ids(rows):
    """The smallest id of each text, -1 if all are null."""
    out = {}
    for key, text in rows:
        out.setdefault(text, []).append(key)
    return {t: min((k for k in keys if k is not None), default=-1) for t, keys in out.items()}


def test_simhash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    base = "one two three four five six seven eight nine ten " * 40
    more = [(5000 + i, base + "tail " * i) for i in range(12)] + [(6000, None), (6001, "  "), (6002, "A b"), (6003, "a B")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in rows}
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == prints
    label = {i: i for i in prints}
    changed = True
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_simhash_blocks(spark):
    """A dense ball of fingerprints, compared in blocks and whole, against all pairs."""
    r = random.Random(1)
    center = r.getrandbits(64)
    prints = {center} | {center ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {p: p for p in signed}
    for _ in range(70):
        for a in signed:
            for b in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                    want[a] = want[b] = min(want[a], want[b])
    for block in (1024, 8):
        label = {x["v"]: x["l"]["v"] for x in simhash.components(simhash.links(classes, block)).collect()}
        assert {p: label.get(p, p) for p in signed} == want


def test_simhash_odd(spark):
    docs = odd_docs(spark)
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    assert kept.count() == len({r["component_id"] for r in found})
    again = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (None, "one two three four five", 3), (None, "one two three four five", 3), (3, "q r s t", 4), (3, "u v w x y", 5)], "doc_id long, text string, fp long")
    assert sorted((r["text"], r["doc_id"]) for r in simhash.drop_near_duplicates(again).collect()) == [("a b c d e f", 1), ("one two three four five", None), ("q r s t", 3), ("u v w x y", 3)]
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by.setdefault(source[r["doc_id"]], []).append(r)
    targets = water_fill({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(targets[s]) and v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)


def water_fill(sizes):
    """Share by weight; what is above a cap is cut off and shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= over


def test_mixing_caps_and_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "FANIN", 3)
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 10 else "tiny") for i in range(400)] + [(1000, None, None), (1001, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    targets = water_fill({"big": sum(i % 7 + 1 for i in range(400) if i % 10), "tiny": sum(i % 7 + 1 for i in range(400) if not i % 10), None: 1})
    names = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows)
    for s in ("big", "tiny", None):
        mine = [r for r in got if names[r["doc_id"]] == s]
        assert mine[0]["target"] == pytest.approx(targets[s]) and abs(sum(r["taken"] for r in mine) - targets[s]) <= 7
    assert mixing.apply_mix(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_mixing_odd(spark):
    docs = odd_docs(spark)
    assert mixing.mix(docs).count() == docs.count() and mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.apply_mix(empty_docs(spark)).count() == 0


def test_best_fit_is_best_fit_decreasing():
    for seed in range(20):
        r = random.Random(seed)
        lengths = [min(63, r.randint(1, r.choice([5, 30, 64]))) for _ in range(300)]
        counts = {x: lengths.count(x) for x in lengths}
        gaps, bins = [], 0
        for x in sorted(lengths, reverse=True):
            i = bisect.bisect_left(gaps, x)
            bins += i == len(gaps)
            gap = gaps.pop(i) if i < len(gaps) else 64
            bisect.insort(gaps, gap - x)
        runs = packing.best_fit(counts, 64)
        used = {}
        for x, n in counts.items():
            for rank in range(n):
                run = [u for u in runs.tolist() if u[0] == x and u[1] <= rank][-1]
                since = rank - run[1]
                used.setdefault(run[2] + since // run[3], []).append((run[4] + since % run[3] * x, x))
        assert len(used) == bins
        for v in used.values():
            v.sort()
            assert [o for o, _ in v] == [sum(x for _, x in v[:i]) for i in range(len(v))] and sum(x for _, x in v) <= 64


def test_packing(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(7001, None), (7002, "a<|endoftext|>b  \n\n c"), (7003, "q" * 5000), (7004, " " * 3000)], "doc_id long, text string"))
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for no, p in enumerate(sorted(by_doc[d["doc_id"]], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"], p["ids_crc32"]) == (no, at, zlib.crc32(ids[at : at + p["length"]].tobytes())) and (no == 0 or p["length"] == 2048)
            at += p["length"]
        assert at == len(ids)
    for v in by_sequence.values():
        v.sort()
        assert [o for o, _ in v] == [sum(x for _, x in v[:i]) for i in range(len(v))] and sum(x for _, x in v) <= 2048
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 2


def test_packing_odd(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["piece"] == 0 for r in rows) == docs.count()
    assert packing.pack(empty_docs(spark)).count() == 0


def test_quality(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held"]]
    assert sum((r["score"] >= 0.3) == bool(r["quality"]) for r in held) / len(held) >= 0.95
    odd = odd_docs(spark)
    assert quality.score(odd, model).count() == odd.count() and quality.keep_good(odd, model).columns == odd.columns
    assert quality.score(empty_docs(spark), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_quality_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 5, 2)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    model = quality.fit(bags, y, steps=3)
    x, starts = np.concatenate(bags).astype(float), np.array([0, 1, 4, 9])
    loss = lambda: -(y * np.log(p := model.forward(x, starts)["score"]) + (1 - y) * np.log(1 - p)).mean()
    grads = model.gradients(x, starts, y)
    for name, g in grads.items():
        place = tuple(0 for _ in g.shape)
        model.params[name][place] += 1e-5
        up = loss()
        model.params[name][place] -= 2e-5
        down = loss()
        model.params[name][place] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[place], abs=1e-6)


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=/a>Home</a></nav></header><div class="cookie-notice">We use cookies on this site, accept them</div>
<main><article><h2>Title here</h2><p>First para with &amp; &eacute; and <a href=x>link text</a> more.<p>Sec<b>ond</b>&nbsp;para<br>x</p><ul><li>one item<li>two item</ul><aside>buy now great thing</aside>
<form><label>Mail</label><input></form><div class="ad">Advert text here</div></article><section id="comments"><article><p>Comment by a reader that is long enough to look like text.</p></article></section></main>
<footer>(c) me</footer><script>var a="</p><p>no"</script></body></html>"""


L1, L2 = "A first sentence that says what the page is about, in some detail and at length.", "The second one goes on for a while, as such sentences on such pages do, and then ends."
NAV, FOOT = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "<footer>All rights reserved, Example Company, 2020</footer>"
#: Page shapes (what stands in the body) and their main text.
SHAPES = [
    (f"{NAV}<article><h1>Title</h1><p>{L1}<p>{L2}</article>{FOOT}", f"Title {L1} {L2}"),
    (f"{NAV}<main><h1>Title</h1><p>{L1}</p></main>{FOOT}", f"Title {L1}"),
    (f"<div role=main><p>{L1}</p></div><div role=navigation>{L2}</div>", L1),
    (f"<div class=entry-content><p>{L1}</p></div><div class=sidebar><p>{L2}</p></div>", L1),
    (f"<article><h1 class=post-header>Title</h1><p>{L1}</p></article>", f"Title {L1}"),
    (f"<article><header class=article-header><h1>Title</h1></header><p>{L1}</p></article>", f"Title {L1}"),
    (f"<article><div class=search-results-discussion><p>{L1}</p></div></article>", L1),
    (f"<article><p>{L1}</p><div class=teaser>Read more about this</div></article>", L1),
    (f"<article><p>{L1}</p><ul><li class=ad>Buy now<li>Real item</ul><p>{L2}</p></article>", f"{L1} Real item {L2}"),
    (f"<article><p>{L1}</p><aside>Something else</aside><p>{L2}</p></article>", f"{L1} {L2}"),
    (f"<article><p>{L1}</p><form><label>Mail</label><input></form></article>", L1),
    (f"<article><p>{L1}</p><footer>By the author</footer></article>", L1),
    (f"<article><p>{L1}</p></article><section id=comments><article><p>{L2}</p></article></section>", L1),
    (f"<main><article><p>{L1}</p></article><div class=comment-list><p>{L2}</p></div></main>", L1),
    (f"<div class='cookie-notice'><p>{L2}</p></div><article><p>{L1}</p></article>", L1),
    (f"<article><div class='ad-banner'><p>{L2}</p></div><p>{L1}</p></article>", L1),
    (f"<article class='has-sidebar no-ads'><p>{L1}</p></article>", L1),
    (f"<article><p>{L1}</p><p>See also <p><a href=x>A link</a><p>{L2}</article>", f"{L1} See also A link {L2}"),
    (f"<article><ul><li><a href=x>One</a><li><a href=y>Two</a><li><a href=z>Three</a></ul></article>", "One Two Three"),
    (f"<article><table><tr><th>Name<th>Value<tr><td>a<td>1</table><p>{L1}</article>", f"Name Value a 1 {L1}"),
    (f"<article><dl><dt>Term<dd>{L1}<dt>Other<dd>{L2}</dl></article>", f"Term {L1} Other {L2}"),
    (f"<article><p>{L1}<script>var a='<p>no</p>'</script><style>p{{}}</style><noscript>off</noscript></article>", L1),
    (f"<article><p>caf&eacute; &amp; &#x1F600; &lt;b&gt;\n\t {L1}</article>", f"caf\u00e9 & \U0001f600 <b> {L1}"),
    (f"<article><p>{L1}<p hidden>secret<p style='display: none'>secret<p aria-hidden=true>secret</article>", L1),
    (f"<article><div><p>{L1}<b>bold<i>both</b></i></div><p>{L2}</article>", f"{L1}boldboth {L2}"),
    (f"<article><!-- {L2} --><p>{L1}</article>", L1),
    (f"<article><pre>a  b\nc</pre><figure><img src=x><figcaption>A caption</figcaption></figure></article>", "a b c A caption"),
    (f"<article><div class='social'><a href=x>Share</a> <a href=y>Tweet</a></div><p>{L1}</article>", L1),
    (f"{NAV}<div><h1>Title of it</h1><p>{L1} {L2} {L1}</p><p>{L2} {L1} {L2}</p><p>{L1} {L2} {L1}</p></div>{FOOT}", f"Title of it {L1} {L2} {L1} {L2} {L1} {L2} {L1} {L2} {L1}"),
    (f"<div><a href=a>Home</a></div><div><a href=b>News</a></div><p>{L1} {L2} {L1}</p><p>{L2} {L1} {L2}</p><div><a href=c>Terms</a></div>", f"{L1} {L2} {L1} {L2} {L1} {L2}"),
    (f"<article><p>{L1}<br>{L2}</p></article></div></div>stray", f"{L1} {L2}"),
    (f"<article><section><h2>Part</h2><p>{L1}</section><section><h2>Part two</h2><p>{L2}</section></article>", f"Part {L1} Part two {L2}"),
    (f"<article><article><p>{L1}</article></article><div class='related-posts'><p>{L2}</p></div>", L1),
]


@pytest.mark.parametrize("body, text", SHAPES)
def test_html_shapes(body, text):
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>", html_text.grow(*html_text.labelled())) == text


def test_html_tree():
    """The tree uses the words and links of blocks and neighbours, and no block of an unmarked content element is lost."""

    def used(tree):
        return set() if "main" in tree else {html_text.COLUMNS[tree["feature"]]} | used(tree["low"]) | used(tree["high"])

    tree = html_text.grow(*html_text.labelled())
    assert {"words", "links", "links_before", "words_after"} <= used(tree)
    r = np.random.default_rng(0)
    n = 5000
    shares = [r.integers(0, 80, n), r.random(n).round(1), r.integers(0, 80, n), r.random(n).round(1), r.integers(0, 80, n), r.random(n).round(1)]
    rows = lambda *where: np.stack([*shares, *[np.full(n, x) for x in where]], 1)
    assert html_text.classify(tree, rows(1, 0, 0, 0, 1)).mean() > 0.99
    assert not html_text.classify(tree, rows(1, 1, 0, 0, 1)).any() and not html_text.classify(tree, rows(0, 0, 0, 0, 1)).any()


@pytest.mark.parametrize("broken", ["<a ", "<!--", "<![CDATA[", "</", "<!", "<?", "<p <", "<a b='"])
def test_html_broken(broken):
    """Openings without an end, many of them: text before them stays, the time is in proportion."""
    tree = html_text.grow(*html_text.labelled())
    text = "A paragraph of the article that stands before what is broken and has some words. " * 3
    page = f"<html><body><article><p>{text}</p>{broken * 100_000}"
    began = time.perf_counter()
    assert html_text.main_text(page, tree).startswith(" ".join(text.split()))
    html_text.main_text(broken * 100_000 + "x>", tree)
    assert time.perf_counter() - began < 4
    assert html_text.closed("<p>a < b <i>c</i><!-- d --><b") == "<p>a < b <i>c</i><!-- d --><b"


def test_html_time():
    """Unclosed and stray tags cost time in proportion."""
    import time

    def seconds(n):
        began = time.process_time()
        html_text.main_text("<article>" + "<b>x<p><div>" * n + "</i></span>" * n, tree)
        return time.process_time() - began

    tree = html_text.grow(*html_text.labelled())
    seconds(1000)
    assert seconds(40_000) < 16 * max(seconds(5_000), 0.05)


def test_html(spark, sf):
    import html

    x, y = html_text.labelled()
    tree = html_text.grow(x, y)
    assert (html_text.classify(tree, x) == (y == 1)).all()
    assert html_text.main_text(PAGE, tree) == "Title here First para with & é and link text more. Second para x one item two item"
    for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").drop("url"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        plain = html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p>unclosed <b", "x")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html_text.extract(odd).collect()][:2] == ["", ""]
    twice = odd.limit(0).unionByName(odd.limit(1)).unionByName(odd.limit(1))
    assert html_text.extract(twice).count() == 2 and html_text.extract(odd.limit(0)).count() == 0


def test_lm_score(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "The dog ran home"), (3, None), (4, "zebra")], "doc_id long, text string")
    target = spark.createDataFrame([("the cat sat on the cat",)], "text string")
    models = lm_score.fit(docs.select("text"), target, vocabulary=100, pairs=100)
    assert np.allclose(models.unigrams.sum(1), 1)
    size = len(models.vocabulary) + 2
    for side in (0, 1):  # every context sums to one
        kept = np.bincount(models.keys // size, models.pairs[side], size)
        assert np.allclose(kept + models.backoff[side], 1)
    rows = {r["doc_id"]: r for r in lm_score.score(docs, models).collect()}
    assert rows[1]["score"] < rows[2]["score"] < rows[4]["score"] and rows[3]["n_tokens"] == 1
    texts = ["the cat sat", "the dog ran home", "", "zebra"]
    count = lambda corpus, *g: sum(list(zip(*[(["^"] + t.split() + ["^"])[i:] for i in range(len(g))])).count(g) for t in corpus)
    for side, corpus in ((0, texts), (1, ["the cat sat on the cat"])):
        words = [w for t in corpus for w in t.split() + ["^"]]
        uni = lambda w: (words.count(w) + 0.1) / (len(words) + 0.1 * size)  # noqa: E731,B023
        loss = []
        for a, b in (("^", "the"), ("the", "cat"), ("cat", "sat"), ("sat", "^")):
            context = sum((["^"] + t.split()).count(a) for t in corpus)
            pair = 0.7 * count(corpus, a, b) / context if context else 0.0
            loss.append(-np.log(pair + (0.3 if context else 1.0) * uni(b)))
        assert rows[1]["ce_target" if side else "ce_background"] == pytest.approx(np.mean(loss))
    odd = odd_docs(spark)
    assert lm_score.score(odd, models).count() == odd.count()
    empty = lm_score.fit(empty_docs(spark).select("text"), target.limit(0))
    assert lm_score.score(odd, empty).count() == odd.count()


def test_lm_score_whole(spark, tmp_path, monkeypatch):
    """The registered query counts all words and pairs: here 81,000 words, most of them in one or two documents."""
    texts = [None, "", " \t ", "Tea, tea"] + [" ".join(f"w{i}x{j} the" if j % 3 else f"W{i % 30}y{j}\tthe" for j in range(2000)) for i in range(60)]
    aims = ["the w3x1 the w3x2", "w3x1 the", None, "unheard of"]
    spark.createDataFrame(list(enumerate(texts)) + [(None, "Tea"), (7, "the the")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in aims], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(lm_score, "BLOCK", 9000)
    monkeypatch.setattr(lm_score, "SHARD_CHARS", 1 << 18)
    split = lambda t: [""] + (t or "").lower().split() + [""]
    corpora = [[split(t) for t in [*texts, "Tea", "the the"]], [split(t) for t in aims]]
    words = [Counter(w for t in c for w in t[1:]) for c in corpora]
    pairs = [Counter(p for t in c for p in zip(t, t[1:])) for c in corpora]
    size = len(words[0] | words[1]) + 1
    total = [w.total() for w in words]
    assert size > 1 << 16

    def loss(side, text):
        p = [0.7 * pairs[side][a, b] / max(1, words[side][a]) + (0.3 if words[side][a] else 1) * (words[side][b] + 0.1) / (total[side] + 0.1 * size) for a, b in zip(text, text[1:])]
        return -np.log(p).mean()

    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ce_background"], r["ce_target"]) for r in queries.op7_lm_score(spark, str(tmp_path)).collect()))
    want = sorted((i, len(t) - 1, loss(0, t), loss(1, t)) for i, t in zip([*range(len(texts)), -1, 7], corpora[0]))
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(want))
    docs, aimed = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("text")
    again = lm_score.score_whole(docs, aimed, group=3)  # in groups of blocks
    assert np.allclose(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ce_background"], r["ce_target"]) for r in again.collect()), np.array(want))
    none = lm_score.score_whole(empty_docs(spark), empty_docs(spark).select("text"))
    assert none.count() == 0 and lm_score.score_whole(odd_docs(spark), empty_docs(spark).select("text")).count() == odd_docs(spark).count()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark, sf):
    texts = [None, "", "x@y.z_w@q.r a@b.c@d.e 1.2.3.45.6.7.8", "é😀 a.b@c-d.e. +1 (988) 555-2485 4111 1111 1111 1111 4111-1111-1111-1111-1", "9" * 20_000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+123456789 +1+22 333 444 5555 ..", "0255.1.2.3 256.1.1.1 a@b 12a@b.c.d", "a" * 20_000 + "@"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = {r["doc_id"]: base_spans(r["text"]) for r in docs.collect()}
    for r in pii.digest(pii.find(docs)).collect():
        spans = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and r["spans"] == spans
        assert [r[f"n_{k}"] for k in BASE] == [len(re.findall(rf"\b{k}:", spans)) for k in BASE]
    assert pii.find(empty_docs(spark)).count() == 0 and pii.find(odd_docs(spark)).count() == 13


def test_pii_bootstrap(spark):
    """Contexts of known identifiers lead to others that the base patterns miss, also in several words; other contexts don't."""
    known = [(i, f"You can write to u{i}@mail.org today") for i in range(12)] + [(20 + i, f"my phone is +1 ({i + 200}) 555-72{i + 10} ok") for i in range(8)]
    more = [(100, "You can write to u77@intranet today"), (101, "The build number 1234567 is old"), (102, "please write to q5@lan!"), (103, "You can write to 7777777 today")]
    more += [(104, "my phone is (555) 123-4567 ok, my phone is 030 1234 5678 too. my phone is 7 ok"), (105, "call 555 8080 10.1.2.3 2024 11"), (106, 'my phone is "AB-1234". ' + "w" * 300 + " x")]
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(known + more, "doc_id long, text string"))).collect()}
    assert [rows[i] for i in range(100, 107)] == ["email:17:29", "", "email:16:22", "", "phone:12:26,phone:43:56", "ip:14:22", "phone:13:20"]


def test_pii_planted(spark, sf):
    """Unseen identifiers planted among the documents are found, nothing else is added."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    seeds = [(70_000 + i, f"Reach our desk under +49 30 55{i:02d} 1234 from Monday on") for i in range(10)]
    hidden = [(71_000 + i, f"text before\nreach our desk under 030 77{i:02d} 99 from today") for i in range(5)]
    got = pii.find(docs.unionByName(spark.createDataFrame(seeds + hidden, "doc_id long, text string"))).where("size(added) > 0").collect()
    at = len("text before\nreach our desk under ")
    assert sorted((r["doc_id"], [tuple(x) for x in r["added"]]) for r in got) == [(71_000 + i, [(at, 3, at + 11)]) for i in range(5)]


def test_pii_graph(spark):
    """Scores of the graph against a plain calculation, through several rounds, with ties between kinds."""
    r = random.Random(4)
    kinds = ["email", "ip", "card", "phone"]
    values = [f"a@{i}.{i}.{i}.{i}" for i in range(60)]
    spans = [(r.choice([0, 1, 4, 4]), v, [f"w{r.randint(0, 4)}", f"v{r.randint(0, 2)}"], [f"x{r.randint(0, 5)}", None]) for v in values for _ in range(4)]
    spans += [(k, f"t@{i}.1", ["tie", None], [None, None]) for i in range(8) for k in (0, 1)] + [(4, "t@9.9", ["tie", None], [None, None])]
    table = spark.createDataFrame(spans, "no int, value string, before array<string>, after array<string>")

    def patterns(before, after):
        (b1, b2), (a1, a2) = ([w and re.sub("[0-9]", "9", w) for w in x] for x in (before, after))
        return [p for p in (b2 and f"l2 {b2} {b1}", b1 and f"l1 {b1}", b1 and a1 and f"lr {b1} _ {a1}", a1 and a2 and f"r2 {a1} {a2}") if p]

    def shape(v):
        return re.sub("[a-z]+", "a", re.sub("[0-9]+", "9", v))

    edges = {(p, no, v) for no, v, b, a in spans for p in [*patterns(b, a), *([f"ls {re.sub('[0-9]', '9', b[0])} {shape(v)}"] if b[0] else [])]}
    totals = {p: len({v for q, _, v in edges if q == p}) for p, _, _ in edges}
    accepted = {}
    while True:
        support = {}
        for p, no, v in edges:
            if no < 4:
                support[p, no] = support.get((p, no), 0) + 1
            elif v in accepted:
                support[p, accepted[v][0]] = support.get((p, accepted[v][0]), 0) + accepted[v][1]
        weight = {(p, k): s / totals[p] for (p, k), s in support.items() if s >= 2 and s / totals[p] > 0.5}
        doubt = {}
        for p, no, v in edges:
            for k in range(4):
                if no == 4 and (p, k) in weight and re.search(pii.NEEDS[kinds[k]], v):
                    doubt[v, k] = doubt.get((v, k), 1.0) * max(1e-9, 1 - weight[p, k])
        found = {}
        for (v, k), x in sorted(doubt.items()):
            if 1 - x >= 0.7 and v not in accepted and (v not in found or round(1 - x, 9) > found[v][1]):
                found[v] = (k, round(1 - x, 9))
        if not found:
            break
        accepted |= found
    got = {x["value"]: (x["no"], x["confidence"]) for x in pii.bootstrap(table, 2.0, 0.7).collect()}
    assert got.keys() == accepted.keys() and len(got) > 3 and got["t@9.9"][0] == 0
    assert all(got[v][0] == k and got[v][1] == pytest.approx(c, abs=1e-6) for v, (k, c) in accepted.items())


def test_pii_long(spark):
    docs = spark.createDataFrame([(1, " ".join(str(i * 7919 % 1_000_003) for i in range(30_000))), (2, "x" * 5_000 + " 12 " + "-" * 100_000), (3, ". " * 50_000 + "1.2.3.4 " + " " * 100_000 + "5")], "doc_id long, text string")
    assert [r["spans"] for r in pii.digest(pii.find(docs)).orderBy("doc_id").collect()] == [base_spans(r["text"]) for r in docs.collect()]


def noisy_audio(spark, rng, count):
    """Recordings by id: `count` of chance, silence of two forms, and noisy copies (from 1000) of the first ones at many levels of noise and cuts, also within a frame."""
    vectors = [(i, rng.normal(size=64).tolist()) for i in range(count)] + [(900, None), (901, [0.0] * 64)]
    audio = {r["id"]: bytes(r["audio"]) for r in chroma.recordings(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    noisy = lambda b, cut, level: np.clip(np.frombuffer(b, "<i2")[cut:] + rng.normal(0, level, len(b) // 2 - cut), -32768, 32767).astype("<i2").tobytes()
    copies = [noisy(audio[i % 8], (256 * i + 77 * (i % 3)) % 5120, (200, 1000, 2000, 3000)[i % 4]) for i in range(160)]
    return audio | {1001 + i: c for i, c in enumerate(copies)} | {2001 + 2 * i: audio[3] for i in range(4)}


def aligned_by_force(prints, step, least, most):
    """(query, other) to {offset: (overlap, errors)} over all offsets."""
    want = {}
    for q in (i for i in prints if i % step == 0):
        for o in prints:
            for offset in range(least - len(prints[o]), len(prints[q]) - least + 1):
                x, y = prints[q][max(0, offset) :], prints[o][max(0, -offset) :]
                n = min(len(x), len(y))
                errors = int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n) if n >= least else 1.0
                if o != q and errors <= most and not np.array_equal(prints[q], prints[o]):
                    want.setdefault((q, o), {})[offset] = (n, errors)
    return want


def test_chroma(spark):
    """At the production limits: recall of planted noisy copies, every reported row exact, votes by plain comparison."""
    audio = noisy_audio(spark, np.random.default_rng(5), 60)
    media = spark.createDataFrame([*audio.items(), (3001, None), (3002, b"x")], "id long, audio binary")
    found = {i: chroma.doubtful(np.frombuffer(a[: len(a) // 2 * 2], "<i2")) for i, a in audio.items()}
    prints, step = {i: v for i, (v, _) in found.items()}, 2
    prints = {i: v for i, v in prints.items() if i < 2000}  # without the copies of 3
    want = aligned_by_force(prints, step, chroma.LEAST_OVERLAP, chroma.MOST_ERRORS)
    marks = chroma.fingerprints(media, "id", "audio")
    got = {(r["class_id"], r["match_id"]): r for r in chroma.alignments(marks, query_step=step).collect()}
    assert got.keys() <= want.keys() and len(want) > 200 and len(got) >= 0.9 * len(want)
    for (q, o), r in got.items():
        assert want[q, o][r["offset"]] == (r["overlap"], pytest.approx(r["bit_errors"]))
        x, y = max(0, r["offset"]), max(0, -r["offset"])
        a, b = (slice(at, at + r["overlap"]) for at in (x, y))
        free = chroma.masks(found[q][1], chroma.QUERY_DOUBTS)[a] | chroma.masks(found[o][1], chroma.DOUBTS)[b]
        assert r["votes"] == ((prints[q][a] ^ prints[o][b]) & ~free == 0).sum() >= chroma.LEAST_VOTES
    planted = {k for k in want if k[0] < 900 and k[1] % 8 == (k[0] + 1) % 8 and k[1] > 1000}
    assert len(planted) > 50 and len(planted & got.keys()) >= 0.9 * len(planted)
    rows = chroma.align(marks, query_step=step).collect()
    assert len(rows) == len(audio) + 2
    for r in rows:
        mine = [m for (q, _), m in got.items() if q == r["id"]]
        best = min(mine, key=lambda m: (-m["votes"], m["bit_errors"], m["match_id"]), default=None)
        assert r["n_matches"] == len(mine) and (best is None and r["match_id"] is None or all(best[c] == r[c] for c in ("match_id", "offset", "overlap", "votes", "bit_errors")))
    assert {r["id"]: r["class_id"] for r in rows}[2003] == 3


def test_chroma_wide(spark, monkeypatch):
    """Keys with bits of a later frame: most meetings of chance go, the noisy copies are still found and every row is exact."""
    assert [chroma.wide_bits(n) for n in (0, 2048, 10_256, 51_282, 1 << 40)] == [0, 0, 4, 8, chroma.MOST_WIDE]
    audio = noisy_audio(spark, np.random.default_rng(9), 60)
    marks = chroma.fingerprints(spark.createDataFrame([*audio.items()], "id long, audio binary"), "id", "audio")
    classes = chroma._classes(marks, 2)
    plain = {(r["class_id"], r["match_id"]): r for r in chroma.alignments(marks, query_step=2).collect()}
    apart = "class_id < 900 AND match_id < 900"
    met = chroma._offsets(classes, chroma.LEAST_OVERLAP).where(apart).count()
    for bits in (8, 12):
        monkeypatch.setattr(chroma, "wide_bits", lambda n, bits=bits: bits)
        assert chroma._offsets(classes, chroma.LEAST_OVERLAP).where(apart).count() < met / 4
        got = {(r["class_id"], r["match_id"]): r for r in chroma.alignments(marks, query_step=2).collect()}
        assert got.keys() <= plain.keys() and len(got) >= 0.93 * len(plain) > 200
        assert all(r["votes"] >= chroma.LEAST_VOTES and r["bit_errors"] <= chroma.MOST_ERRORS and r["overlap"] >= chroma.LEAST_OVERLAP for r in got.values())
        assert sum(r == plain[k] for k, r in got.items()) > 0.9 * len(got)


def test_chroma_whole(spark, monkeypatch):
    """What is found does not depend on the number of recordings: wide keys, as large tables would get them, miss a copy whose only votes lie at its end."""
    base = np.random.default_rng(7).integers(0, 1 << 32, (4, 48))
    late = base[0] ^ 7  # three bits of every frame differ
    late[-2:] = base[0][-2:]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*base, late])], "id long, integers array<bigint>")
    monkeypatch.setattr(chroma, "wide_bits", lambda n: 8)
    assert [(r["class_id"], r["match_id"], r["offset"], r["votes"]) for r in chroma.alignments(rows).collect()] == [(0, 4, 0, 2)]
    assert chroma.alignments(rows, narrow=True).count() == 0


def test_chroma_odd(spark):
    """Integers without doubts meet where they are equal; repeated and null ids, a hot integer, short and empty prints."""
    base = np.random.default_rng(6).integers(0, 1 << 32, (40, 48))
    prints = {i: v for i, v in enumerate(base)} | {100 + i: np.concatenate([base[0][i % 20 :], [7] * 20]) for i in range(20)} | {300: base[1][:7], 301: base[0][:0], 350: np.array([7] * 48)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in prints.items()], "id long, integers array<bigint>")
    want = aligned_by_force(prints, 50, chroma.LEAST_OVERLAP, chroma.MOST_ERRORS)
    got = {(r["class_id"], r["match_id"]): r for r in chroma.alignments(rows).collect()}
    assert got.keys() == want.keys() and len(want) > 20 and all(want[k][m["offset"]] == (m["overlap"], m["bit_errors"]) for k, m in got.items())
    odd = spark.createDataFrame([(50, [1, 2] * 15, 1), (50, [1, 2] * 15, 2), (None, [1, 2] * 15, 3), (7, [1, 3] * 15, 4), (8, [], 5), (None, [1, 4] * 15, 6)], "id long, integers array<bigint>, votes int")
    assert sorted(str((r["id"], r["match_id"])) for r in chroma.align(odd.drop("votes")).collect()) == ["(50, 7)", "(50, 7)", "(7, None)", "(8, None)", "(None, None)", "(None, None)"]
    assert chroma.align(rows.limit(0)).count() == 0


