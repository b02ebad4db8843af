"""Cross-tokenizer alignment against a plain count of all overlapping tokens."""

import base64
import bisect
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import empty_docs, odd_docs
from webkb.llm import alignment, queries


def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        bytes_a = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    return (lambda t: a.encode(t, add_special_tokens=False).ids), bytes_a, b.encode, piece


def spans(parts):
    at, found = 0, []
    for p in parts:
        found.append((at, at + len(p)))
        at += len(p)
    return found


def brute(rows):
    """Every pair of tokens of a text whose byte ranges overlap, by comparing them all in order."""
    encode_a, bytes_a, encode_b, piece = encoders()
    texts = []
    for key, text in rows:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(piece(i) for i in b) != whole:
            a = b = []
        at_a, at_b = spans([bytes_a[i] for i in a]), spans([piece(i) for i in b])
        links, k = [], 0
        for i, (s, e) in zip(a, at_a):
            while k and at_b[k - 1][1] > s:
                k -= 1
            while k < len(b) and at_b[k][0] < e:
                if at_b[k][1] > s:
                    links.append((i, b[k]))
                k += 1
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups = [([], []) for _ in both]
        for side, (ids, at) in enumerate(((a, at_a), (b, at_b))):
            for i, (_, e) in zip(ids, at):
                groups[bisect.bisect_left(both, e)][side].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        texts.append((key, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for t in texts for x in t[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(k, na, nb, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), d) for k, na, nb, g, x, d in texts]


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_gallop():
    r = np.random.default_rng(5)
    for n, m in [(1, 1), (1, 900), (7, 9), (64, 64), (65, 513), (500, 40_000), (513, 700)]:
        long = np.sort(r.choice(10 * m, m, replace=False))
        short = np.unique(np.append(r.choice(long[-1] + 1, n - 1), long[-1]))
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()


def test_aligned_random():
    r = random.Random(3)
    for _ in range(300):
        total = r.randint(1, 60)
        cuts = [sorted({*r.sample(range(1, total), r.randint(0, total - 1)), total}) if total > 1 else [1] for _ in range(2)]
        a, b = (np.diff([0, *c]) for c in cuts)
        got = alignment.Aligned(a, b)
        at_a, at_b = (list(zip([0, *c[:-1]], c)) for c in cuts)
        want = {(i, j) for i, (s, e) in enumerate(at_a) for j, (u, v) in enumerate(at_b) if s < v and u < e}
        assert set(zip(got.link_a.tolist(), got.link_b.tolist())) == want and len(got.link_a) == len(want)
        both = sorted(set(cuts[0]) & set(cuts[1]))
        assert [cuts[0][i] for i in got.common_a] == both == [cuts[1][j] for j in got.common_b]


@pytest.mark.parametrize("block", [alignment.BLOCK_LINKS, 300])
def test_align(spark, sf, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = ["", None, "a", " ", "  two  spaces ", "<|endoftext|> <s> </s> <unk>", "new\nline\ttab\r\n", "▁ piece sign", "\0 zero", "é ﬁ 　 \U0001f600‍", "x" * 2500, "." * 2100, "1234567890" * 30]
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(brute(rows), key=str)
    assert plain(alignment.align(docs, block_links=block)) == want
    assert sum(w[1] > 0 for w in want) > len(rows) / 2


def test_align_odd(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert plain(alignment.align(docs)) == sorted(brute(rows), key=str)
    assert alignment.align(empty_docs(spark)).count() == 0
    renamed = docs.withColumnRenamed("doc_id", "block").withColumnRenamed("text", "pairs")
    assert alignment.align(renamed, "block", "pairs").columns[0] == "block"
    assert plain(alignment.align(renamed, "block", "pairs")) == plain(alignment.align(docs))


def test_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(30)
    got = alignment.groups(docs).collect()
    lines = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["group"])):
        lines.setdefault(r["doc_id"], []).append(",".join(map(str, r["ids_a"])) + "|" + ",".join(map(str, r["ids_b"])))
    digests = {r["doc_id"]: (r["groups_sha256"], r["n_groups"]) for r in alignment.align(docs).collect() if r["n_a"]}
    assert {k: (hashlib.sha256(";".join(v).encode()).hexdigest(), len(v)) for k, v in lines.items()} == digests


def test_query(spark, sf):
    found = queries.QUERIES["op11_alignment"](spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
