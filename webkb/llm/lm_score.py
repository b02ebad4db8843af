"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target corpus and one of the background (all documents), share one vocabulary,
one smoothing and one capacity. A document's score is its cross-entropy per token under the target model
minus that under the background model: the lower, the closer to the target.

score_whole() keeps every word and every word pair of both corpora; nothing is cut and no model is broadcast.
Documents are gathered in blocks of about BLOCK tokens. A block sends its distinct words and pairs with their
counts to shards chosen by hash, one row for each shard it has something for, so that rows are never more than its keys. A
shard sums them and answers each block for its own keys. Very frequent words and pairs come from every block; so a
shard's blocks are first summed in groups of GROUP, which send one row each, and the sums go back the same way. A word
or pair thus has one row a block however often it occurs, and memory is bounded by a block, a shard or a group while their
numbers grow with the input. Words are told apart by 128 bits of a digest, pairs by 64 bits and their shard. The
totals, words of both corpora and distinct words (by 64 bits), are counted before.
With all pairs kept, a context that was seen backs off with weight 1 - WEIGHT, any other with 1.

fit() and score() are the small form: models of a stated capacity that fit in memory. They keep the pairs counted
at least c times, where c is the smallest count that leaves at most PAIRS of them, and the vocabulary likewise.

Each document ends with a boundary token, so an empty or null text has one token and a score. Words are
lower-case and separated by ASCII white space. An empty target or background still gives a smoothed model. Rows that
repeat a doc_id, or have none, are documents of their own; extra columns are left alone. A document longer than a
block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialise

VOCABULARY = 1 << 16
PAIRS = 1 << 19
WEIGHT = 0.7
ALPHA = 0.1
BLOCK = 1 << 20  # tokens of a block, or one longer document
SHARD_CHARS = 1 << 22  # characters of both corpora for each shard
GROUP = 1 << 12  # blocks that a shard sums at once
_FLUSH = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A to Z in lower case; bytes.split() and lower() are both ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _at_least(counts: DataFrame, column: str, most: int) -> int:
    """The smallest count c such that at most `most` rows have it or more."""
    c = 1
    while counts.where(F.col(column) >= c).limit(most + 1).count() > most:
        c *= 2
    low = c // 2 + 1
    while low < c:
        mid = (low + c) // 2
        if counts.where(F.col(column) >= mid).limit(most + 1).count() > most:
            low = mid + 1
        else:
            c = mid
    return c


@dataclass
class Models:
    """vocabulary: word to id; unknown words have id n, the boundary n + 1. Arrays have the background first, the target second."""

    vocabulary: dict[bytes, int]
    unigrams: np.ndarray  # (2, n + 2) probabilities
    keys: np.ndarray  # kept pairs as previous * (n + 2) + word, sorted
    pairs: np.ndarray  # (2, pairs) weight * count / context count
    backoff: np.ndarray  # (2, n + 2)

    def ids(self, text: str | None) -> np.ndarray:
        n, get = len(self.vocabulary), self.vocabulary.get
        words = tokens(text)
        out = np.empty(len(words) + 2, np.int64)
        out[1:-1] = [get(w, n) for w in words]
        out[0] = out[-1] = n + 1
        return out

    def losses(self, text: str | None) -> np.ndarray:
        """Per-token loss under the background and the target model, (2, tokens), in nats."""
        ids = self.ids(text)
        before, word = ids[:-1], ids[1:]
        key = before * (len(self.vocabulary) + 2) + word
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        p = self.backoff[:, before] * self.unigrams[:, word]
        if len(self.keys):
            p += np.where(self.keys[at] == key, self.pairs[:, at], 0.0)
        return -np.log(p)


def _pair_counts(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """key and n, the pairs of ids of all texts."""
    shell = Models(vocabulary, *[np.zeros(0)] * 4)
    size = len(vocabulary) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.int64)
            keys, where = np.unique(keys, return_inverse=True)
            counts = np.concatenate([n for _, n in held]) if held else np.zeros(0, np.int64)
            return keys, np.bincount(where, counts, len(keys)).astype(np.int64)

        for batch in batches:
            for text in batch.column(0):
                ids = shell.ids(text.as_py())
                held.append((ids[:-1] * size + ids[1:], np.ones(len(ids) - 1, np.int64)))
                total += len(ids)
                if total > _FLUSH:
                    keys, counts = merged()
                    if len(keys) > _FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                        held, total = [], 0
                    else:
                        held, total = [(keys, counts)], len(keys)
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit(background: DataFrame, target: DataFrame, vocabulary: int = VOCABULARY, pairs: int = PAIRS, weight: float = WEIGHT, alpha: float = ALPHA) -> Models:
    """background and target have one text column each."""
    corpora = [d.select(F.col(d.columns[0]).cast("string").alias("text")) for d in (background, target)]

    def words(d: DataFrame) -> DataFrame:
        spaced = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower()), SPACE, -1)
        return d.select(F.explode(spaced).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    counted = materialise(words(corpora[0]).unionByName(words(corpora[1])).groupBy("word").agg(F.sum("n").alias("n")))
    kept = counted.where(F.col("n") >= _at_least(counted, "n", vocabulary)).select("word").toArrow()  # `vocabulary` rows at most
    ids = {w: i for i, w in enumerate(sorted(w.encode() for w in kept["word"].to_pylist()))}
    size = len(ids) + 2
    tables, unigrams, contexts = [], np.zeros((2, size)), np.zeros((2, size))
    for side, corpus in enumerate(corpora):
        table = materialise(_pair_counts(corpus, ids))
        for into, by in ((unigrams, F.expr(f"key % {size}").alias("id")), (contexts, F.expr(f"key div {size}").alias("id"))):
            sums = table.groupBy(by).agg(F.sum("n").alias("n")).toArrow()  # `size` rows at most
            into[side, sums["id"].to_numpy()] = sums["n"].to_numpy()
        least = _at_least(table, "n", pairs)
        got = table.where(F.col("n") >= least).toArrow()  # `pairs` rows at most
        tables.append((got["key"].to_numpy(), got["n"].to_numpy().astype(float)))
    keys = np.unique(np.concatenate([k for k, _ in tables]))
    shares, backoff = np.zeros((2, len(keys))), np.ones((2, size))
    for side, (k, n) in enumerate(tables):
        share = weight * n / contexts[side, k // size] if len(k) else n
        shares[side, np.searchsorted(keys, k)] = share
        backoff[side] -= np.bincount(k // size, share, size)
    smooth = (unigrams + alpha) / (unigrams.sum(1, keepdims=True) + alpha * size)
    return Models(ids, smooth, keys, shares, backoff)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_tokens, the two cross-entropies and score, their difference."""
    columns = ["doc_id", "n_tokens", "ce_target", "ce_background", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means = [], []
            for text in batch.column(1):
                losses = models.losses(text.as_py())
                n.append(losses.shape[1])
                means.append(losses.mean(1))
            mean = np.array(means).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(mean[:, 1]), pa.array(mean[:, 0]), pa.array(mean[:, 1] - mean[:, 0])], columns)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ce_target double, ce_background double, score double").withColumnRenamed("doc_id", id_col)


_ROW = "shard long, block long, side int, words binary, word_counts binary, pairs binary, pair_counts binary, ids array<bigint>, lengths binary, tokens binary, pair_shards binary"
_ANSWER = "shard long, block long, words binary, pairs binary, ids array<bigint>, lengths binary, tokens binary, pair_shards binary"
_SUMS = "shard long, group long, words binary, word_sums binary, pairs binary, pair_sums binary"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_EDGE = b" "  # the boundary; no word has a space


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _shrunk(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte of their places: all lowest bytes first."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _grown(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<i8").reshape(n)


def _token_pairs(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which neighbours in a block's tokens are of one document: all but a document's end and the next one's start."""
    inside = np.ones(len(tokens) - 1, bool)
    inside[np.cumsum(lengths + 1)[:-1] - 1] = False
    return inside


class _Cuts:
    """Where a shard begins in sorted shard numbers."""

    def __init__(self, ordered: np.ndarray):
        self.ordered = ordered

    def __getitem__(self, shard: int) -> int:
        return int(np.searchsorted(self.ordered, shard))


def _blocks(texts: DataFrame, shards: int, side: int) -> DataFrame:
    """texts (id, binary text) as rows for the shards; those of the background (side 0) carry their block along."""
    schema = _arrow(_ROW)

    def emit(block: int, ids: list, runs: list[list[int]], known: dict[bytes, int]) -> pa.RecordBatch:
        lengths = np.array([len(r) - 1 for r in runs])
        tokens = np.concatenate([np.array(r, np.int64) for r in runs])
        digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in known), "<u8").reshape(-1, 2)
        before, after = (x[_token_pairs(tokens, lengths)] for x in (tokens[:-1], tokens[1:]))
        pairs, pair_counts = np.unique(before * len(known) + after, return_counts=True)
        a, b = digests[pairs // len(known)], digests[pairs % len(known)]
        sides = []
        word_counts = np.bincount(after, minlength=len(known))
        for keys, spread, counts in ((digests[:, 0], digests[:, 1], word_counts), (a[:, 0] * _MIX[0] + b[:, 0] * _MIX[1], a[:, 1] * _MIX[2] + b[:, 1] * _MIX[3], pair_counts)):
            shard = ((spread >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            sides.append((shard, keys[order].astype("<u8"), counts[order], _Cuts(shard[order])))
        (word_shard, wk, wc, wat), (pair_shard, pk, pc, pat) = sides
        rows = [
            (s, block, side, wk[wat[s] : wat[s + 1]].tobytes(), _shrunk(wc[wat[s] : wat[s + 1]]), pk[pat[s] : pat[s + 1]].tobytes(), _shrunk(pc[pat[s] : pat[s + 1]]), None, None, None, None)
            for s in np.union1d(word_shard, pair_shard).tolist()
        ]
        if side == 0:
            rows.append((block % shards, block, side, None, _shrunk(word_shard), None, None, ids, _shrunk(lengths), _shrunk(tokens), _shrunk(pair_shard)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def fresh() -> tuple[list, list, defaultdict, int]:
            known: defaultdict = defaultdict()
            known.default_factory = known.__len__
            known[_EDGE]
            return [], [], known, 0

        ids, runs, known, total = fresh()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or b"").lower().split()
                ids.append(key.as_py())
                runs.append([0, *[known[w] for w in words], 0])
                total += len(words) + 1
                if total >= BLOCK:
                    yield emit(block, ids, runs, known)
                    block += 1
                    ids, runs, known, total = fresh()
        if ids:
            yield emit(block, ids, runs, known)

    return texts.mapInArrow(run, _ROW)


def _both(parts: list[bytes], counts: list[np.ndarray], sides: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of parts, their (background, target) sums, and where each key of the parts is among them. A part is counts of
    one side, or sums of both (no side)."""
    keys = [np.frombuffer(p, "<u8") for p in parts]
    distinct, where = np.unique(np.concatenate([*keys, np.zeros(0, "<u8")]), return_inverse=True)
    pairs = [c.reshape(2, -1) if s is None else np.stack([c * (s == 0), c * (s == 1)]) for c, s in zip(counts, sides)]
    both = np.concatenate([*pairs, np.zeros((2, 0), np.int64)], 1)
    return distinct, np.stack([np.bincount(where, n, len(distinct)) for n in both], 1).astype(np.int64), where


def _asked(shard: pa.Table) -> list[dict]:
    return [r for r in shard.to_pylist() if r["ids"] is None]


def _answers(rows: list[dict], sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """What each block of the background gets from a shard: two numbers a key, in the order of its keys; its own row comes along."""
    out = [(r["shard"], r["block"], r["word_counts"], None, r["ids"], r["lengths"], r["tokens"], r["pair_shards"]) for r in rows if r["ids"] is not None]
    for r in rows:
        if r["ids"] is None and r["side"] == 0:
            out.append((r["shard"], r["block"], *(_shrunk(n[np.searchsorted(keys, np.frombuffer(r[c], "<u8"))].T.ravel()) for c, (keys, n) in sums.items()), None, None, None, None))
    schema = _arrow(_ANSWER)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()


def _sum_shard(shard: pa.Table) -> pa.Table:
    """Sums of all keys of a shard, answered to its blocks."""
    rows = shard.to_pylist()
    asked = [r for r in rows if r["ids"] is None]
    sums = {c: _both([r[c] for r in asked], [_grown(r[n]) for r in asked], [r["side"] for r in asked])[:2] for c, n in (("words", "word_counts"), ("pairs", "pair_counts"))}
    return _answers(rows, sums)


def _sum_group(shard: pa.Table) -> pa.Table:
    """Sums of the keys of one group of a shard's blocks."""
    asked = _asked(shard)
    row: list = [int(shard["shard"][0].as_py()), int(shard["group"][0].as_py())]
    for c, n in (("words", "word_counts"), ("pairs", "pair_counts")):
        keys, sums, _ = _both([r[c] for r in asked], [_grown(r[n]) for r in asked], [r["side"] for r in asked])
        row += [keys.tobytes(), _shrunk(sums.T.ravel())]
    schema = _arrow(_SUMS)
    return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(row, schema)], schema=schema)


def _sum_groups(groups: pa.Table) -> pa.Table:
    """Sums over a shard's groups, answered to each group."""
    rows = groups.to_pylist()
    out: list[list] = [[r["shard"], r["group"]] for r in rows]
    for c, n in (("words", "word_sums"), ("pairs", "pair_sums")):
        _, sums, where = _both([r[c] for r in rows], [_grown(r[n]) for r in rows], [None] * len(rows))
        at = np.cumsum([0, *[len(r[c]) // 8 for r in rows]])
        for r, o, i, j in zip(rows, out, at, at[1:]):
            o += [r[c], _shrunk(sums[where[i:j]].T.ravel())]
    schema = _arrow(_SUMS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _answer_group(shard: pa.Table, sums: pa.Table) -> pa.Table:
    """A group's blocks and the sums of its keys to the answers to its blocks."""
    found = sums.to_pylist()[0]
    return _answers(shard.to_pylist(), {c: (np.frombuffer(found[c], "<u8"), _grown(found[n]).reshape(2, -1).T) for c, n in (("words", "word_sums"), ("pairs", "pair_sums"))})


def _distinct_words(texts: DataFrame) -> int:
    """How many distinct words binary texts have, by 64 bits of a digest; the boundary is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = {_EDGE}

        def emit() -> pa.RecordBatch:
            digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in known)
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(digests, "<i8"))], ["word"])

        for batch in batches:
            for text in batch.column(0):
                known.update((text.as_py() or b"").lower().split())
            if len(known) > _FLUSH:
                yield emit()
        yield emit()

    return texts.mapInArrow(run, "word long").distinct().count()


def score_whole(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT, alpha: float = ALPHA, group: int = GROUP) -> DataFrame:
    """As score(), under the whole bigram models of docs (the background) and of target, which has one text column."""
    background = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    aimed = target.select(F.lit(None).cast("long").alias("id"), F.col(target.columns[0]).cast("string").cast("binary").alias("text"))
    tokens = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)) + 1
    sized = [d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0))).first() for d in (background, aimed)]
    shards, total = 1 + sum(chars for chars, _ in sized) // SHARD_CHARS, np.array([n for _, n in sized], float)
    size = _distinct_words(background.select("text").unionByName(aimed.select("text"))) + 1  # and the unknown word
    rows = _blocks(background, shards, 0).unionByName(_blocks(aimed, shards, 1))
    many = 1 + int(total.sum()) // BLOCK // group
    if many == 1:
        answers = rows.groupBy("shard").applyInArrow(_sum_shard, _ANSWER)
    else:
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(many)))
        sums = dealt.groupBy("shard", "group").applyInArrow(_sum_group, _SUMS).groupBy("shard").applyInArrow(_sum_groups, _SUMS)
        answers = dealt.groupBy("shard", "group").cogroup(sums.groupBy("shard", "group")).applyInArrow(_answer_group, _ANSWER)
    names = ["doc_id", "n_tokens", "ce_target", "ce_background", "score"]

    def judge(block: pa.Table) -> pa.Table:
        parts = sorted(block.to_pylist(), key=lambda r: (r["ids"] is None, r["shard"]))
        own, found = parts[0], parts[1:]  # from every shard that the block has keys of
        lengths, tokens = _grown(own["lengths"]), _grown(own["tokens"])
        counts = []
        for column, shard in (("words", _grown(own["words"])), ("pairs", _grown(own["pair_shards"]))):
            sums = np.empty((len(shard), 2))
            sums[np.argsort(shard, kind="stable")] = np.concatenate([_grown(r[column]).reshape(2, -1).T for r in found])
            counts.append(sums)
        words, pairs = counts
        before, after = (x[_token_pairs(tokens, lengths)] for x in (tokens[:-1], tokens[1:]))
        keys, where = np.unique(before * len(words) + after, return_inverse=True)
        context = words[keys // len(words)]
        p = weight * pairs / np.maximum(context, 1) + np.where(context > 0, 1 - weight, 1.0) * (words[keys % len(words)] + alpha) / (total + alpha * size)
        ends = np.cumsum(lengths)
        mean = np.add.reduceat(-np.log(p)[where], ends - lengths, axis=0) / lengths[:, None]
        return pa.table([pa.array(own["ids"], pa.int64()), pa.array(lengths), pa.array(mean[:, 1]), pa.array(mean[:, 0]), pa.array(mean[:, 1] - mean[:, 0])], names)

    scored = answers.groupBy("block").applyInArrow(judge, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
    return scored.withColumnRenamed("doc_id", id_col)
