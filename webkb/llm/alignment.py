"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often corpus-wide.

Each text is encoded twice, by a byte-level BPE (A, over a space and the text) and by a piece model (B, which adds that space
itself). Both token lists are ascending lists of byte ends. The shorter one drives a galloping search through the longer: from
the place of an earlier end, steps of doubled width bracket an end, bisection settles it. Ends that both lists have cut the text
into groups; the differences of neighbouring ranks are the ranges of tokens whose bytes overlap, so links are read off the ranks.
The search runs for many ends at once: every 8^k-th end first, each then the starting place of the seven after it, a level at a
time; documents of a slice stand one after the other in it, as their last bytes are common ends.

Corpus-wide counts of id pairs are no table on any one machine. A task gathers its documents in blocks of about BLOCK_LINKS links; a block
has a list of its distinct pairs, and documents keep places in that list. The lists are summed by pair, the pairs' totals are joined
back to the lists (one row for each pair and block), and each block's documents meet their list again. The best count of a B id is a table with
at most as many rows as B has ids, so it may be broadcast.

Null and empty texts, and texts whose tokens don't give back their bytes (characters that a vocabulary replaces), have no tokens:
all counts zero, digest ''. Rows that repeat a doc_id, or have none, stay rows of their own. Very long texts are one slice and one block
of their own; a run of over LONG characters without a break takes the library whose time stays in proportion. An empty table gives
no rows. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
BLOCK_LINKS = 4_000_000
SLICE = 1_000_000  # characters that are aligned at once
LONG = 2000
STRIDE = 8
PIECE_BITS = 15  # of a B id; with 16 for A, a pair is a positive int
LIST_ROW = 1 << 16


class Encoders:
    """Ids of both vocabularies and the bytes of each id."""

    def __init__(self, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(f"{byte_vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json, self.slow = public_tokenizers.path(f"{byte_vocabulary}.json"), None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{piece_vocabulary}.model"))
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        self.bytes_b = [self._piece(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        if len(self.bytes_a) > 1 << 16 or len(self.bytes_b) > 1 << PIECE_BITS:
            raise ValueError("vocabularies are larger than a pair of ids holds")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def _encode_a(self, line: str) -> np.ndarray:
        if max(map(len, line.split()), default=0) < LONG and not re.search(rf"\s{{{LONG}}}", line):
            return self.fast.encode_to_numpy(line)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(line, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by A and B; none where the bytes of either aren't the text's."""
        none, found = np.zeros(0, np.int64), []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else []):
            line = " " + text
            a, raw = self._encode_a(line).tolist(), line.encode("utf-8", "surrogatepass")
            whole = text and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            found.append((np.array(a, np.int64), np.array(b, np.int64)) if whole else (none, none))
        return found


def gallop(short: np.ndarray, long: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Rank in long of each of short: the first place whose value is not smaller. Both ascend strictly, long ends as short does."""
    rank, width = np.zeros(len(short), np.int64), 1
    while width * stride < len(short):
        width *= stride
    top = width
    while width:
        lanes = np.arange(0, len(short), width)
        if width < top:
            lanes = lanes[lanes % (width * stride) != 0]
        wanted = short[lanes]
        low = rank[lanes - lanes % (width * stride)] if width < top else np.zeros(len(lanes), np.int64)
        high, step = low.copy(), 1
        ahead = np.flatnonzero(long[high] < wanted)
        while len(ahead):
            low[ahead] = high[ahead] + 1
            high[ahead] = np.minimum(high[ahead] + step, len(long) - 1)
            step *= 2
            ahead = ahead[long[high[ahead]] < wanted[ahead]]
        ahead = np.flatnonzero(low < high)
        while len(ahead):
            middle = (low[ahead] + high[ahead]) >> 1
            less = long[middle] < wanted[ahead]
            low[ahead[less]] = middle[less] + 1
            high[ahead[~less]] = middle[~less]
            ahead = ahead[low[ahead] < high[ahead]]
        rank[lanes] = low
        width //= stride
    return rank


class Aligned:
    """The alignment of one text, or of several that stand one after the other, from the sizes of their tokens in bytes.

    common_a, common_b: places of the tokens that end a group. link_a, link_b: places of all pairs of tokens that overlap.
    """

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray):
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        swapped = len(ends_b) < len(ends_a)
        short, long = (ends_b, ends_a) if swapped else (ends_a, ends_b)
        rank = gallop(short, long)
        same = long[rank] == short
        first = np.concatenate(([0], rank[:-1] + same[:-1]))
        width = rank - first + 1
        driver = np.repeat(np.arange(len(short)), width)
        other = np.arange(len(driver)) - np.repeat(np.cumsum(width) - width - first, width)
        common, met = np.flatnonzero(same), rank[same]
        self.common_a, self.common_b = (met, common) if swapped else (common, met)
        self.link_a, self.link_b = (other, driver) if swapped else (driver, other)


def _lines(ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned, last: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Strings, in the order of the text, that join to `a1,a2|b1;a3|b2,b3`. last: groups that end a document. names: by (what follows, id)."""
    size = len(names) // 4
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    for ids, ends, others, after in ((ids_a, found.common_a, np.concatenate(([0], found.common_b[:-1] + 1)), 1), (ids_b, found.common_b, found.common_a + 1, 2)):
        sep = np.zeros(len(ids), np.int64)
        sep[ends] = after
        group = np.cumsum(sep > 0) - (sep > 0)
        if after == 2:
            sep[ends[last]] = 3
        out[np.arange(len(ids)) + others[group]] = sep * size + ids
    return names[out]


def _names(size: int) -> np.ndarray:
    return np.array([f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(size)], object)


def _squeezed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each, in bytes: gaps and times by byte planes, compressed."""
    planes = np.concatenate((np.diff(places, prepend=-1) - 1, times - 1)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _unsqueezed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T
    values = np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)
    half = len(values) // 2
    return np.cumsum(values[:half] + 1) - 1, values[half:] + 1


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PART = f"block long, doc_id long, {_COUNTS}, places binary, pairs array<int>, times array<long>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys.append(key)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


def _parts(docs: DataFrame, block_links: int, slice_encoders: tuple[str, str]) -> DataFrame:
    """Documents with places in their block's list of pairs (places), and the lists, in rows of LIST_ROW (pairs, times)."""

    def block_rows(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs, place = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
        times = np.bincount(place, np.concatenate([h[7] for h in held]), len(pairs)).astype(np.int64)
        at, rows = 0, []
        for *head, own, often in held:
            rows.append((number, *head, _squeezed(place[at : at + len(own)], often), None, None))
            at += len(own)
        for k in range(0, len(pairs), LIST_ROW):
            rows.append((number, *[None] * 7, pairs[k : k + LIST_ROW].astype(np.int32), times[k : k + LIST_ROW]))
        kinds = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in _PART.split(", ")]
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096]), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoders(*slice_encoders)
        names = _names(max(len(encode.bytes_a), len(encode.bytes_b)))
        number, held, links = TaskContext.get().partitionId() << 32, [], 0
        none = np.zeros(0, np.int32)
        for keys, texts in _slices(batches):
            ids = encode(texts)
            live = [k for k, (a, _) in enumerate(ids) if len(a)]
            rows = {}
            if live:
                ids_a, ids_b = (np.concatenate([ids[k][side] for k in live]) for side in (0, 1))
                ends = [np.cumsum([len(ids[k][side]) for k in live]) for side in (0, 1)]
                found = Aligned(encode.sizes_a[ids_a], encode.sizes_b[ids_b])
                groups = np.searchsorted(found.common_a, ends[0])  # of the documents up to each
                lines = _lines(ids_a, ids_b, found, groups - 1, names)
                owner = np.searchsorted(ends[0], found.link_a, "right")
                many = np.bincount(owner, minlength=len(live))
                pair = (owner << (PIECE_BITS + 16)) | (ids_a[found.link_a] << PIECE_BITS) | ids_b[found.link_b]
                pair, often = np.unique(pair, return_counts=True)
                cut = np.searchsorted(pair >> (PIECE_BITS + 16), np.arange(len(live) + 1))
                pair, often = (pair & ((1 << (PIECE_BITS + 16)) - 1)).astype(np.int32), often.astype(np.int32)
                before = (0, 0, 0)
                for n, k in enumerate(live):
                    now = (int(ends[0][n]), int(ends[1][n]), int(groups[n]))
                    text = "".join(lines[before[0] + before[1] : now[0] + now[1]].tolist())
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    rows[k] = (*(x - y for x, y in zip(now, before)), int(many[n]), digest, pair[cut[n] : cut[n + 1]], often[cut[n] : cut[n + 1]])
                    before = now
                links += len(pair)
            held += [(key, *rows.get(k, (0, 0, 0, 0, "", none, none))) for k, key in enumerate(keys)]
            if links >= block_links:
                yield from block_rows(number, held)
                number, held, links = number + 1, [], 0
        if held:
            yield from block_rows(number, held)

    return docs.mapInArrow(run, _PART)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_links: int = BLOCK_LINKS,
    byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
) -> DataFrame:
    """One row for each document: n_a, n_b, n_groups, n_links, n_best (links whose pair is the B id's most frequent), count_sum
    (corpus-wide counts over its links) and groups_sha256."""
    parts = materialise(_parts(_texts(docs, id_col, text_col), block_links, (byte_vocabulary, piece_vocabulary)))
    own = parts.where("places IS NOT NULL").select("block", "doc_id", *[x.split()[0] for x in _COUNTS.split(", ")], "places")
    lists = parts.where("pairs IS NOT NULL").select("block", F.inline(F.arrays_zip("pairs", "times")))
    piece = F.col("pairs").bitwiseAND(F.lit((1 << PIECE_BITS) - 1))
    totals = materialise(lists.groupBy("pairs").agg(F.sum("times").alias("total")))
    highest = totals.groupBy(piece.alias("piece")).agg(F.max("total").alias("highest"))  # a row for each B id at most
    judged = totals.withColumn("piece", piece).join(F.broadcast(highest), "piece").select("pairs", "total", (F.col("total") == F.col("highest")).alias("best"))
    looked = lists.select(F.col("block").alias("list"), "pairs").join(judged, "pairs").select("list", "pairs", "total", "best")
    head = [x.split()[0] for x in _COUNTS.split(", ")]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pairs").to_numpy())
        total, best = right.column("total").to_numpy()[order], right.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for data in left.column("places"):
            place, often = _unsqueezed(data.as_py())
            n_best.append(int(often[best[place]].sum()))
            count_sum.append(int((often * total[place]).sum()))
        return pa.table({"doc_id": left.column("doc_id"), **{c: left.column(c) for c in head}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})

    met = own.groupBy("block").cogroup(looked.groupBy("list")).applyInArrow(meet, f"doc_id long, {_COUNTS}, n_best long, count_sum long")
    return met.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """The groups themselves: doc_id, group (from 0), start and end (bytes of a space and the text), ids_a and ids_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoders(byte_vocabulary, piece_vocabulary)
        for keys, texts in _slices(batches):
            for key, (a, b) in zip(keys, encode(texts)):
                if len(a):
                    found = Aligned(encode.sizes_a[a], encode.sizes_b[b])
                    ends = np.cumsum(encode.sizes_a[a])[found.common_a]
                    columns = [[key] * len(ends), range(len(ends)), np.concatenate(([0], ends[:-1])), ends, np.split(a, found.common_a[:-1] + 1), np.split(b, found.common_b[:-1] + 1)]
                    kinds = [*[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "group", "start", "end", "ids_a", "ids_b"])

    found = _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, group long, start long, end long, ids_a array<int>, ids_b array<int>")
    return found.withColumnRenamed("doc_id", id_col)
