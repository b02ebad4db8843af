"""Best-fit packing of documents into sequences, in rounds over length classes.

Documents become token pieces of at most `capacity`. Pieces and gaps (open sequences) are held in the
order of their length; lengths are whole numbers up to the capacity, so a sorted run is a class (length)
and a rank in it. One round takes the longest class that is left: a sweep over the gaps from the smallest
that is large enough gives every piece its successor, ranks decide which piece of the class takes which
gap, and the gaps shrink before the next round. With one class a round this equals best fit decreasing.

The rounds work on run lengths: at most `capacity` classes of pieces and of gaps, whatever the number of
documents. That is all the driver holds: a histogram with at most `capacity` rows in, and runs (class,
first rank, first sequence, count) out. The rows themselves are ranked by Spark: a window over
(length, hash bucket) with the buckets' counts as offsets, so that a class with a third of all
rows is many tasks. Each row then finds its run by binary search.

The rounds are a loop on the driver, not distributed sweeps; see the README for the form that was tried and its figures.

A full piece fills a sequence of its own. Null text is one end token. Rows that repeat a doc_id are
packed as rows of their own, null ids too; extra columns are left alone, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
BUCKET_ROWS = 50_000
BUCKETS = 256


class Encoder:
    """Ids of the public byte-level BPE. The ranks file gives the ids of the JSON file, several times faster;
    texts with a run of over LONG characters without a break take the JSON file's own library, whose time stays
    in proportion there."""

    LONG = 2000

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.json = public_tokenizers.path(f"{vocabulary}.json")
        self.long = re.compile(rf"\S{{{self.LONG}}}|\s{{{self.LONG}}}")
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if not self.long.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece; a long document's short piece comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for no, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for column, value in zip(columns, (key.as_py(), no, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of the packing, rows (length, first rank, first sequence, pieces in a sequence, first offset), sorted.

    counts: pieces by length. Piece r of a run from rank a stands in sequence `first + (r - a) // k`, as number (r - a) % k there.
    """
    gaps: dict[int, deque] = defaultdict(deque)
    open_gaps: list[int] = []
    runs, made = [], 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, count = gaps[gap].popleft()
            else:
                gap, first = capacity, made
                count = -(-left // (capacity // length))
                made += count
            k = gap // length
            whole = min(count, left // k)
            part = left - whole * k if whole < count else 0
            runs.append((length, rank, first, k, capacity - gap))
            if gap < capacity and count > whole + (part > 0):
                gaps[gap].appendleft((first + whole + (part > 0), count - whole - (part > 0)))
            if gap < capacity and not gaps[gap]:
                open_gaps.pop(at)
            put(gap - k * length, first, whole)
            if part:
                put(gap - part * length, first + whole, 1)
            rank, left = rank + whole * k + part, left - whole * k - part
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with rank, their place among the rows of one length; no task holds a whole length."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    counts = counts.select("length", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row"))
    return rows.withColumn("place", place).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = materialise(pieces(docs, id_col, text_col, capacity, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    full, short = rows.where(F.col("length") == capacity), rows.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # fewer rows than capacity
    runs = best_fit(counts, capacity)
    keys = (runs[:, 0] << 44) | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column(5).to_numpy(), batch.column(3).to_numpy()
            run = runs[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            since = rank - run[:, 1]
            sequence, offset = run[:, 2] + since // run[:, 3], run[:, 4] + since % run[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    buckets = max(BUCKETS, -(-sum(counts.values()) // BUCKET_ROWS))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked(short, buckets).select(*columns, "rank").mapInArrow(place, schema)
    alone = full.select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).withColumnRenamed("doc_id", id_col)
