"""Removal of byte strings that also start earlier in the corpus, by suffix sorting.

A byte goes if it lies in a string of LENGTH bytes that also starts at an earlier place (smaller id, or the
same document further ahead). Places are judged on the input.

1. Anchors. Every window of LENGTH bytes has an anchor, its gram of GRAM bytes with the smallest hash (the
   first of equals); consecutive windows with one anchor are a run, and the run's bytes are its fragment.
   Equal windows have equal anchors at the same place, so only fragments with one anchor can share windows.
2. Classes. Equal fragments (by 48 bits of the anchor's hash and 64 bits of XXH3 over the fragment's bytes, a function of
   its own) are a class: all but its first fragment are repeats. Each map task settles its own classes and sends one row for each; a shuffle by
   anchor, read in sorted order row by row, settles the rest. Anchors with one class need no text.
3. Suffix sorting. The first fragments of the other classes, a few percent, are cut from the texts, the
   gram replaced by one symbol. Those of an anchor meet (those of a very frequent one in blocks of about LIMIT
   rows), are joined to one text and suffix sorted by linear grouping (see suffix.py). Equal windows are
   neighbours in the suffix array; all but the earliest are repeats.
4. Very frequent anchors: the earliest windows of their blocks are merged by a grouped minimum of digests.
5. The repeated windows of a document are joined to its text, which is then cut.

No group of copies needs one task: tasks send one of each kind, sorted rows are read with a constant state,
and blocks bound what is sorted at once. The texts are shuffled once: both joins use the same exchange.
Null text counts as empty. If ids repeat or are null, rows are first put in an order of their own: by id (null
last), then text; equal rows come one after the other. An empty table gives no rows. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .suffix import suffix_array

LENGTH = 100
GRAM = 48
LIMIT = 2000
_GRAMS = LENGTH - GRAM + 1  # grams in a window; also the symbols of a window once its gram is one symbol
_CHUNK = 1 << 23
_SORT = 1 << 15
_PLACE = np.uint64((1 << 24) - 1)
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of every GRAM bytes, put together from hashes of doubling lengths."""
    count = len(data) - GRAM + 1
    part, size, at, out = _SEEDS[data], 1, 0, None
    while size <= GRAM:
        if GRAM & size:
            piece = part[at : at + count]
            out = piece if out is None else _mix(out * np.uint64(0x5851F42D4C957F2D) + piece)
            at += size
        if 2 * size <= GRAM:
            part = _mix(part[:-size] * np.uint64(0x27BB2EE687B0B0FD) + part[size:])
        size *= 2
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (48 bits), fragment digest and place of the runs of a text; place is first window << 12 | windows << 6 |
    bytes from the first window to the gram."""
    found = []
    for start in range(0, len(data) - LENGTH + 1, _CHUNK):
        chunk = data[start : start + _CHUNK + LENGTH - 1]
        grams = _hashes(chunk)
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= _GRAMS:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        n = len(grams) - _GRAMS + 1
        low = np.minimum(low[:n], low[_GRAMS - size : _GRAMS - size + n])
        at = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        windows = np.diff(np.append(first, n))
        shape = windows << 6 | (at[first] - first)
        raw, hashed = chunk.tobytes(), xxhash.xxh3_64_intdigest
        digest = np.array([hashed(raw[i:j], k) for i, j, k in zip(first.tolist(), (first + windows - 1 + LENGTH).tolist(), shape.tolist())], np.uint64)
        found.append(((grams[at[first]] >> np.uint64(16)).view(np.int64), digest.view(np.int64), (first + start) << 12 | shape))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _ends(places: np.ndarray) -> np.ndarray:
    return (places >> 12) + (places >> 6 & 63)


def _joined(keys: np.ndarray, firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of (key, first); those that follow on each other become one."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (firsts[1:] != ends[:-1])
    at = np.flatnonzero(new)
    return keys[at], firsts[at], ends[np.append(at[1:], len(keys)) - 1] if len(keys) else ends


_COLUMNS = ["anchor", "digest", "key", "place", "end"]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (anchor, digest, key, place, 0) of the first fragment of each class in a batch, and to spans of repeats
    (a number of their own, 0, key, first, end)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        found = [anchors(_bytes(batch.column(1)[int(i)])) for i in order]
        keys = np.repeat(ids[order], [len(x[0]) for x in found]).astype(np.int64)
        anchor, digest, place = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
        kind = _mix(anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + digest.view(np.uint64))
        _, first, where = np.unique(kind, return_index=True, return_inverse=True)
        head = first[where]
        repeat = (head != np.arange(len(kind))) & (anchor == anchor[head]) & (digest == digest[head])
        k, f, e = _joined(keys[repeat], place[repeat] >> 12, _ends(place[repeat]))
        own = (_mix(k.view(np.uint64) * np.uint64(31) + f.view(np.uint64)) >> np.uint64(16)).view(np.int64)
        zero = np.zeros(len(k), np.int64)
        rest = ~repeat
        rows = ((anchor[rest], own), (digest[rest], zero), (keys[rest], k), (place[rest], f), (np.zeros(int(rest.sum()), np.int64), e))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], _COLUMNS)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, digest, key, place) to spans of repeats (0, key, first, end) and to the first fragments of
    anchors with more than one class (anchor, key, place, 0). Only the last row and the last class are kept in mind."""
    last, held = None, (np.zeros((3, 0), np.int64), False)
    for batch in batches:
        anchor, digest, key, place, end = (c.to_numpy() for c in batch.columns)
        spans = end > 0
        span = [key[spans], place[spans], end[spans]]
        anchor, digest, key, place = (x[~spans] for x in (anchor, digest, key, place))
        new = np.ones(len(anchor), bool)
        if len(anchor):
            new[1:] = (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])
            new[0] = last != (anchor[0], digest[0])
            last = (anchor[-1], digest[-1])
        span = [np.concatenate(x) for x in zip(span, (key[~new], place[~new] >> 12, _ends(place[~new])))]
        rows = np.concatenate([held[0], np.stack([anchor[new], key[new], place[new]])], 1)
        many = np.zeros(rows.shape[1], bool)
        many[: held[0].shape[1]] = held[1]
        same = rows[0, 1:] == rows[0, :-1]
        many[1:] |= same
        many[:-1] |= same
        out = rows[:, :-1][:, many[:-1]]
        held = rows[:, -1:], bool(many[-1]) if len(many) else False
        yield _mixed(out, span)
    if held[1]:
        yield _mixed(held[0], [np.zeros(0, np.int64)] * 3)


def _mixed(rows: np.ndarray, span: list[np.ndarray]) -> pa.RecordBatch:
    zero = np.zeros(len(span[0]), np.int64)
    columns = ((rows[0], zero), (rows[1], span[0]), (rows[2], span[1]), (np.zeros(rows.shape[1], np.int64), span[2]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["anchor", "key", "place", "end"])


def _cut_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, places, anchors) to (anchor, key, place, bytes); texts without places give nothing."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for key, text, places, found in zip(*batch.columns):
            if not places.is_valid:
                continue
            data = _bytes(text).tobytes()
            for place, h in zip(places.as_py(), found.as_py()):
                first, windows, gap = place >> 12, place >> 6 & 63, place & 63
                for column, value in zip(out, (h, key.as_py(), place, data[first : first + gap] + data[first + gap + GRAM : first + windows - 1 + LENGTH])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "key", "place", "bytes"])


def _sorted_windows(rows: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments (group, key, place, bytes) to their windows: fragment number, window number, and a number of equal windows."""
    text: list[int] = []
    owner, window = [], []
    for no, (group, _, place, data) in enumerate(rows):
        windows, gap = place >> 6 & 63, place & 63
        symbols = [b + 2 for b in data]
        text += [*symbols[:gap], 258 + group, *symbols[gap:], 1]
        length = len(data) + 2
        owner += [no] * length
        window += [*range(windows), *[-1] * (length - windows)]
    text.append(0)
    order = np.array(suffix_array(text), np.int64)
    window.append(-1)
    owner.append(-1)
    window, owner = np.array(window), np.array(owner)
    order = order[window[order] >= 0]
    padded = np.array(text + [0] * _GRAMS, np.int32)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 1 << 14):
        a, b = order[at - 1 : at - 1 + (1 << 14)], order[at : at + (1 << 14)]
        reach = np.arange(_GRAMS)
        new[at : at + len(b)] = (padded[a[: len(b), None] + reach] != padded[b[:, None] + reach]).any(1)
    return owner[order], window[order], np.cumsum(new)


def _repeats(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, bool]]:
    """(fragment number, window number, is the earliest) of the windows of fragments that are compared."""
    owner, window, equal = _sorted_windows(rows)
    keys = np.array([r[1] for r in rows])[owner]
    starts = np.array([r[2] >> 12 for r in rows])[owner] + window
    order = np.lexsort((starts, keys, equal))
    first = np.zeros(len(order), bool)
    first[order] = np.diff(equal[order], prepend=-1) != 0
    return owner, window, first


def _resolve(hot: bool):
    """Fragments in order of (anchor, block), as (anchor, block, key, place, bytes), to repeated windows (key, first, end);
    hot: to the windows that are the earliest of their block, as (key, first, digest)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            held.append(rows)
            if sum(map(len, held)) * 80 > _SORT:
                joined = pd.concat(held, ignore_index=True)
                last = joined.iloc[-1]
                tail = (joined["anchor"] == last["anchor"]) & (joined["block"] == last["block"])
                yield from solve(joined[~tail])
                held = [joined[tail]]
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.reset_index(drop=True)
        group = rows.groupby(["anchor", "block"], sort=False).ngroup().to_numpy() if len(rows) else np.zeros(0, np.int64)
        first_window = rows["place"].to_numpy(np.int64) >> 12
        at = 0
        while at < len(rows):  # whole groups, about _SORT symbols
            end = at + int(np.searchsorted(group[at:], group[min(len(rows) - 1, at + _SORT // 80)], "right"))
            part = rows.iloc[at:end]
            items = list(zip((group[at:end] - group[at]).tolist(), part["key"].tolist(), part["place"].tolist(), part["bytes"].tolist()))
            owner, window, first = _repeats(items)
            keys, starts = part["key"].to_numpy()[owner], first_window[at:end][owner] + window
            if hot:
                hashes = part["anchor"].tolist()
                yield pd.DataFrame({"key": keys[first], "first": starts[first], "digest": [_digest(hashes[o], items[o], w) for o, w in zip(owner[first].tolist(), window[first].tolist())]})
            else:
                order = np.lexsort((starts[~first], keys[~first]))
                k, f = keys[~first][order], starts[~first][order]
                yield pd.DataFrame(dict(zip(("key", "first", "end"), _joined(k, f, f + 1))))
            at = end

    return run


def _digest(hash_: int, item: tuple[int, int, int, bytes], window: int) -> bytes:
    gap, data = item[2] & 63, item[3]
    return hashlib.blake2b(data[window : window + _GRAMS - 1], digest_size=16, key=f"{hash_}:{gap - window}".encode()).digest()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, firsts, ends) to the figures of the contract."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for text, firsts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
            data = _bytes(text)
            steps = np.zeros(len(data) + 1, np.int64)
            if firsts.is_valid:
                np.add.at(steps, firsts.values.to_numpy(), 1)
                np.add.at(steps, ends.values.to_numpy() - 1 + LENGTH, -1)
            gone = np.cumsum(steps[:-1]) > 0
            values = (len(data), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), data[~gone].tobytes())
            for column, value in zip(out, values):
                column.append(value)
        kept = [hashlib.sha256(k).hexdigest() for k in out[3]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(kept, pa.string()), pa.array(out[3], pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text), the key ordering the rows and theirs alone; and the ids of keys, where they aren't the ids themselves."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    odd = docs.groupBy(F.col(f"`{id_col}`").alias("id")).count().where("count > 1 OR id IS NULL")
    if odd.isEmpty():
        return rows, None
    ordered = materialise(rows.orderBy(F.col("key").asc_nulls_last(), "text").select(F.monotonically_increasing_id().alias("n"), "key", "text"))
    return ordered.select(F.col("n").alias("key"), "text"), ordered.select(F.col("n").alias("key"), F.col("key").alias("id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left."""
    rows, ids = _keyed(docs, id_col, text_col)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.mapInArrow(_find_anchors, "anchor long, digest long, key long, place long, end long")
    found = found.repartition("anchor").sortWithinPartitions("anchor", "digest", "key", "place")
    settled = materialise(found.mapInArrow(_settle, "anchor long, key long, place long, end long"))
    unsettled = settled.where("end = 0")
    frequent = unsettled.groupBy("anchor").count().where(F.col("count") > limit)
    frequent = materialise(frequent.select("anchor", F.ceil(F.col("count") / limit).cast("int").alias("blocks")))
    held = unsettled.groupBy("key").agg(F.collect_list("place").alias("places"), F.collect_list("anchor").alias("anchors"))
    # a left join, as below, so that both have the same exchange of the texts
    fragments = rows.join(held, "key", "left").select("key", "text", "places", "anchors")
    fragments = fragments.mapInArrow(_cut_fragments, "anchor long, key long, place long, bytes binary")

    def resolved(part: DataFrame, hot: bool, schema: str) -> DataFrame:
        # few bytes but much work: as many tasks as any shuffle, not as few as their size would do with
        part = part.select("anchor", "block", "key", "place", "bytes").repartition(tasks, "anchor", "block").sortWithinPartitions("anchor", "block")
        return part.mapInPandas(_resolve(hot), schema)

    repeats = settled.where("end > 0").select("key", F.col("place").alias("first"), "end")
    if frequent.isEmpty():
        fragments = fragments.withColumn("block", F.lit(0))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        fragments = fragments.join(frequent, "anchor", "left").withColumn("block", F.pmod(F.xxhash64("key", "place"), blocks))
        left = resolved(fragments.where("blocks > 1"), True, "key long, first long, digest binary")
        earliest = left.groupBy("digest").agg(F.min(F.struct("key", "first")).alias("e"))
        late = left.join(earliest, "digest").where((F.col("e.key") != F.col("key")) | (F.col("e.first") != F.col("first")))
        repeats = repeats.unionByName(late.select("key", "first", (F.col("first") + 1).alias("end")))
    repeats = repeats.unionByName(resolved(fragments, False, "key long, first long, end long"))
    spans = repeats.groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends"))
    joined = rows.join(spans, "key", "left").select("key", "text", "firsts", "ends")
    out = joined.mapInArrow(_cut, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("key", "id") if ids is None else out.join(ids, "key").drop("key")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
