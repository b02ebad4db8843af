"""Chroma audio fingerprints of media columns, and recordings aligned by them.

A recording is a binary column of 16-bit PCM. Short frames give the energy of the 12 pitch classes; filters
over rectangles of (frames x pitch classes), read from an integral image, are quantised to two bits each and
packed into one 32-bit integer a frame. Beside it stand the frame's doubts: the bits whose filters came nearest to a limit of
quantisation, least certain first. Recordings with equal integers throughout are one class; only class representatives are compared.

Alignments are found by offsets. Each integer is a posting, also with every subset of its doubtful bits flipped
(QUERY_DOUBTS bits for queries, DOUBTS for the others); two frames that meet are a vote for the offset between them. Every offset at which postings meet
and whose overlap is LEAST_OVERLAP frames or more is checked whole: LEAST_VOTES votes at least, and at most MOST_ERRORS of the overlap's bits may differ. Shorter overlaps are not
alignments: of recordings of chance none agreed on more than 18 frames. All that is reported is exact; what is missed is an alignment with fewer than
LEAST_VOTES frames that differ in doubtful bits only: of noisy copies cut and shifted within a frame, with up to MOST_ERRORS, less than a tenth (tested).
Of a pair's offsets the one with most votes is reported, then the one with fewest bit errors, then the nearest.

Queries are the recordings whose id is divisible by QUERY_STEP, against all. Postings grow with the recordings; only frames that meet make pairs. Frames of unlike recordings meet by chance,
and these meetings grow with queries times classes; they are counted, and offsets of a single vote go before any are checked. For tables where that is too much there is narrow, which leaves work out and is
not the default: a posting's key then also holds the last bits of the integer NEXT frames on (none up to SPARSE classes, then WIDER bits for each doubling, MOST_WIDE at most) and an offset needs one vote with
these bits equal. From FLIPPED_NEXT bits a query's NEXT_DOUBTS least certain ones among them are flipped too.
Null audio, or audio too short for LEAST_OVERLAP integers, has no matches. Integers without doubts meet where they are equal. Rows that repeat an id are recordings of their own;
if the id is its class's, each of them shows the best match. Null ids are no queries, and a class without any id is not compared, as nothing could name it. Extra
columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RATE = 4000
FRAME = 512
HOP = 256
FILTERS = 16
SPAN = 16
QUANTS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint64)
QUERY_STEP = 50
MOST_ERRORS = 0.25
LEAST_OVERLAP = 24
LEAST_VOTES = 2
QUERY_DOUBTS, DOUBTS = 8, 3  # bits flipped in queries' integers and in the others'
NEXT = 4
SPARSE, WIDER, MOST_WIDE = 2048, 1.7, 16  # neighbours' bits agree by chance more often than every second time
FLIPPED_NEXT, NEXT_DOUBTS = 9, 2
ROWS = 256  # recordings held at once
FRAMES = 4096  # and frames filtered at once
_LOW, _HIGH = 110.0, 1760.0
_NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _pitch_classes(rate: int) -> np.ndarray:
    """FRAME/2+1 by 12: the pitch class of each frequency; what is outside the range counts nowhere."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), 12))
    inside = (hz >= _LOW) & (hz <= _HIGH)
    out[np.flatnonzero(inside), np.round(12 * np.log2(hz[inside] / _LOW)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by 12 pitch classes, each frame scaled to length one."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) @ _pitch_classes(rate)
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9)


def _rectangles() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """Filter i compares two areas of (time from, to, pitch from, to): halves in time, halves in pitch, a checker board,
    or a middle band with its surroundings; widths and places follow from i."""
    out = []
    for i in range(FILTERS):
        width, low = SPAN // 4 * (1 + i // 4), (5 * i) % 12
        height, half = 4 + 2 * (i % 3), SPAN // 8 * (1 + i // 4)
        mid, high = low + height // 2, low + height
        shapes = (
            ([(0, half, low, high)], [(half, width, low, high)]),
            ([(0, width, low, mid)], [(0, width, mid, high)]),
            ([(0, half, low, mid), (half, width, mid, high)], [(0, half, mid, high), (half, width, low, mid)]),
            ([(0, width, low + 1, high - 1)], [(0, width, low, low + 1), (0, width, high - 1, high)]),
        )
        out.append(shapes[i % 4])
    return out


def _corners() -> np.ndarray:
    """What a filter's two sides take from the (SPAN + 1) x 25 corners of the integral image after a frame: a column for each side."""
    out = np.zeros((SPAN + 1, 25, 2 * FILTERS))
    for i, sides in enumerate(_rectangles()):
        for side, areas in enumerate(sides):
            for t0, t1, p0, p1 in areas:
                for t, p, sign in ((t1, p1, 1), (t0, p1, -1), (t1, p0, -1), (t0, p0, 1)):
                    out[t, p, 2 * i + side] += sign
    return out.reshape(-1, 2 * FILTERS)


def doubtful(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(integers, doubts): one packed integer for each frame from which SPAN frames follow, and the places of its QUERY_DOUBTS least certain
    bits, least certain first, five bits each. Neighbours in the Gray code differ in one bit, so a filter has one bit that may flip."""
    image = chroma(samples, rate)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.concatenate([image, image], 1).cumsum(0).cumsum(1)
    limits, shifts, packed, doubts = np.array(QUANTS), 2 * np.arange(FILTERS)[::-1], [], []
    for at in range(0, n, FRAMES):
        part = np.lib.stride_tricks.sliding_window_view(total[at : at + FRAMES + SPAN], SPAN + 1, axis=0).transpose(0, 2, 1)
        sums = (part - part[:, :1]).reshape(len(part), -1) @ _CORNERS  # counted from the window's first row, so that long recordings lose no digits
        ratio = np.log1p(sums[:, ::2]) - np.log1p(sums[:, 1::2])
        packed.append((GRAY[np.searchsorted(limits, ratio)].astype(np.int64) << shifts).sum(1))
        far = np.abs(ratio[:, :, None] - limits)
        nearest = far.argmin(2)
        places = shifts + (GRAY[nearest] ^ GRAY[nearest + 1] == 2)
        order = np.argsort(far.min(2), axis=1, kind="stable")[:, :QUERY_DOUBTS]
        doubts.append((np.take_along_axis(places, order, 1) << (5 * np.arange(QUERY_DOUBTS))).sum(1))
    return np.concatenate(packed), np.concatenate(doubts)


_CORNERS = _corners()


def integers(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    return doubtful(samples, rate)[0]


def pcm(audio: bytes) -> np.ndarray:
    """The samples of 16-bit PCM; half a sample at the end is left out."""
    return np.frombuffer(audio[: len(audio) // 2 * 2], "<i2")


def fingerprints(media: DataFrame, id_col: str, audio_col: str, rate: int = RATE, decode: Callable[[object], np.ndarray] = pcm) -> DataFrame:
    """id, integers and doubts, two arrays. decode makes samples of a cell: media of other forms need not pass through a column of PCM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            rows = [doubtful(decode(a.as_py()), rate) if a.is_valid else _NOTHING for a in batch.column(1)]
            ends = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
            columns = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[c] for r in rows]), pa.int64())) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "integers", "doubts"])

    rows = media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{audio_col}`").alias("audio"))
    return rows.mapInArrow(run, "id long, integers array<bigint>, doubts array<bigint>")


def masks(doubts: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` doubts of each frame as one bit mask."""
    return np.bitwise_or.reduce(1 << (doubts[:, None] >> 5 * np.arange(bits) & 31), axis=1) if bits else np.zeros(len(doubts), np.int64)


def _classes(prints: DataFrame, query_step: int) -> DataFrame:
    """integers, class_id (the smallest id that has them), its doubts, class_size and whether a query is among them."""
    doubts = F.col("doubts") if "doubts" in prints.columns else F.lit(None).cast("array<bigint>")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", doubts.alias("doubts")))).alias("first")
    queried = F.max(F.pmod("id", F.lit(query_step)) == 0).alias("queried")
    grouped = prints.groupBy("integers").agg(first, F.count(F.lit(1)).alias("class_size"), queried)
    return grouped.select("integers", F.col("first.id").alias("class_id"), F.col("first.doubts").alias("doubts"), "class_size", "queried")


def wide_bits(classes: int) -> int:
    """How many bits of a later frame the keys hold."""
    return min(MOST_WIDE, max(0, math.ceil(WIDER * math.log2(max(1, classes) / SPARSE))))


def _subsets(doubts: np.ndarray, bits: int) -> np.ndarray:
    """A row for each frame, of all subsets of its first `bits` doubts as masks."""
    out = np.zeros((len(doubts), 1), np.int64)
    for i in range(bits):
        out = np.concatenate([out, out | 1 << (doubts[:, None] >> 5 * i & 31)], 1)
    return out


def _postings(classes: DataFrame, bits: int, wide: int = 0, extra: int = 0) -> DataFrame:
    """class_id, frames (how many), place, key (the integer with a subset of `bits` doubtful bits flipped, above it the last `wide` bits of the one NEXT
    frames on, `extra` of its doubts flipped likewise), flipped (the subset) and unsure (all of them). With wide bits, frames without such a frame have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << wide) - 1
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            frames = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False) == frames) & (frames > 0)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(frames)), frames)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doubts = np.zeros(len(owner), np.int64)
            doubts[known[owner]] = batch.column(2).filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False)
            there = place + NEXT < frames[owner] if wide else np.ones(len(owner), bool)
            for some, k, more in ((known[owner] & there, bits, extra), (~known[owner] & there, 0, 0)):
                chosen = np.flatnonzero(some)
                for at in range(0, len(chosen), FRAMES):
                    rows = chosen[at : at + FRAMES]
                    flipped, unsure = _subsets(doubts[rows], k), masks(doubts[rows], k)
                    times = flipped.shape[1]
                    columns = [np.repeat(c, times) for c in (ids[owner[rows]], frames[owner[rows]], place[rows])]
                    columns += [(values[rows][:, None] ^ flipped).ravel(), flipped.ravel(), np.repeat(unsure, times)]
                    if not wide:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _POSTING)
                        continue
                    above = _subsets(doubts[rows + NEXT], more)
                    for change in above.T:
                        use = np.repeat(change & ~low == 0, times)  # bits that are not in the key are flipped in no key
                        high = np.repeat((values[rows + NEXT] ^ change) & low, times) << 2 * FILTERS
                        full = [*columns[:3], columns[3] | high, *columns[4:]]
                        yield pa.RecordBatch.from_arrays([pa.array(c[use], pa.int64()) for c in full], _POSTING)

    return classes.select("class_id", "integers", "doubts").mapInArrow(run, ", ".join(f"{c} long" for c in _POSTING))


_POSTING = ["class_id", "frames", "place", "key", "flipped", "unsure"]
_PAIRS = ["class_id", "match_id", "offset", "overlap", "votes", "bit_errors"]


def _offsets(classes: DataFrame, least: int, narrow: bool = True) -> DataFrame:
    """The offsets (class_id, match_id, offset, overlap) at which a class with a query and another meet, of `least` frames or more; all with LEAST_VOTES
    votes, or, if narrow, those that the wide keys find.

    A frame pair meets in one posting only: what both could flip, the query does. So without wide bits the meetings of an offset are its votes."""
    compared = classes.where(F.col("class_id").isNotNull() & (F.size("integers") >= least))
    wide = wide_bits(compared.count()) if narrow else 0
    others = _postings(compared, DOUBTS, wide).select(F.col("class_id").alias("match_id"), F.col("frames").alias("match_frames"), F.col("place").alias("match_place"), "key", F.col("flipped").alias("match_flipped"))
    queries = _postings(compared.where("queried"), QUERY_DOUBTS, wide, NEXT_DOUBTS if wide >= FLIPPED_NEXT else 0)
    met = queries.join(others, "key").where("class_id <> match_id AND match_flipped & unsure = 0").withColumn("offset", F.col("place") - F.col("match_place"))
    overlap = F.least(F.col("frames") - F.greatest(F.lit(0), F.col("offset")), F.col("match_frames") + F.least(F.lit(0), F.col("offset")))
    found = met.withColumn("overlap", overlap).where(F.col("overlap") >= least).groupBy("class_id", "match_id", "offset", "overlap").agg(F.count(F.lit(1)).alias("met"))
    return found.where(F.col("met") >= (1 if narrow else LEAST_VOTES)).drop("met")


def _checked(offsets: DataFrame, classes: DataFrame, most_errors: float) -> DataFrame:
    """Each pair's best offset of those with LEAST_VOTES votes within the limit of bit errors, as _PAIRS."""
    named = classes.where("class_id IS NOT NULL")
    sides = [named.select(F.col("class_id").alias(key), F.col("integers").alias(name), F.col("doubts").alias(f"{name}d")) for key, name in (("class_id", "_a"), ("match_id", "_b"))]
    both = offsets.join(sides[0], "class_id").join(sides[1], "match_id")
    n = F.col("overlap").cast("int")
    starts = {"_a": F.greatest(F.lit(0), F.col("offset")).cast("int") + 1, "_b": F.greatest(F.lit(0), -F.col("offset")).cast("int") + 1}

    def part(name: str) -> Column:
        return F.slice(name, starts[name[:2]], n)

    def free(name: str, bits: int) -> Column:
        """The frames' doubtful bits; none where there is not a doubt for each frame."""
        mask = lambda d: reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(d, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(bits)])
        return F.when(F.size(f"{name}d") == F.size(name), F.transform(part(f"{name}d"), mask)).otherwise(F.transform(part(name), lambda x: F.lit(0).cast("long")))

    differ = F.zip_with(part("_a"), part("_b"), lambda x, y: x.bitwiseXOR(y))
    wrong = F.aggregate(differ, F.lit(0), lambda t, x: t + F.bit_count(x))
    near = both.withColumn("bit_errors", wrong / (n * 2 * FILTERS)).where(F.col("bit_errors") <= most_errors)
    either = F.zip_with(free("_a", QUERY_DOUBTS), free("_b", DOUBTS), lambda x, y: F.bitwise_not(x.bitwiseOR(y)))
    votes = F.size(F.filter(F.zip_with(differ, either, lambda x, y: x.bitwiseAND(y)), lambda x: x == 0)).cast("long")
    rows = near.select("class_id", "match_id", F.col("offset").cast("int").alias("offset"), n.alias("overlap"), votes.alias("votes"), "bit_errors").where(F.col("votes") >= LEAST_VOTES)
    best = F.min(F.struct((-F.col("votes")).alias("down"), "bit_errors", F.abs("offset").alias("near"), "offset", "overlap", "votes")).alias("best")
    found = rows.groupBy("class_id", "match_id").agg(best)
    return found.select("class_id", "match_id", *[f"best.{c}" for c in _PAIRS[2:]])


def alignments(prints: DataFrame, most_errors: float = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP, query_step: int = QUERY_STEP, narrow: bool = False) -> DataFrame:
    """One row for each pair of a class with a query and a class aligned with it: class_id, match_id, offset, overlap, votes
    and bit_errors. Their number is that of the links there are."""
    classes = materialise(_classes(prints, query_step))
    return _checked(_offsets(classes, max(1, least_overlap), narrow), classes, most_errors)


def align(prints: DataFrame, most_errors: float = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP, query_step: int = QUERY_STEP, narrow: bool = False) -> DataFrame:
    """One row for each recording: id, class_id (the smallest id with its integers), class_size, is_query and n_matches; at
    representatives of a class with a query also the best of its alignments (most votes, fewest bit errors, smallest id)."""
    prints = materialise(prints)
    classes = materialise(_classes(prints, query_step))
    pairs = _checked(_offsets(classes, max(1, least_overlap), narrow), classes, most_errors)
    best = F.min(F.struct((-F.col("votes")).alias("down"), "bit_errors", "match_id", "offset", "overlap", "votes")).alias("best")
    found = pairs.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_matches"), best)
    found = found.select("class_id", "n_matches", *[f"best.{c}" for c in _PAIRS[1:]])
    rows = prints.join(classes.select("integers", "class_id", "class_size"), "integers").select("id", "class_id", "class_size", (F.pmod("id", F.lit(query_step)) == 0).alias("is_query"))
    # copies need no join, so that no key holds them all
    first = rows.where("id = class_id").join(found, "class_id", "left")
    nothing = [F.lit(None).cast(kind).alias(n) for n, kind in zip(("n_matches", *_PAIRS[1:]), ("long", "long", "int", "int", "long", "double"))]
    copies = rows.where("id IS NULL OR class_id IS NULL OR id <> class_id").select("*", *nothing)
    return first.unionByName(copies).withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))


def notes(vector: list[float] | None, rate: int = RATE) -> np.ndarray:
    """Samples made from a vector: every value is a note of one HOP, its pitch the value in half tones of a fixed scale."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector or []], float))
    v = v / max(1e-9, np.abs(v).max(initial=0))
    hz = 220 * 2 ** (np.round(18 * v) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * hz / rate, HOP))
    return (8000 * np.sin(phase) + 3000 * np.sin(2 * phase)).astype("<i2")


def recordings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rate: int = RATE) -> DataFrame:
    """A media column of PCM made from vectors by notes()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([notes(v.as_py(), rate).tobytes() for v in batch.column(1)], pa.binary())], ["id", "audio"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, audio binary")
