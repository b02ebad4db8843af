"""Phrase mining by Toivonen's method: a sample proposes, one full pass counts, border failures are followed up.

A phrase is 1 to 4 words that stand together in a piece (text between separators) of one language. No phrase is more frequent than
its parts, so a frequent one can only be made of frequent ones. The phrases that are frequent in a sample, at a lowered
threshold, are the first proposal. The full pass counts exactly every phrase whose two parts (all but its last word, all but its first) are proposed:
the proposal itself and its negative border, words always. A border phrase that turns out frequent is a failure: it joins the proposal, and
a further pass counts what is only now within the border, until there are no failures. The result is exact whatever the sample was;
the sample decides the number of passes alone.

The proposal goes to the tasks as a bitmap of a fixed size (BITS), one bit for each key. A phrase more than proposed only adds
work: it is counted, exactly, and falls to the threshold. So what is sent is bounded, however many phrases are frequent. Tasks sum words and phrases
themselves, CHUNK occurrences at a time, and pass on what they hold when that is HELD phrases or HELD_WORDS words; Spark sums only after the shuffle, so that no task
holds its distinct phrases as rows of a hash table beside that. Phrases travel as two 64-bit keys (of all but the last word, and of that word),
texts of frequent ones are joined from their parts at the end. Ranks per language come from a window with a limit, which keeps the first rows
of each task before they are shuffled.

Keys are 64-bit hashes: two different phrases of which one is frequent are mixed up with a chance of about 1 in 2^64 a pair, unless their words
are thousands of bytes long and made to collide. Null texts count as
empty, a null language as `und`; ids only deal rows to the sample, so repeated or missing ones do no harm. A text without words gives
nothing, an empty table no rows. Very long texts are taken in parts cut at separators. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .jaccard import mix

LONGEST = 4
LEAST = 30
COVERED = 80  # percent of a phrase's occurrences inside one longer candidate that drop it
SCALE = 2_000_000
MOST = 2000
SAMPLE = 16  # one document in so many
SAMPLE_LEAST = 2  # occurrences in the sample that propose a phrase; words take one
BITS = 26
CHUNK = 400_000
HELD = 1_500_000  # distinct phrases a task sums before it passes them on
HELD_WORDS = 150_000
SLICE = 250_000  # bytes that are taken at once
UNKNOWN = "und"
_STOP = b"."  # a separator, so never a word
_TABLE = bytes(46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROW = "k byte, prefix long, last long, lang string, word string, f long"


_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so its powers have inverses
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of _BASE and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64)))) for x in (_BASE, inverse))
        return self.up, self.down


def cleaned(text: str | None) -> bytes:
    """Lower-cased bytes with every separator a stop, and a stop at the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE) + _STOP


def words_of(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, pieces and hashes of the words of cleaned bytes. A word's hash is the polynomial of its bytes' values, from running sums."""
    values = np.frombuffer(data, np.uint8)
    stop = values == _STOP[0]
    inside = np.concatenate(([False], (values != 32) & ~stop, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers.upto(len(values))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[values] * up[: len(values)], dtype=np.uint64)))
    return starts, ends, np.cumsum(stop)[starts], mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_keys(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return mix(hashes ^ seeds)


def longer_keys(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(prefix * _STEP + last)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)


class Bits:
    """A set of keys that may hold more than was put in, never less."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - BITS)
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    @staticmethod
    def of(keys: DataFrame) -> np.ndarray:
        """The bits of the column key; at most 2 ** (BITS - 6) rows reach the driver."""
        at = F.shiftrightunsigned("key", 64 - BITS)
        bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - BITS}) & 63 AS INT))")
        rows = keys.select(F.shiftrightunsigned(at, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (BITS - 6), np.uint64)
        table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return table


def _merged(keys: list[np.ndarray], prefix: list[np.ndarray], last: list[np.ndarray], counts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Distinct phrases, as lists of one array, and their occurrences."""
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    at = order[first]
    n = np.concatenate(counts)[order]
    return [[key[first]], [np.concatenate(prefix)[at]], [np.concatenate(last)[at]], [np.add.reduceat(n, first) if len(first) else n]]


def _count(texts: DataFrame, longest: int, now=None, before=None, words: bool = True) -> DataFrame:
    """Occurrences of words (lang, word) and of phrases (k, prefix, last) whose parts both are in now and not both in before.

    now, before: broadcast bits; without now every phrase is counted. texts: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int8(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in _ROW.split(", ")]
        powers = Powers()
        filters = [Bits(x.value) if x is not None else None for x in (now, before)]
        singles: list[tuple[np.ndarray, np.ndarray, list[bytes], list[str]]] = []
        held: list[list[list[np.ndarray]]] = [[[], [], [], []] for _ in range(longest + 1)]

        def phrases(least: int) -> Iterator[pa.RecordBatch]:
            """Sum the phrases held; pass them on if they are `least` or more."""
            for k in range(2, longest + 1):
                if held[k][0]:
                    held[k] = _merged(*held[k])
            if sum(len(h[0][0]) for h in held if h[0]) < least:
                return
            for k in range(2, longest + 1):
                if held[k][0]:
                    _, p, w, n = (x[0] for x in held[k])
                    held[k] = [[], [], [], []]
                    for at in range(0, len(p), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        rows = len(p[part])
                        none = pa.nulls(rows, pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, k, np.int8)), pa.array(p[part].view(np.int64)), pa.array(w[part].view(np.int64)), none, none, pa.array(n[part])], names)

        def uses(least: int) -> Iterator[pa.RecordBatch]:
            """Likewise the words."""
            if not singles:
                return
            keys, first, place = np.unique(np.concatenate([x[0] for x in singles]), return_index=True, return_inverse=True)
            counts = np.bincount(place, np.concatenate([x[1] for x in singles]), len(first)).astype(np.int64)
            texts, langs = ([y for x in singles for y in x[i]] for i in (2, 3))
            texts, langs = ([x[i] for i in first.tolist()] for x in (texts, langs))
            singles.clear()
            if len(keys) < least:
                singles.append((keys, counts, texts, langs))
                return
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                zero = pa.array(np.zeros(len(keys[part]), np.int64))
                word = pa.array(texts[part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(zero), np.int8)), zero, zero, pa.array(langs[part], pa.string()), word, pa.array(counts[part])], names)

        def add(docs: list[tuple[str, bytes]]) -> tuple[int, int]:
            """Take in a few documents; how many phrases and words they gave."""
            data = b"".join(d for _, d in docs)
            starts, ends, piece, hashes = words_of(data, powers)
            owner = np.searchsorted(np.cumsum([len(d) for _, d in docs]), starts, "right")
            one = word_keys(hashes, np.array([_seed(lang) for lang, _ in docs], np.uint64)[owner])
            if words and len(one):
                keys, at, n = np.unique(one, return_index=True, return_counts=True)
                singles.append((keys, n, [data[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())], [docs[o][0] for o in owner[at].tolist()]))
            key, many = one, 0
            for k in range(2, longest + 1):
                # key[i] is of the k - 1 words from i
                use = piece[: max(0, len(one) - k + 1)] == piece[k - 1 :]
                if filters[0] is not None:
                    inside = filters[0].has(key)
                    use &= inside[:-1] & inside[1:]
                    if filters[1] is not None:
                        old = inside & filters[1].has(key)
                        use &= ~(old[:-1] & old[1:])
                prefix, last = key[:-1], one[k - 1 :]
                key = longer_keys(prefix, last)
                found = int(use.sum())
                for store, values in zip(held[k], (key[use], prefix[use], last[use], np.ones(found, np.int64))):
                    store.append(values)
                many += found
            return many, len(one)

        def parts(text: str | None) -> Iterator[bytes]:
            """A text's cleaned bytes, long ones cut after stops."""
            data = cleaned(text)
            while len(data) > SLICE and (cut := data.find(_STOP, SLICE) + 1) < len(data):
                yield data[:cut]
                data = data[cut:]
            yield data

        size = counted = count = 0
        docs: list[tuple[str, bytes]] = []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in parts(text.as_py()):
                    docs.append((lang, part))
                    count += len(part)
                    if count >= SLICE:
                        more, found = add(docs)
                        size, counted, docs, count = size + more, counted + found, [], 0
                    if size >= CHUNK:
                        yield from phrases(HELD)
                        size = 0
                    if counted >= CHUNK:
                        yield from uses(HELD_WORDS)
                        counted = 0
        if docs:
            add(docs)
        yield from phrases(1)
        yield from uses(1)

    group = ["k", "prefix", "last", "lang", "word"]
    return texts.mapInArrow(run, _ROW).repartition(*group).groupBy(*group).agg(F.sum("f").alias("f"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows of _count with their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            k, prefix, last = (batch.column(i).to_numpy() for i in range(3))
            key = longer_keys(prefix.view(np.uint64), last.view(np.uint64))
            one = np.flatnonzero(k == 1)
            lang, word = (batch.column(i).take(pa.array(one)).to_pylist() for i in (3, 4))
            if len(one):
                hashes = words_of(" ".join(word).encode("utf-8", "surrogatepass"), powers)[3]  # the words are cleaned already
                key[one] = word_keys(hashes, np.array([_seed(x) for x in lang], np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], [*batch.schema.names, "key"])

    columns = [x.split()[0] for x in _ROW.split(", ")]
    return rows.select(*columns).mapInArrow(run, f"{_ROW}, key long")


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """All phrases (lang, k, phrase, f) of at least `least` occurrences, and the words of each language (lang, n)."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    text = F.col(f"`{text_col}`").cast("string")
    picked = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(sample)) == 0)
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    proposed = _keyed(_count(picked.select(lang.alias("lang"), text.alias("text")), longest - 1).where((F.col("k") == 1) | (F.col("f") >= SAMPLE_LEAST)))
    now, before = Bits.of(proposed.select("key")), None
    sent = spark.sparkContext.broadcast(now)
    counted = materialise(_count(texts, longest, sent).where((F.col("k") == 1) | (F.col("f") >= least)))
    sizes = materialise(counted.where("k = 1").groupBy("lang").agg(F.sum("f").alias("n")))
    found = materialise(_keyed(counted.where(F.col("f") >= least)))
    while True:
        before, now = now, now | Bits.of(found.where(F.col("k") < longest).select("key"))
        if (now == before).all():  # every frequent phrase was in the proposal: closed
            break
        old, sent = sent, spark.sparkContext.broadcast(now)
        found = materialise(found.union(_keyed(_count(texts, longest, sent, old, words=False).where(F.col("f") >= least))))
    return _texts(found, longest), sizes


def _texts(found: DataFrame, longest: int) -> DataFrame:
    """lang, k, phrase and f: texts put together from those of the parts."""
    words = found.where("k = 1").select("key", "lang", F.col("word").alias("phrase"), "f")
    ends = words.select(F.col("key").alias("last"), F.col("phrase").alias("end"))
    level = words
    out = words.select("lang", F.lit(1).alias("k"), "phrase", "f")
    for k in range(2, longest + 1):
        starts = level.select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("start"))
        rows = found.where(F.col("k") == k).select("prefix", "last", "key", "f")
        level = materialise(rows.join(starts, "prefix").join(ends, "last").select("key", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), "f"))
        out = out.union(level.select("lang", F.lit(k).alias("k"), "phrase", "f"))
    return materialise(out)


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def mine(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, most: int | None = MOST, sample: int = SAMPLE,
) -> DataFrame:
    """Phrases of 2 to `longest` words, the first `most` of each language (None: all): lang, rank, phrase, a, l, r, n and score."""
    found, sizes = frequent(docs, id_col, text_col, lang_col, least, longest, sample)
    candidates = found.where("k > 1").withColumn("words", F.split("phrase", " "))
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", _part(F.col("words"), 1, F.col("at")).alias("left"), _part(F.col("words"), F.col("at") + 1, F.col("k") - F.col("at")).alias("right"))
    counts = found.select("lang", "phrase", "f")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) div CAST(l + r AS DECIMAL(20, 0))")
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(F.col("words"), i, n))))
    inside = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
