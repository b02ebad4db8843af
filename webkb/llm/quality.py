"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE words each; an empty document has one empty passage). Every
passage of every document is encoded from its own text: shares of character classes, repetition and word
lengths. Only documents have labels: a gated attention layer learns which passages carry the verdict, and
the score is that of the attention-weighted mean of the encoded passages.

The model is fitted on the driver on a bounded sample of labelled documents (SAMPLE, by hash order), whose
passage features Spark computes; scoring is a map over all documents, without a shuffle.

Null text counts as empty. Null or repeated labels: nulls are left out, repeats train repeatedly. Without
any label of a class every score is 0.5. An empty table gives no rows. Very long texts have as many passages as they need; of a
labelled one, BAG are learnt from. Rows that repeat a doc_id are scored one by one; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

PASSAGE = 64
SAMPLE = 4096
BAG = 1024  # passages of a document that are learnt from
FOLDS = 5
ACCEPT = 0.3
_SINGLES = b".,!?|*#$%&'\"-_/=<>()"
_CLASSES = 6 + len(_SINGLES)


def _class_table() -> np.ndarray:
    table = np.full(256, 5, np.int64)  # other ASCII signs
    for lo, hi, kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (128, 255, 3), (9, 13, 4), (32, 32, 4)):
        table[lo : hi + 1] = kind
    for i, sign in enumerate(_SINGLES):
        table[sign] = 6 + i
    return table


_TABLE = _class_table()
FEATURES = _CLASSES + 6


def passages(text: str | None, size: int = PASSAGE) -> np.ndarray:
    """One row of features for each passage of a text."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.arange(0, len(words), size)
    counts = np.diff(np.append(starts, len(words)))
    line = np.frombuffer(b"".join(words), np.uint8)
    of_byte = np.repeat(np.repeat(np.arange(len(starts)), counts), lengths)
    n_bytes = np.add.reduceat(lengths, starts)
    classes = np.bincount(of_byte * _CLASSES + _TABLE[line], minlength=len(starts) * _CLASSES).reshape(-1, _CLASSES) / n_bytes[:, None]
    last = np.cumsum(lengths) - 1
    firsts = line[last - lengths + 1]
    ends = (_TABLE[line[last]] >= 5).astype(float)
    caps = ((firsts >= 65) & (firsts <= 90)).astype(float)
    same = np.fromiter(map(eq, words, words[1:] + [b""]), float, len(words))
    per_word = np.stack([ends, caps, same, lengths.astype(float)], 1)
    means = np.add.reduceat(per_word, starts, 0) / counts[:, None]
    means[:, 3] /= 10
    distinct = np.array([len(set(words[a : a + n])) / n for a, n in zip(starts.tolist(), counts.tolist())])
    return np.concatenate([np.sqrt(classes), means, distinct[:, None], np.log1p(counts)[:, None] / 4], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class GatedAttention:
    """Parameters by name: W, b encode; V, U, w attend; c, d score. mean and scale standardise the features."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        g1, g2 = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (g1 * g2) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, 0)
        return {"bag": bag, "h": h, "g1": g1, "g2": g2, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.params, self.forward(x, starts)
        bag, h, g1, g2, a = f["bag"], f["h"], f["g1"], f["g2"], f["a"]
        out = (f["score"] - y) / len(y)
        dz = (out[:, None] * p["c"])[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        gate1 = de[:, None] * p["w"] * g2 * (1 - g1**2)
        gate2 = de[:, None] * p["w"] * g1 * g2 * (1 - g2)
        dh = (a[:, None] * dz + gate1 @ p["V"].T + gate2 @ p["U"].T) * (1 - h**2)
        return {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ gate1, "U": h.T @ gate2, "w": (g1 * g2).T @ de, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 200, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
    """Adam over all bags at once; the sample is small."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(float) if bags else np.zeros((0, FEATURES))
    shapes = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
    params = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    if len(set(y.tolist())) < 2:
        return GatedAttention(params | {"c": np.zeros(hidden)}, np.zeros(FEATURES), np.ones(FEATURES))
    model = GatedAttention(params, x.mean(0), x.std(0) + 0.05)
    starts = np.cumsum([0, *map(len, bags)])[:-1]
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for t in range(1, steps + 1):
        grads = model.gradients(x, starts, y)
        for k, g in grads.items():
            g = g + decay * params[k] * (k not in "bd")
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo FOLDS, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bag: int = BAG) -> GatedAttention:
    """Fit on at most `sample` labelled documents outside the held-out fold; of a document with more than `bag` passages, on
    `bag` evenly spaced ones."""
    open_rows = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y"))
    open_rows = open_rows.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    chosen = open_rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id").select(F.col("_id").cast("long"), "_y", "_text")  # chosen has `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t.as_py()) for t in batch.column(2)]
            data = [(x if len(x) <= bag else x[np.linspace(0, len(x) - 1, bag).astype(int)]).tobytes() for x in bags]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], ["_id", "_y", "x"])

    got = sorted((r["_id"], r["_y"], bytes(r["x"])) for r in rows.mapInArrow(run, "_id long, _y double, x binary").toLocalIterator())
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in got]
    return fit(bags, np.array([y for _, y, _ in got]))


def score(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column score (0 to 1), as (id, score)."""
    schema = "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def _scores(model: GatedAttention, texts: pa.Array, group: int = 256) -> np.ndarray:
    out = [np.zeros(0)]
    for at in range(0, len(texts), group):
        bags = [passages(t.as_py()) for t in texts[at : at + group]]
        out.append(model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])["score"])
    return np.concatenate(out)


def keep_good(docs: DataFrame, model: GatedAttention, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The documents scored at `accept` or more, with all their columns; a map, nothing is shuffled."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(model, pa.array(texts, pa.string(), from_pandas=True)))

    rows = docs.select(packed(docs), scored(F.col(f"`{text_col}`").cast("string")).alias("_score"))
    return unpacked(rows.where(F.col("_score") >= accept), docs.columns)
