"""A vector index kept as immutable segments: adding and removing write what is new, not the index.

A store is a folder. Each add() writes a segment, each remove() a list of deleted ids, both numbered in one sequence; a deletion counts for the segments
before it, so that a removed id can be added again. A manifest, a small table with a partition for each version, says which segments
and deletions make up the store; a change is done once its manifest is written, and what a lost writer leaves behind is in no manifest. Of two writers
of one version the second fails. Earlier versions stay readable.

Segments are merged by size: FANOUT of one tier (rows up to a power of FANOUT) become one, without their deleted rows, so a row is rewritten about as often
as there are tiers, and their number stays logarithmic. Deletions no older segment needs leave the manifest.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
_MANIFEST = "version long, number long, kind string, n_rows long, place string, dimensions int, metric string"
_Entry = tuple[int, str, int, str]


def tier(n_rows: int, fanout: int = FANOUT) -> int:
    """How often n_rows can be divided by fanout."""
    found = 0
    while n_rows >= fanout:
        n_rows //= fanout
        found += 1
    return found


def to_merge(segments: list[tuple[int, int]], fanout: int = FANOUT) -> list[int]:
    """Numbers of the segments (number, n_rows) of the lowest tier that holds `fanout` of them, or none."""
    tiers: dict[int, list[int]] = {}
    for number, n_rows in segments:
        tiers.setdefault(tier(n_rows, fanout), []).append(number)
    full = [t for t, numbers in tiers.items() if len(numbers) >= fanout]
    return sorted(tiers[min(full)]) if full else []


class VectorStore:
    """Rows (vec_id, vector, ...) of one schema. Ids are not null and occur once; every vector has the store's length."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self._asked = spark, path, version

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimensions: int, metric: str = "cosine") -> VectorStore:
        store = cls(spark, path)
        store._commit(0, [(0, "empty", 0, "")], dimensions, metric)
        return store

    def _manifest(self) -> list:
        """Rows of the newest version, or of the one asked for: one for each segment and deletion."""
        kept = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        version = self._asked if self._asked is not None else kept.agg(F.max("version")).first()[0]
        found = kept.where(F.col("version") == version).orderBy("number").collect()
        if not found:
            raise ValueError(f"no version {version} of {self.path}")
        return found

    def _commit(self, version: int, entries: list[_Entry], dimensions: int, metric: str) -> None:
        rows = self.spark.createDataFrame([(*e, dimensions, metric) for e in entries], _MANIFEST.removeprefix("version long, "))
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    def _change(self, state: list, entries: list[_Entry]) -> None:
        """The next version: deletions that no older segment needs are left out; the first entry keeps the store's last number."""
        if self._asked is not None:
            raise ValueError("an earlier version can only be read")
        last = max(n for n, *_ in entries)
        oldest = min((n for n, kind, *_ in entries if kind == "segment"), default=last)
        kept = [e for e in entries if e[1] == "segment" or e[1] == "deletion" and e[0] > oldest]
        self._commit(state[0]["version"] + 1, [(last, "empty", 0, ""), *kept], state[0]["dimensions"], state[0]["metric"])

    def _new(self, kind: str, number: int) -> str:
        """A folder of its own for each attempt: two writers that reach for one number never write to one place."""
        return f"{self.path}/{kind}/{number}-{uuid.uuid4().hex}"

    @staticmethod
    def _entries(state: list) -> list[_Entry]:
        return [(r["number"], r["kind"], r["n_rows"], r["place"]) for r in state]

    def _live(self, state: list, only: list[int] | None = None) -> DataFrame | None:
        """The rows of all segments, or of some, that no later deletion names; None without segments."""
        chosen = [r for r in state if r["kind"] == "segment" and (only is None or r["number"] in only)]
        if not chosen:
            return None
        parts = [self.spark.read.parquet(r["place"]).withColumn("_number", F.lit(r["number"])) for r in chosen]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        gone = [r["place"] for r in state if r["kind"] == "deletion" and r["number"] > chosen[0]["number"]]
        if gone:
            lists = self.spark.read.parquet(*gone).groupBy("vec_id").agg(F.max("deleted_at").alias("deleted_at"))
            rows = rows.join(lists, (rows["vec_id"] == lists["vec_id"]) & (lists["deleted_at"] > rows["_number"]), "left_anti")
        return rows.drop("_number")

    def rows(self) -> DataFrame | None:
        """All live rows; None if nothing was ever added."""
        return self._live(self._manifest())

    def get(self, ids: DataFrame) -> DataFrame | None:
        """The live rows of ids (vec_id)."""
        rows = self.rows()
        return None if rows is None else rows.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")

    def add(self, new: DataFrame, merge: bool = True) -> int:
        """Write a segment and return its number of rows; ValueError for a null or repeated id, one that is live already, or another length. Nothing is
        changed then. The rows are written first and checked as written, so that they are computed once."""
        state = self._manifest()
        number = max(r["number"] for r in state) + 1
        place = self._new("segments", number)
        new.write.parquet(place)
        written = self.spark.read.parquet(place)
        right = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == state[0]["dimensions"])
        n, wrong = written.agg(F.count(F.lit(1)), F.count(F.when(~F.coalesce(right, F.lit(False)), 1))).first()
        if wrong:
            raise ValueError(f"{wrong} rows without an id or with another length than {state[0]['dimensions']}")
        if not written.groupBy("vec_id").count().where("count > 1").isEmpty():
            raise ValueError("an id is repeated")
        live = self._live(state)
        if live is not None and not written.select("vec_id").join(live.select("vec_id"), "vec_id", "left_semi").isEmpty():
            raise ValueError("an id is in the store already")
        if n:
            self._change(state, [*self._entries(state), (number, "segment", n, place)])
            while merge and self.merge():
                pass
        return n

    def remove(self, ids: DataFrame) -> int:
        """Write a list of the live ones of ids (vec_id) and return how many; ids that are not in the store are passed over."""
        state = self._manifest()
        live = self._live(state)
        if live is None:
            return 0
        number = max(r["number"] for r in state) + 1
        place = self._new("deletions", number)
        found = live.select("vec_id").join(ids.select("vec_id").distinct(), "vec_id", "left_semi")
        found.withColumn("deleted_at", F.lit(number)).write.parquet(place)
        n = self.spark.read.parquet(place).count()
        if n:
            self._change(state, [*self._entries(state), (number, "deletion", n, place)])
        return n

    def clear(self) -> None:
        state = self._manifest()
        self._change(state, [(max(r["number"] for r in state), "empty", 0, "")])

    def merge(self, everything: bool = False) -> bool:
        """Merge one full tier, or all segments; whether there was something to merge."""
        state = self._manifest()
        segments = [(r["number"], r["n_rows"]) for r in state if r["kind"] == "segment"]
        chosen = [n for n, _ in segments] if everything else to_merge(segments)
        if not chosen or everything and len(chosen) == 1 and not any(r["kind"] == "deletion" for r in state):
            return False
        number = max(r["number"] for r in state) + 1
        place = self._new("segments", number)
        self._live(state, chosen).write.parquet(place)
        n = self.spark.read.parquet(place).count()
        rest = [e for e in self._entries(state) if e[1] != "segment" or e[0] not in chosen]
        self._change(state, [*rest, (number, "segment" if n else "empty", n, place)])
        return True

    def stats(self) -> dict:
        """version, vectors, dimensions, metric, segments, deletions and stored (rows in segments, deleted ones too)."""
        state = self._manifest()
        live = self._live(state)
        kinds = [r["kind"] for r in state]
        stored = sum(r["n_rows"] for r in state if r["kind"] == "segment")
        return {"version": state[0]["version"], "vectors": 0 if live is None else live.count(), "dimensions": state[0]["dimensions"], "metric": state[0]["metric"], "segments": kinds.count("segment"), "deletions": kinds.count("deletion"), "stored": stored}

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame | None:
        """top_k() of queries (query_id, vector) over the live rows by the store's metric."""
        from ..operators.vectors import top_k

        live = self.rows()
        return None if live is None else top_k(queries, live, k, self._manifest()[0]["metric"])


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(f"{path}/manifest")
        return True
    except AnalysisException:
        return False
