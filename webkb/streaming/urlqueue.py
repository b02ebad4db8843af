"""Queues of urls as a state machine over events: put, get, complete, fail, requeue, in a batch and in a stream.

A queue gives its urls by priority, those of one priority in the order in which they came. A url is taken in once. A failed one waits again
at the lowest priority while it has failed at most `retries` times, without the depth and parent it had; with a delay it
can't be taken before that has passed. Completed urls are never given again.

The stream (transformWithState) keeps a queue as keyed maps in the state store: an entry for each waiting place, a row for each url, and the
two ends of each priority's line. An event touches a handful of them, whatever the queue's length; a whole queue is never loaded. The
batch replays a queue's events in order with the same step over dictionaries: memory grows with the urls of one queue there.
Rows of one trigger are taken in order of seq, rows of a later trigger after them. Null queues are "". Null urls are put, given and failed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ratelimit import fold

# Priorities, the smaller ones first.
PRIORITIES = {"critical": 0, "high": 10, "normal": 50, "low": 80, "deferred": 100}
DEFERRED = PRIORITIES["deferred"]
_LATER = DEFERRED + 1  # the line of entries whose delay has not passed
MOST_DEPTH, RETRIES = 10, 3
OUT = "queue string, seq long, event string, url string, done boolean, priority int, depth int, parent string, tries int"
_ENTRY = "url string, priority int, depth int, parent string, tries int, ready double"
_URL = "completed boolean, failures int"


class Lines:
    """The parts of a queue's state as plain dictionaries: entries by (line, number), urls, and each line's (first, end)."""

    def __init__(self):
        self.entries: dict[tuple[int, int], tuple] = {}
        self.urls: dict[str, tuple[bool, int]] = {}
        self.ends: dict[int, tuple[int, int]] = {}

    def lines(self) -> list[int]:
        return sorted(self.ends)

    def push(self, line: int, entry: tuple) -> None:
        first, end = self.ends.get(line, (0, 0))
        self.entries[line, end] = entry
        self.ends[line] = first, end + 1

    def head(self, line: int) -> tuple | None:
        first, end = self.ends.get(line, (0, 0))
        return self.entries[line, first] if first < end else None

    def pop(self, line: int) -> None:
        first, end = self.ends[line]
        del self.entries[line, first]
        self.ends[line] = first + 1, end


def step(state, event: str, url: str | None, ts: float, priority: int, depth: int, parent: str | None, most_depth: int = MOST_DEPTH, retries: int = RETRIES, delay: float = 0.0) -> tuple:
    """Apply one event; (url, done, priority, depth, parent, tries). done: taken in, given, completed, or waiting again."""
    completed, failures = state.urls.get(url, (False, 0)) if event != "get" else (False, 0)
    if event == "put":
        if depth > most_depth or url in state.urls:
            return url, False, priority, depth, parent, failures
        state.urls[url] = False, 0
        state.push(priority, (url, priority, depth, parent, 0, ts))
        return url, True, priority, depth, parent, 0
    if event == "get":
        while (late := state.head(_LATER)) is not None and late[5] <= ts:
            state.pop(_LATER)
            state.push(DEFERRED, late)
        for line in state.lines():
            while line != _LATER and (entry := state.head(line)) is not None:
                state.pop(line)
                if not state.urls.get(entry[0], (False, 0))[0]:
                    return entry[0], True, *entry[1:5]
        return None, False, None, None, None, None
    if event == "complete":
        state.urls[url] = True, failures
        return url, True, None, None, None, failures
    if event == "fail":
        failures += 1
        state.urls[url] = completed, failures
        again = failures <= retries
        if again:
            state.push(_LATER if delay else DEFERRED, (url, DEFERRED, 0, None, failures, ts + delay))
        return url, again, DEFERRED if again else None, 0 if again else None, None, failures
    if event == "requeue":
        state.urls.setdefault(url, (completed, failures))
        state.push(priority, (url, priority, 0, None, 0, ts))
        return url, True, priority, 0, None, 0
    raise ValueError(f"unknown event: {event}")


def _events(events: DataFrame) -> DataFrame:
    """events (queue, seq, ts, event, url, priority, depth, parent); no priority is normal, or deferred for a requeue; no depth is 0."""
    usual = F.when(F.col("event") == "requeue", DEFERRED).otherwise(PRIORITIES["normal"])
    return events.select(
        F.coalesce(F.col("queue").cast("string"), F.lit("")).alias("queue"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("ts").cast("double"), F.lit(0.0)).alias("ts"), "event",
        F.col("url").cast("string").alias("url"), F.coalesce(F.col("priority").cast("int"), usual).alias("priority"), F.coalesce(F.col("depth").cast("int"), F.lit(0)).alias("depth"), F.col("parent").cast("string").alias("parent"),
    )


def replay_queue(events: DataFrame, most_depth: int = MOST_DEPTH, retries: int = RETRIES, delay: float = 0.0) -> DataFrame:
    """What each event of a log did, queue by queue in order of seq; see step()."""

    def advance(state: Lines, row: tuple) -> tuple:
        _, seq, ts, event, url, priority, depth, parent = row
        return seq, event, *step(state, event, url, ts, priority, depth, parent, most_depth, retries, delay)

    return fold(_events(events), "queue", ["seq"], OUT, Lines, advance)


class _Map:
    """A map state with the part of a dictionary's interface that step() needs; the key is one text."""

    def __init__(self, state):
        self.state = state

    def get(self, key: str | None, other: tuple) -> tuple:
        return tuple(self.state.getValue((_name(key),))) if key in self else other

    def __contains__(self, key: str | None) -> bool:
        return self.state.containsKey((_name(key),))

    def __setitem__(self, key: str | None, value: tuple) -> None:
        self.state.updateValue((_name(key),), value)

    def setdefault(self, key: str | None, value: tuple) -> None:
        if key not in self:
            self[key] = value


def _name(url: str | None) -> str:
    return "" if url is None else "=" + url


class _Queue(StatefulProcessor):
    def __init__(self, most_depth: int, retries: int, delay: float):
        self.limits = most_depth, retries, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "line int, number long", _ENTRY)
        self.ends = handle.getMapState("ends", "line int", "first long, end long")
        self.urls = _Map(handle.getMapState("urls", "url string", _URL))

    def lines(self) -> list[int]:
        return sorted(k[0] for k in self.ends.keys())  # as many as there are priorities

    def _ends(self, line: int) -> tuple[int, int]:
        return tuple(self.ends.getValue((line,))) if self.ends.containsKey((line,)) else (0, 0)

    def push(self, line: int, entry: tuple) -> None:
        first, end = self._ends(line)
        self.entries.updateValue((line, end), entry)
        self.ends.updateValue((line,), (first, end + 1))

    def head(self, line: int) -> tuple | None:
        first, end = self._ends(line)
        return tuple(self.entries.getValue((line, first))) if first < end else None

    def pop(self, line: int) -> None:
        first, end = self._ends(line)
        self.entries.removeKey((line, first))
        self.ends.updateValue((line,), (first + 1, end))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["seq", "ts", "event", "url", "priority", "depth", "parent"]
        out = []
        for seq, ts, event, *rest in pd.concat(list(rows), ignore_index=True).sort_values("seq")[columns].itertuples(index=False, name=None):  # what one trigger brings of a queue
            out.append((key[0], seq, event, *step(self, event, rest[0], float(ts), int(rest[1]), int(rest[2]), rest[3], *self.limits)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"priority": "Int32", "depth": "Int32", "tries": "Int32"})

    def close(self) -> None:
        pass


def replay_queue_stream(events: DataFrame, most_depth: int = MOST_DEPTH, retries: int = RETRIES, delay: float = 0.0) -> DataFrame:
    """The same over a stream of events; the session needs the RocksDB state store."""
    return _events(events).groupBy("queue").transformWithStateInPandas(_Queue(most_depth, retries, delay), OUT, "Append", "None")
