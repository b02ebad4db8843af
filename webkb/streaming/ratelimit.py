"""Keyed state machines of a crawl: adaptive rate limits, token buckets, queue life cycles, page states.

One pure step function serves the batch replay and the stream (applyInPandasWithState); both give the same rows. In a
batch the rows are dealt by key and sorted by key and time; a task reads them in order, batch by batch, and holds one small
state, so a key with a third of all rows takes one task long but no memory. In a stream, rows of one trigger are
taken in order of (ts, seq); a row that comes in a later trigger is taken then, whatever its time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

T = TypeVar("T")


# The default limits.
@dataclass
class Limits:
    base: float = 1.0
    least: float = 0.5
    most: float = 30.0
    factor: float = 2.0
    recovery: float = 0.9
    streak: int = 10


@dataclass
class DomainState:
    delay: float = 1.0
    streak: int = 0
    last: float = -1.0
    until: float = 0.0
    requests: int = 0
    errors: int = 0


def step(state: DomainState, now: float, ok: bool, retry_after: float | None, limits: Limits) -> float:
    """Advance by one request and return how long it waits: for the back-off, then for the delay since the last one."""
    at = now + (wait := max(0.0, state.until - now))
    if state.last >= 0:
        more = max(0.0, state.delay - (at - state.last))
        wait, at = wait + more, at + more
    state.last, state.requests = at, state.requests + 1
    if ok:
        state.streak += 1
        if state.streak >= limits.streak:
            state.delay, state.streak = max(limits.least, state.delay * limits.recovery), 0
    else:
        state.errors, state.streak = state.errors + 1, 0
        if retry_after is not None and retry_after == retry_after:
            state.delay = max(state.delay, retry_after)
            state.until = at + retry_after
        else:
            state.delay = min(limits.most, state.delay * limits.factor)
    return wait


OUT = "domain string, seq long, ts double, ok boolean, wait double, delay double, streak int"
STATE = "delay double, streak int, last double, until double, requests long, errors long"


def fold(rows: DataFrame, key: str, order: list[str], schema: str, fresh: Callable[[], T], advance: Callable[[T, tuple], tuple]) -> DataFrame:
    """One row out for each row in: advance(state, row) with the key's own state, rows in order; the key comes first."""
    columns = rows.columns
    place = columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if state is None or row[place] != now:
                    state, now = fresh(), row[place]
                out.append((now, *advance(state, row)))
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _log(log: DataFrame) -> DataFrame:
    return log.select(F.coalesce("domain", F.lit("")).alias("domain"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), "ok", F.col("retry_after").cast("double").alias("retry_after"))


def _fetched(state: DomainState, seq: int, ts: float, ok: bool, retry: float | None, limits: Limits) -> tuple:
    wait = step(state, float(ts), bool(ok), retry, limits)
    return int(seq), float(ts), bool(ok), round(wait, 6), round(state.delay, 6), state.streak


def replay(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Waits and delays of a fetch log (domain, seq, ts, ok, retry_after), each domain in order of (ts, seq); no domain is ""."""
    return fold(_log(log), "domain", ["ts", "seq"], OUT, lambda: DomainState(delay=limits.base), lambda state, row: _fetched(state, *row[1:], limits))


def acquire_waits(log: DataFrame, delay: float = 1.0) -> DataFrame:
    """(domain, seq, wait) with a fixed delay and no back-off: how long each request waits for the one before it."""
    still = Limits(base=delay, least=delay, most=delay, factor=1.0, recovery=1.0)
    return replay(log.withColumn("retry_after", F.lit(None).cast("double")), still).select("domain", "seq", "wait")


def replay_stream(log: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same over a stream; state is kept between batches, rows of a batch are taken in order of (ts, seq)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = DomainState(*held.get) if held.exists else DomainState(delay=limits.base)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"])  # what one trigger brings of a key
        out = [(key[0], *_fetched(state, *row, limits)) for row in rows[["seq", "ts", "ok", "retry_after"]].itertuples(index=False, name=None)]
        yield pd.DataFrame(out, columns=["domain", "seq", "ts", "ok", "wait", "delay", "streak"])
        held.update(tuple(asdict(state).values()))

    return log.groupBy("domain").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def token_bucket(log: DataFrame, rate: float = 1.0, burst: float = 5.0) -> DataFrame:
    """(domain, seq, wait, tokens): a bucket refills by rate up to burst; a request without a token waits for one."""

    def advance(state: list, row: tuple) -> tuple:
        tokens, last = state
        now = row[2] if last is None else max(row[2], last)
        tokens = tokens if last is None else min(burst, tokens + (now - last) * rate)
        wait, tokens = (0.0, tokens - 1) if tokens >= 1 else ((1 - tokens) / rate, 0.0)
        state[:] = tokens, now + wait
        return int(row[1]), round(wait, 6), round(tokens, 6)

    return fold(_log(log), "domain", ["ts", "seq"], "domain string, seq long, wait double, tokens double", lambda: [burst, None], advance)


def queue_states(events: DataFrame, most_retries: int = 3) -> DataFrame:
    """(url, status, failures, depth) after put, get, complete and fail events (url, seq, event, depth): a failed url waits
    again while it has failed at most most_retries times; its depth is kept."""
    last = F.max_by("event", "seq").alias("event")
    rows = events.groupBy("url").agg(last, F.count_if(F.col("event") == "fail").alias("failures"), F.min_by("depth", "seq").alias("depth"))
    status = F.when(F.col("event") == "complete", "completed").when(F.col("event") == "get", "in_progress").when((F.col("event") == "fail") & (F.col("failures") > most_retries), "failed").otherwise("queued")
    return rows.select("url", status.alias("status"), "failures", "depth")


def domain_stats(log: DataFrame) -> DataFrame:
    """Requests and errors of each domain; on a stream, an aggregation in update mode."""
    return log.groupBy("domain").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("errors"))


def visit_counts(visits: DataFrame, url: str = "norm_url") -> DataFrame:
    return visits.groupBy(url).agg(F.count(F.lit(1)).alias("visits"))


def loops(actions: DataFrame, session: str = "session") -> DataFrame:
    """actions (session, seq, url, action) with `loop`: with three or more earlier actions among the last ten, whether this
    one was done twice or more in them, or goes back to the place before the last (A, B, A)."""
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy("seq")
    before = w.rowsBetween(-10, -1)
    same = F.size(F.filter(F.collect_list(F.struct("url", "action")).over(before), lambda x: (x["url"] == F.col("url")) & (x["action"] == F.col("action"))))
    earlier = F.count(F.lit(1)).over(before)
    back = (F.lag("url", 2).over(w) == F.col("url")) & (F.lag("url", 1).over(w) != F.col("url"))
    return actions.withColumn("loop", F.coalesce((earlier >= 3) & ((same >= 2) | back), F.lit(False)))


def page_states(states: DataFrame, least: float = 0.9, keep: int = 5) -> DataFrame:
    """(url, seq, is_new): a state is new unless one of the last `keep` new states of its url has its hash, or element count
    and text length that are similar on average."""

    near = lambda a, b: 1.0 if a == b else min(a, b) / max(a, b, 1)

    def advance(kept: list, row: tuple) -> tuple:
        _, seq, hash_, elements, length = row
        known = any(hash_ == h or (near(elements, e) + near(length, n)) / 2 >= least for h, e, n in kept)
        if not known:
            kept[:] = [*kept, (hash_, elements, length)][-keep:]
        return int(seq), not known

    rows = states.select(F.coalesce("url", F.lit("")).alias("url"), "seq", "hash", "elements", "length")
    return fold(rows, "url", ["seq"], "url string, seq long, is_new boolean", list, advance)


def retry_delay(status: str = "status_code", kind: str = "error_kind"):
    """Seconds until a failed fetch is tried again: 5 for a refusal or the network, 10 for a timeout, null where it is final."""
    return F.when(F.col(status) == 429, 5.0).when(F.col(kind) == "timeout", 10.0).when(F.col(kind) == "network", 5.0)


def windowed_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by time window and key, with a watermark for late ones; for batches and streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
