"""State machines and windows over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import ratelimit as L
from ..streaming import urlqueue as U

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def fetch_log(events: DataFrame) -> DataFrame:
    """Events as fetches: the user as domain, errors as failures, every third failure with a time to wait."""
    failed = F.col("event_type") == "error"
    return events.select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (~failed).alias("ok"), F.when(failed & (F.col("event_id") % 3 == 0), 5.0).alias("retry_after"))


_LOG = """RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS ts, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 5.0::DOUBLE END AS retry FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS no FROM e)"""
_ZERO = "0.0::DOUBLE"
_ADAPT = f"""WITH {_LOG}, first AS (SELECT DISTINCT domain FROM o),
    g AS (SELECT domain, 0::BIGINT AS no, NULL::BIGINT AS seq, {_ZERO} AS ts, true AS ok, {_ZERO} AS wait, 1.0::DOUBLE AS delay, 0 AS streak, -1.0::DOUBLE AS last, {_ZERO} AS until FROM first
      UNION ALL SELECT domain, no, seq, ts, ok, wait, CASE WHEN ok THEN CASE WHEN streak + 1 >= 10 THEN greatest(0.5::DOUBLE, delay * 0.9::DOUBLE) ELSE delay END WHEN retry IS NOT NULL THEN greatest(delay, retry) ELSE least(30.0::DOUBLE, delay * 2.0::DOUBLE) END,
        CASE WHEN ok AND streak + 1 < 10 THEN streak + 1 ELSE 0 END, place, CASE WHEN NOT ok AND retry IS NOT NULL THEN place + retry ELSE until END
      FROM (SELECT *, wait0 + more AS wait, at0 + more AS place FROM (SELECT *, CASE WHEN last >= 0 THEN greatest({_ZERO}, delay - (at0 - last)) ELSE {_ZERO} END AS more FROM
        (SELECT o.domain, o.no, o.seq, o.ts, o.ok, o.retry, g.delay, g.streak, g.last, g.until, greatest({_ZERO}, g.until - o.ts) AS wait0, o.ts + greatest({_ZERO}, g.until - o.ts) AS at0 FROM g JOIN o ON o.domain = g.domain AND o.no = g.no + 1))))
    """


@query("z2_adaptive_rate_limit", _ADAPT + "SELECT domain, seq, ts, ok, round(wait, 6) AS wait, round(delay, 6) AS delay, streak FROM g WHERE seq IS NOT NULL")
def z2(spark: SparkSession, d: str) -> DataFrame:
    return L.replay(fetch_log(table(spark, d, "events")))


@query("z1_acquire_waits", """SELECT domain, seq, round(CASE WHEN before IS NULL THEN 0.0 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (ts - before)) END, 6) AS wait
    FROM (SELECT CAST(user_id AS VARCHAR) AS domain, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS ts, lag(epoch_us(ts) / 1e6::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def z1(spark: SparkSession, d: str) -> DataFrame:
    """Requests further apart than their delay, as these are, wait from the one before."""
    return L.acquire_waits(fetch_log(table(spark, d, "events")))


@query("z3_token_bucket", f"""WITH {_LOG}, first AS (SELECT DISTINCT domain FROM o),
    g AS (SELECT domain, 0::BIGINT AS no, NULL::BIGINT AS seq, {_ZERO} AS wait, 5.0::DOUBLE AS tokens, NULL::DOUBLE AS last FROM first
      UNION ALL SELECT domain, no, seq, wait, CASE WHEN filled >= 1 THEN filled - 1 ELSE {_ZERO} END, now + wait FROM (SELECT *, CASE WHEN filled >= 1 THEN {_ZERO} ELSE (1 - filled) / 0.0005::DOUBLE END AS wait FROM
        (SELECT *, CASE WHEN last IS NULL THEN tokens ELSE least(5.0::DOUBLE, tokens + (now - last) * 0.0005::DOUBLE) END AS filled FROM
          (SELECT o.domain, o.no, o.seq, g.tokens, g.last, CASE WHEN g.last IS NULL THEN o.ts ELSE greatest(o.ts, g.last) END AS now FROM g JOIN o ON o.domain = g.domain AND o.no = g.no + 1))))
    SELECT domain, seq, round(wait, 6) AS wait, round(tokens, 6) AS tokens FROM g WHERE seq IS NOT NULL""")
def z3(spark: SparkSession, d: str) -> DataFrame:
    return L.token_bucket(fetch_log(table(spark, d, "events")), rate=0.0005)


@query("z4_queue_states", """WITH q AS (SELECT user_id AS url, event_id AS seq, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_id % 3 = 0 THEN 'get' WHEN event_id % 3 = 1 THEN 'complete' ELSE 'put' END AS event, event_id % 5 AS depth FROM events),
    a AS (SELECT url, arg_max(event, seq) AS event, count(*) FILTER (event = 'fail') AS failures, arg_min(depth, seq) AS depth FROM q GROUP BY url)
    SELECT url, CASE WHEN event = 'complete' THEN 'completed' WHEN event = 'get' THEN 'in_progress' WHEN event = 'fail' AND failures > 3 THEN 'failed' ELSE 'queued' END AS status, failures, depth FROM a""")
def z4(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.col("event_type") == "error", "fail").when(F.col("event_id") % 3 == 0, "get").when(F.col("event_id") % 3 == 1, "complete").otherwise("put")
    return L.queue_states(table(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), e.alias("event"), (F.col("event_id") % 5).alias("depth")))


_QUEUE = """WITH RECURSIVE
    e AS (
        SELECT user_id AS queue, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no,
               CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'get' ELSE CASE WHEN event_id % 11 = 0 THEN 'requeue' ELSE 'put' END END AS event,
               'u' || event_id % 23 AS url, [0, 10, 50, 80][event_id % 4 + 1] AS priority, event_id % 13 AS depth, 'p' || event_id % 5 AS parent
        FROM events
    ),
    g AS (
        SELECT DISTINCT queue, 0::BIGINT AS no, NULL::BIGINT AS seq, NULL::VARCHAR AS event, NULL::STRUCT(p INTEGER, n BIGINT, u VARCHAR, d BIGINT, f VARCHAR, t BIGINT) AS got, NULL::VARCHAR AS url, false AS done,
               []::STRUCT(p INTEGER, n BIGINT, u VARCHAR, d BIGINT, f VARCHAR, t BIGINT)[] AS heap, []::VARCHAR[] AS seen, []::VARCHAR[] AS completed, []::VARCHAR[] AS failed
        FROM e
        UNION ALL
        SELECT queue, no, seq, event, CASE event WHEN 'get' THEN top ELSE new END, CASE event WHEN 'get' THEN top.u ELSE url END,
               CASE event WHEN 'get' THEN top IS NOT NULL WHEN 'put' THEN fresh WHEN 'fail' THEN failures <= 3 ELSE true END,
               CASE WHEN event = 'get' THEN list_filter(live, lambda x: x.n IS DISTINCT FROM top.n) WHEN event = 'put' AND fresh OR event = 'requeue' OR event = 'fail' AND failures <= 3 THEN list_append(live, new) ELSE live END,
               CASE WHEN event <> 'get' AND (event <> 'put' OR fresh) THEN list_append(seen, url) ELSE seen END,
               CASE WHEN event = 'complete' THEN list_append(completed, url) ELSE completed END,
               CASE WHEN event = 'fail' THEN list_append(failed, url) ELSE failed END
        FROM (
            SELECT *, list_sort(live)[1] AS top,
                   CASE event WHEN 'put' THEN {'p': priority, 'n': no, 'u': url, 'd': depth, 'f': parent, 't': failures}
                     WHEN 'requeue' THEN {'p': priority, 'n': no, 'u': url, 'd': 0, 'f': NULL, 't': 0}
                     WHEN 'fail' THEN CASE WHEN failures <= 3 THEN {'p': 100, 'n': no, 'u': url, 'd': 0, 'f': NULL, 't': failures} ELSE {'p': NULL, 'n': no, 'u': url, 'd': NULL, 'f': NULL, 't': failures} END
                     ELSE {'p': NULL, 'n': no, 'u': url, 'd': NULL, 'f': NULL, 't': failures} END AS new
            FROM (
                SELECT e.*, g.seen, g.completed, g.failed, list_filter(g.heap, lambda x: NOT list_contains(g.completed, x.u)) AS live,
                       e.depth <= 10 AND NOT list_contains(g.seen, e.url) AS fresh,
                       len(list_filter(g.failed, lambda x: x = e.url)) + CASE WHEN e.event = 'fail' THEN 1 ELSE 0 END AS failures
                FROM g JOIN e ON e.queue = g.queue AND e.no = g.no + 1
            )
        )
    )
    SELECT CAST(queue AS VARCHAR) AS queue, seq, event, url, done, CAST(got.p AS INTEGER) AS priority, CAST(got.d AS INTEGER) AS depth, got.f AS parent, CAST(got.t AS INTEGER) AS tries
    FROM g WHERE seq IS NOT NULL"""


def queue_events(events: DataFrame) -> DataFrame:
    """The event table read as the log of one queue of urls for each user."""
    id_ = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "view", "get").when(id_ % 11 == 0, "requeue").otherwise("put")
    priority = F.element_at(F.array(*[F.lit(x) for x in (0, 10, 50, 80)]), (id_ % 4 + 1).cast("int"))
    return events.select(
        F.col("user_id").alias("queue"), id_.alias("seq"), id_.alias("ts"), kind.alias("event"), F.concat(F.lit("u"), id_ % 23).alias("url"),
        priority.alias("priority"), (id_ % 13).alias("depth"), F.concat(F.lit("p"), id_ % 5).alias("parent"),
    )


@query("z4_queue_log", _QUEUE)
def z4_log(spark: SparkSession, d: str) -> DataFrame:
    return U.replay_queue(queue_events(table(spark, d, "events")))


@query("z6_visit_counts", "SELECT user_id AS norm_url, count(*) AS visits FROM events GROUP BY user_id")
def z6(spark: SparkSession, d: str) -> DataFrame:
    return L.visit_counts(table(spark, d, "events").withColumnRenamed("user_id", "norm_url"))


@query("w8_loop_detection", """WITH e AS (SELECT user_id AS session, event_id AS seq, CAST(event_id % 7 AS VARCHAR) AS url, event_type AS action FROM events),
    w AS (SELECT *, list(url || '|' || action) OVER b AS before, count(*) OVER b AS n, lag(url) OVER (PARTITION BY session ORDER BY seq) AS last, lag(url, 2) OVER (PARTITION BY session ORDER BY seq) AS older FROM e WINDOW b AS (PARTITION BY session ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
    SELECT session, seq, url, action, coalesce(n >= 3 AND (coalesce(len(list_filter(before, lambda x: x = url || '|' || action)), 0) >= 2 OR (older = url AND last <> url)), false) AS loop FROM w""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).cast("string").alias("url"), F.col("event_type").alias("action"))
    return L.loops(rows)


@query("w9_page_states", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_id AS seq, event_type AS hash, event_id % 40 + 1 AS elements, value AS length, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events),
    g AS (SELECT DISTINCT url, 0::BIGINT AS no, NULL::BIGINT AS seq, false AS is_new, []::STRUCT(h VARCHAR, e BIGINT, l DOUBLE)[] AS kept FROM e
      UNION ALL SELECT url, no, seq, NOT known, CASE WHEN known THEN kept ELSE list_append(kept, {'h': hash, 'e': elements, 'l': length})[-5:] END FROM
        (SELECT e.*, g.kept, len(list_filter(g.kept, lambda k: k.h = e.hash OR (CASE WHEN k.e = e.elements THEN 1.0::DOUBLE ELSE least(k.e, e.elements) / greatest(k.e, e.elements, 1)::DOUBLE END + CASE WHEN k.l = e.length THEN 1.0::DOUBLE ELSE least(k.l, e.length) / greatest(k.l, e.length, 1.0::DOUBLE) END) / 2 >= 0.9::DOUBLE)) > 0 AS known
         FROM g JOIN e ON e.url = g.url AND e.no = g.no + 1))
    SELECT url, seq, is_new FROM g WHERE seq IS NOT NULL""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), F.md5(F.col("event_type")).alias("hash"), (F.col("event_id") % 40 + 1).alias("elements"), F.col("value").alias("length"))
    return L.page_states(rows)


@query("z8_hourly_events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z8(spark: SparkSession, d: str) -> DataFrame:
    return L.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("z9_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts, event_id FROM events),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, CAST(no AS BIGINT) AS no, count(*) AS n FROM s GROUP BY 1, 2""")
def z9(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) > 30 * 60 * 1_000_000
    rows = table(spark, d, "events").withColumn("starts", F.when(gap, 1).otherwise(0))
    return rows.withColumn("no", F.sum("starts").over(w)).groupBy("user_id", "no").agg(F.count(F.lit(1)).alias("n"))


@query("z5_retry_delays", "SELECT event_id, CASE WHEN event_type = 'error' THEN 5.0 WHEN event_type = 'view' AND value < 5 THEN 10.0 WHEN event_type = 'click' AND value < 2 THEN 5.0 END AS retry_after FROM events")
def z5(spark: SparkSession, d: str) -> DataFrame:
    """Errors as refusals, quick views as timeouts, the quickest clicks as network faults."""
    kind = F.when((F.col("event_type") == "view") & (F.col("value") < 5), "timeout").when((F.col("event_type") == "click") & (F.col("value") < 2), "network")
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status_code"), kind.alias("error_kind"))
    return rows.select("event_id", L.retry_delay().alias("retry_after"))
