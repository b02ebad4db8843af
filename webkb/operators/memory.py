"""Conversation memory: recent turns, token budgets, context windows. Entries: (session, position, role, content, tokens)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turns(entries: DataFrame, n: int, session: str = "session", order: str = "position") -> DataFrame:
    """The last 2n user and assistant entries of each session; n = 0 returns all."""
    turns = entries.where(F.col("role").isin("user", "assistant"))
    if n == 0:
        return turns
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("_b", back).where(F.col("_b") <= 2 * n).drop("_b")


def recent(entries: DataFrame, limit: int, roles: list[str] | None = None, session: str = "session", order: str = "position") -> DataFrame:
    """The newest entries of each session, numbered in order of time."""
    rows = entries.where(F.col("role").isin(roles)) if roles else entries
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    rows = rows.withColumn("_b", back).where(F.col("_b") <= limit).drop("_b")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def fit_history(entries: DataFrame, budget: int, session: str = "session", order: str = "position", tokens: str = "tokens") -> DataFrame:
    """The longest run of last entries whose tokens fit; if not even the last fits, the last two where there are two."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    rows = entries.withColumn("_sum", F.sum(tokens).over(w)).withColumn("_back", F.row_number().over(w))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(session))).withColumn("_last", F.max(F.when(F.col("_back") == 1, F.col(tokens))).over(Window.partitionBy(session)))
    none_fits = (F.col("_last") > budget) & (F.col("_n") >= 2)
    return rows.where((F.col("_sum") <= budget) | (none_fits & (F.col("_back") <= 2))).drop("_sum", "_back", "_n", "_last")


def fit_contexts(sizes: Column, budget: int) -> Column:
    """Places (from 0) of the items that are taken in order while they fit; what doesn't fit is skipped. A first item
    that is too large alone is taken alone. sizes: an array of token counts."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("taken"))
    fold = F.aggregate(
        sizes, start,
        lambda a, x: F.struct(
            F.when(a["used"] + x <= budget, a["used"] + x).otherwise(a["used"]).cast("long").alias("used"),
            (a["at"] + 1).alias("at"),
            F.when(a["used"] + x <= budget, F.array_append(a["taken"], a["at"])).otherwise(a["taken"]).alias("taken"),
        ),
    )["taken"]
    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).when(F.try_element_at(sizes, F.lit(1)) > budget, F.array(F.lit(0))).otherwise(fold)


def session_stats(entries: DataFrame, session: str = "session", tokens: str = "tokens") -> DataFrame:
    return entries.groupBy(session).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("role") == "user").alias("turn_count"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens"))


def transcript(entries: DataFrame, session: str = "session", order: str = "position") -> DataFrame:
    """`User:` and `Assistant:` lines of each session."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    rows = entries.where(F.col("role").isin("user", "assistant")).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("lines"))
    return rows.select(session, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def messages(entries: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Entries of some roles, or all."""
    return entries if roles is None else entries.where(F.col("role").isin(roles))


def set_summary(sessions: DataFrame, summaries: DataFrame, session: str = "session") -> DataFrame:
    """sessions with the new summaries (session, summary); others keep theirs."""
    new = summaries.select(session, F.col("summary").alias("_new"))
    return sessions.join(new, session, "left").withColumn("summary", F.coalesce("_new", "summary")).drop("_new")


def summarize_if_needed(entries: DataFrame, summarizer: Callable[[str], str], least: int = 2000, session: str = "session") -> DataFrame:
    """(session, summary) of the sessions with `least` tokens or more: an injected summarizer reads their transcript."""
    wanted = needs_summary(session_stats(entries, session), least).select(session)
    call = F.pandas_udf(lambda texts: texts.map(summarizer), "string")
    return transcript(entries.join(wanted, session, "left_semi"), session).select(session, call("transcript").alias("summary"))


def needs_summary(stats: DataFrame, least: int = 2000) -> DataFrame:
    return stats.where(F.col("total_tokens") >= least)


def context_budgets(most: int, system: int, reserve: int = 512) -> dict[str, int]:
    """Tokens for retrieved contexts (40 %) and history (30 %) of what the system prompt and the answer leave."""
    free = max(0, most - system - reserve)
    return {"available": free, "context": int(free * 0.4), "history": int(free * 0.3)}


def drop_old_sessions(sessions: DataFrame, entries: DataFrame, now: Column, days: int, session: str = "session") -> tuple[DataFrame, DataFrame]:
    """Sessions and entries without those last updated more than `days` before now."""
    old = sessions.where(F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS")).select(session)
    return sessions.join(old, session, "left_anti"), entries.join(old, session, "left_anti")


def build_context(entries: DataFrame, contexts: DataFrame, most: int, system: int, session: str = "session") -> DataFrame:
    """(session, history, context, tokens): each session's last turns within 30 % and its retrieved contexts (session,
    place, text, tokens) within 40 % of what system prompt and answer leave."""
    budget = context_budgets(most, system)
    turns = fit_history(entries.where(F.col("role").isin("user", "assistant")), budget["history"], session)
    lines = turns.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", F.initcap("role"), "content").alias("line")))).alias("h"), F.sum("tokens").alias("history_tokens"))
    listed = contexts.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("place", "text", "tokens"))).alias("c"))
    taken = listed.withColumn("t", fit_contexts(F.transform("c", lambda x: x["tokens"]), budget["context"]))
    taken = taken.withColumn("c", F.transform("t", lambda i: F.col("c")[i]))
    joined = lines.join(taken, session, "full")
    total = F.coalesce("history_tokens", F.lit(0)) + F.coalesce(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]), F.lit(0))
    text = lambda column, key, glue: F.coalesce(F.array_join(F.transform(column, lambda x: x[key]), glue), F.lit(""))
    return joined.select(session, text("h", "line", "\n").alias("history"), text("c", "text", "\n\n").alias("context"), total.alias("tokens"))
