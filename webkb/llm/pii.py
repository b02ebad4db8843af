"""Personal data by base patterns and bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the hits of four base patterns (email, ip, card, phone). A seed induces lexical patterns of five forms:
the two words before it, the word before it, the words on both sides, the two words after it, and the word before
it with the seed's shape. Candidates are the other identifier-like stretches: neighbouring words, one space apart,
that all hold a digit or an @, without the punctuation around them ("030 1234 5678", "(555) 123-4567", "q5@lan",
"AB-1234"). Spark then scores the graph of patterns and instances, round by round:

  pattern (words, kind):  the confidence of its known instances of that kind over all its instances, counted by
                          distinct value; it is used from MIN_SUPPORT known ones and a weight above one half
  instance (value, kind): noisy-or over the patterns that extract it; accepted from MIN_CONFIDENCE upwards, if it has
                          what its kind can't do without (NEEDS); of several kinds the surest, then the first, counts

Accepted instances support patterns in the next round; rounds go on until one accepts nothing new. Texts are read
once. What follows works on the hits alone, and every step is a join or an aggregate by value or pattern, or a
window over one document's hits, so no key needs one task.

Positions are code points, end exclusive. Null text counts as empty; an empty table gives no rows. Rows that repeat a
doc_id stay rows of their own, null ids too; extra columns are left alone, whatever their names. Places come from
running sums over a document's hits and contexts from the words between hits, without backtracking, so that long
words, long digit runs and documents with very many hits cost time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

KINDS = ("email", "ip", "card", "phone")
PIECE = len(KINDS)  # number of the words that candidates are made of
MIN_SUPPORT = 5.0
MIN_CONFIDENCE = 0.8

_LOCAL = "A-Za-z0-9._%+-"
#: Each finds the base pattern's leftmost matches; a run is entered at its start or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an instance of a kind can't do without.
NEEDS = {"email": "@", "ip": "[0-9a-fA-F][.:][0-9a-fA-F]", "card": "(?:[0-9][^0-9]*+){4}", "phone": "(?:[0-9][^0-9]*+){4}"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_HIT = "array<struct<no:int,i:int,gap:int,hit:string,near:boolean,before:array<string>,after:array<string>>>"


def _hits(text: Column, no: int, pattern: str) -> Column:
    """Matches in order: kind number, place in the order, length of the text since the last match, the match, whether one space
    parts it from the last match, and the two words on either side."""

    def row(gaps: Column, hits: Column, i: Column) -> Column:
        left = F.when(i > 0, F.concat(F.get(hits, i - 1), F.get(gaps, i))).otherwise(F.get(gaps, i))
        right = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit("")))
        return F.struct(
            F.lit(no).alias("no"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.get(hits, i).alias("hit"), ((i > 0) & (F.get(gaps, i) == " ")).alias("near"),
            _words(left, -1, -2).alias("before"), _words(right, 1, 2).alias("after"),
        )

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.transform(hits, lambda _, i: row(gaps, hits, i)))).cast(_HIT)


def _words(text: Column, *places: int) -> Column:
    """The words at these places, null where there is none."""
    words = F.split(F.regexp_replace(text, r"^\s+|(?<!\s)\s++$", ""), r"\s+")
    return let(words, lambda w: F.array(*[F.try_element_at(w, F.lit(p)) for p in places]))


def _plain(word: Column) -> Column:
    """A context word: lower case, digits as 9, without punctuation around it."""
    low = F.regexp_replace(F.lower(word), "[0-9]", "9")
    bare = F.regexp_replace(low, r"^[^\p{L}9]+|(?<![^\p{L}9])[^\p{L}9]++$", "")
    return F.nullif(F.when(bare == "", low).otherwise(bare), F.lit(""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(
        F.split(digits, ""),
        lambda d, i: let(F.coalesce(d.try_cast("int"), F.lit(0)) * (F.lit(1) + i % 2), lambda n: n - F.when(n > 9, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(no: Column, value: Column) -> Column:
    """Whether a match of a base pattern is a hit."""
    ip = value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    return F.when(no == 1, ip).when(no == 2, _luhn(value)).when(no == 3, F.length(_digits(value)).between(9, 15)).otherwise(True)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of every document: row (a number of the document), doc_id, no (kind, or PIECE for a candidate), start, end,
    value, before and after. A document without any has one row with no null."""
    text, none = F.col("_text"), F.array().cast(_HIT)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    digit = text.rlike("[0-9]")
    may = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    found = [F.when(may[k], _hits(text, no, PATTERNS[k])).otherwise(none) for no, k in enumerate(KINDS)]
    found.append(F.when(text.rlike("[0-9@]"), _hits(text, PIECE, _WORD)).otherwise(none))
    hits = rows.select("row", "doc_id", F.explode_outer(F.concat(*found)).alias("h")).select("row", "doc_id", "h.*").repartition("row")

    size = F.length("hit")
    upto = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "no").orderBy("i"))
    spans = hits.withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - size)
    spans = spans.where(F.col("no").isNull() | (F.col("no") == PIECE) | _valid(F.col("no"), F.col("hit")))
    order = Window.partitionBy("row").orderBy("start", "no", "end")
    base = F.col("no") < PIECE
    over = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("no"), F.desc("end"))  # running sums both ways: a frame up to the end costs the square
    under = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    clear = (F.coalesce(over, F.lit(0)) <= F.col("start")) & F.coalesce(under >= F.col("end"), F.lit(True))
    spans = spans.withColumn("clear", clear).where(F.col("no").isNull() | base | F.col("clear"))
    # words one space apart are one candidate; what ends at a base hit or another word starts a new one
    piece = F.col("no") == PIECE
    fresh = ~F.coalesce(piece & F.col("near") & (F.lag("no").over(order) == PIECE) & (F.lag("end").over(order) + 1 == F.col("start")), F.lit(False))
    spans = spans.withColumn("run", F.sum(fresh.cast("int")).over(order))
    merged = spans.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("no").alias("no"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "hit"))), lambda x: x["hit"]), " ").alias("hit"),
        F.min_by("before", "start").alias("before"), F.max_by("after", "start").alias("after"),
    )
    lead = F.when(F.col("no") == PIECE, F.length(F.regexp_extract("hit", r"^[^\p{L}0-9@+(]*", 0))).otherwise(0)
    tail = F.when(F.col("no") == PIECE, F.length(F.regexp_extract("hit", r"(?<![^\p{L}0-9@)])[^\p{L}0-9@)]*+$", 0))).otherwise(0)
    return merged.select(
        "row", "doc_id", "no", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"),
        F.expr("hit").substr(lead + 1, F.col("end") - F.col("start") - lead - tail).alias("value"), "before", "after",
    )


def _patterns(spans: DataFrame) -> DataFrame:
    """spans with pattern, one row for each lexical pattern around the span."""
    b1, b2, a1, a2 = (_plain(F.get(c, F.lit(i))) for c in ("before", "after") for i in (0, 1))
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), r"\p{L}+", "a")
    forms = (F.concat_ws(" ", F.lit("l2"), b2, b1), b2, b1), (F.concat_ws(" ", F.lit("l1"), b1), b1), (F.concat_ws(" ", F.lit("lr"), b1, F.lit("_"), a1), b1, a1), (F.concat_ws(" ", F.lit("r2"), a1, a2), a1, a2), (F.concat_ws(" ", F.lit("ls"), b1, shape), b1)
    every = []
    for text, *needed in forms:
        there = F.lit(True)
        for word in needed:
            there = there & word.isNotNull()
        every.append(F.when(there, text))
    return spans.select("no", "value", F.explode(F.array_compact(F.array(*every))).alias("pattern"))


def bootstrap(spans: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Candidate values that the pattern-instance graph accepts: value, no (kind number) and confidence."""
    edges = materialise(_patterns(spans.where("no IS NOT NULL AND value <> ''")).groupBy("pattern", "no", "value").count().drop("count"))
    known = edges.where(F.col("no") < PIECE)
    # a value that is a seed anywhere needs no scoring
    open_edges = edges.where(F.col("no") == PIECE).select("pattern", "value")
    totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("total"))
    held = known.select("pattern", "no", F.lit(1.0).alias("confidence"))
    needs = F.lit(False)
    for no, kind in enumerate(KINDS):
        needs = needs | ((F.col("no") == no) & F.col("value").rlike(NEEDS[kind]))
    accepted, before = None, 0
    while True:
        if accepted is not None:
            held = known.select("pattern", "no", F.lit(1.0).alias("confidence")).unionByName(open_edges.join(accepted, "value").select("pattern", "no", "confidence"))
        patterns = held.groupBy("pattern", "no").agg(F.sum("confidence").alias("support")).where(F.col("support") >= min_support)
        patterns = patterns.join(totals, "pattern").select("pattern", "no", (F.col("support") / F.col("total")).alias("weight")).where("weight > 0.5")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("weight"))))
        scored = open_edges.join(patterns, "pattern").where(needs).groupBy("value", "no").agg((1 - F.exp(doubt)).alias("confidence")).where(F.col("confidence") >= min_confidence)
        best = scored.groupBy("value").agg(F.max(F.struct(F.round("confidence", 9).alias("confidence"), (-F.col("no")).alias("first"))).alias("best"))
        found = best.select("value", (-F.col("best.first")).cast("int").alias("no"), F.col("best.confidence").alias("confidence"))
        if accepted is not None:  # what was accepted stays so, as its kind
            found = accepted.unionByName(found.join(accepted.select("value"), "value", "left_anti"))
        accepted = materialise(found)
        now = accepted.count()
        if now == before:
            return accepted
        before = now


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row for each document: doc_id, base and added, arrays of (start, no, end) with the kind's number, sorted."""
    spans = materialise(scan(docs, id_col, text_col))
    accepted = bootstrap(spans, **params).select("value", F.col("no").alias("kind"))
    rows = spans.select("row", "doc_id", "no", "start", "end", F.when(F.col("no") == PIECE, F.col("value")).alias("value")).join(accepted, "value", "left")
    base = F.when(F.col("no") < PIECE, F.struct("start", "no", "end"))
    added = F.when(F.col("no") == PIECE, F.when(F.col("kind").isNotNull(), F.struct("start", F.col("kind").alias("no"), "end")))
    found = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(base)).alias("base"), F.array_sort(F.collect_list(added)).alias("added"))
    return found.select(F.col("doc_id").alias(id_col), "base", "added")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["no"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digest columns of the result of find(): counts and base_sha256 are of the base spans, spans lists all."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "added"))
    return found.select(id_col, *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))
