"""Text columns: cleaning, hashes, summaries, fixed chunks and parsers of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

# Phrases of an answer that knows nothing.
UNCERTAIN = ("i don't have enough information", "the context doesn't", "cannot find", "not mentioned", "no information", "unclear from", "i'm not sure")
# Names of entity types in model output.
ENTITY_TYPES = {
    "person": "person", "people": "person", "organization": "organization", "org": "organization", "company": "organization",
    "location": "location", "place": "location", "city": "location", "country": "location", "product": "product", "date": "date", "time": "date",
}


def clean(text: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    """16 hex digits of the cleaned text's SHA-256."""
    return F.substring(F.sha2(clean(text), 256), 1, 16)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def last_index(text: Column, what: str) -> Column:
    """Place (from 0) of the last `what`, -1 if there is none."""
    at = F.locate(what[::-1], F.reverse(text))
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(what) + 1)


def summary(text: Column, most: int = 500) -> Column:
    """Short texts as they are; else up to the last full stop, or the last space with dots."""
    head = F.substring(text, 1, most)
    stop, space = last_index(head, "."), last_index(head, " ")
    cut = F.when(stop > most * 3 // 5, F.substr(head, F.lit(1), stop + 1)).otherwise(F.concat(F.when(space >= 0, F.substr(head, F.lit(1), space)).otherwise(F.substr(head, F.lit(1), F.greatest(F.lit(0), F.length(head) - 1))), F.lit("...")))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def fallback_answer(text: Column, title: Column, most: int = 400) -> Column:
    """A retrieved text as an answer: cut at a sentence in its second half, else at a late word; then its source."""
    whole = F.trim(text)
    head = F.substring(whole, 1, most)
    stop = F.greatest(last_index(head, ". "), last_index(head, "? "), last_index(head, "! "))
    space = last_index(head, " ")
    cut = F.when(stop > most * 0.5, F.substr(head, F.lit(1), stop + 1)).when(space > most * 0.7, F.concat(F.substr(head, F.lit(1), space), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    body = F.when(F.length(whole) > most, cut).otherwise(whole)
    return F.when(F.coalesce(title, F.lit("")) == "", body).otherwise(F.concat(body, F.lit("\n\n[Source: "), title, F.lit("]")))


def token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 1).cast("int")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def fixed_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Chunks of `size` characters that share `overlap`: array of (index, start_char, end_char, text)."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    length = F.length(text)
    count = F.greatest(F.lit(1), F.ceil((length - overlap) / (size - overlap)).cast("int"))

    def chunk(i: Column) -> Column:
        start = i * (size - overlap)
        end = F.least(start + size, length)
        return F.struct(i.alias("chunk_index"), start.alias("start_char"), end.alias("end_char"), F.substr(text, start + 1, end - start).alias("text"))

    return F.when(F.trim(text) == "", F.array().cast("array<struct<chunk_index:int,start_char:int,end_char:int,text:string>>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), chunk))


def chunk_estimate(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    length = F.length(text)
    return F.when(length == 0, 0).when(length <= size, 1).otherwise(F.greatest(F.lit(1), F.ceil(length / (size - overlap)).cast("int")))


def is_uncertain(answer: Column) -> Column:
    found = F.lit(False)
    for phrase in UNCERTAIN:
        found = found | F.lower(answer).contains(phrase)
    return found


def topics(text: Column) -> Column:
    """Comma-separated topics, stripped of list marks, ten at most."""
    each = F.transform(F.split(text, ","), lambda t: F.regexp_replace(F.trim(t), r"^[.\-•*]+|[.\-•*]+$", ""))
    return F.slice(F.filter(each, lambda t: (F.length(t) > 1) & (F.length(t) < 100)), 1, 10)


def key_points(text: Column) -> Column:
    """Lines without their list marks, between 11 and 499 characters, five at most."""
    each = F.transform(F.split(text, "\n"), lambda t: F.regexp_replace(F.trim(t), r"^[.\-•*1-9)]+|[.\-•*1-9)]+$", ""))
    return F.slice(F.filter(each, lambda t: (F.length(t) > 10) & (F.length(t) < 500)), 1, 5)


def facts(text: Column) -> Column:
    """Like key points, but between 16 and 499 characters and the first of equals in any case."""
    each = F.transform(F.split(text, "\n"), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^[.\-•*0-9)]+|[.\-•*]+$", "")))
    kept = F.filter(each, lambda t: (F.length(t) > 15) & (F.length(t) < 500))
    return F.filter(kept, lambda t, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda e: F.lower(e) == F.lower(t)))


def entities(text: Column) -> Column:
    """Lines of the form `TYPE: name` as (type, name)."""
    kinds = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda t: t.rlike(r"^(\w+):\s*(.+)$"))
    each = F.transform(lines, lambda t: F.struct(F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(t, r"^(\w+):", 1))), F.lit("other")).alias("type"), F.trim(F.regexp_extract(t, r"^\w+:\s*(.+)$", 1)).alias("name")))
    return F.filter(each, lambda e: F.length(e["name"]) > 1)


def relationships(text: Column) -> Column:
    """Lines of three parts around arrows as (subject, predicate, object)."""
    each = F.transform(F.split(text, "\n"), lambda t: F.split(F.trim(t), r"\s*->\s*"))
    whole = F.filter(each, lambda p: (F.size(p) == 3) & ~F.exists(p, lambda x: x == ""))
    return F.transform(whole, lambda p: F.struct(F.trim(p[0]).alias("subject"), F.trim(p[1]).alias("predicate"), F.trim(p[2]).alias("object")))


def category(text: Column) -> Column:
    first = F.regexp_replace(F.split(F.lower(F.trim(text)), "\n")[0], r"^\.+|\.+$", "")
    return F.when(F.length(first) < 50, first).otherwise(F.lit("article"))


def cited(answer: Column, number: Column, title: Column) -> Column:
    """Whether an answer names a source by [number] or by its title; an empty title always counts."""
    return answer.contains(F.concat(F.lit("["), number.cast("string"), F.lit("]"))) | F.lower(answer).contains(F.lower(title))
