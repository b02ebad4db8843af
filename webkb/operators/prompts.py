"""Prompts for injected models as column templates: names in braces are filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    # reading pages
    "summarize": "Sum up the text in at most {sentences} sentences.\n\n{text}",
    "extract_topics": "List the main topics of the text, parted by commas.\n\n{text}",
    "extract_entities": "List the people, organisations, places, products and dates in the text, one a line, as TYPE: name.\n\n{text}",
    "extract_key_facts": "List the key facts of the text, one a line.\n\n{text}",
    "classify_content": "Name the category of the text in a few words.\n\n{text}",
    "extract_relationships": "List the relations in the text, one a line, as subject -> relation -> object.\n\n{text}",
    "clean_text": "Rewrite the text without menus, adverts and notices.\n\n{text}",
    # answering questions
    "interpret_query": "Say what the question asks for and which terms matter.\n\nQuestion: {question}",
    "generate_search_queries": "Write {count} search queries for the question, one a line.\n\nQuestion: {question}",
    "answer_question": "Context:\n{context}\n\nQuestion: {question}\nAnswer:",
    "answer_with_sources": "Sources, numbered:\n{sources}\n\nQuestion: {question}\nAnswer, and name the sources you use as [number]:",
    "refine_answer": "Question: {question}\nAnswer so far: {answer}\n\nMore context:\n{context}\n\nImproved answer:",
    "compare_pages": "Compare {first} with {second}.\n\nContext:\n{context}\n\nQuestion: {question}\nComparison:",
    "synthesize_info": "Join these findings to one answer.\n\n{context}\n\nQuestion: {question}\nAnswer:",
    "conversational_follow_up": "Conversation:\n{history}\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:",
    # cutting texts
    "find_chunk_boundaries": "Give the line numbers where the subject changes.\n\n{text}",
    "summarize_chunk": "Sum up this part of a page in one sentence.\n\n{text}",
    # finding the way
    "assess_page": "Goal: {goal}\nPage: {title} ({url})\n\n{text}\n\n1. Is it relevant (yes, partially, no)?\n2. Found:\n3. Continue?",
    "prioritize_links": "Goal: {goal}\nLinks, numbered:\n{links}\n\nGive each useful link as number: score from 0 to 10 - reason.",
    "visit_decision": "Goal: {goal}\nLink: {text} ({url})\nShould it be visited (yes or no)?",
    "plan_navigation": "Goal: {goal}\nStart: {url}\nWhich kinds of pages should be visited, in what order?",
}


def fields(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TEMPLATES[name])))


def render(name: str, **values: Column | str) -> Column:
    """A template with every field filled, null as empty; a missing or unknown field is an error."""
    if set(values) != set(fields(name)):
        raise ValueError(f"{name} needs {fields(name)}")
    parts = re.split(r"\{(\w+)\}", TEMPLATES[name])
    filled = [F.lit(p) if i % 2 == 0 else F.coalesce((v if isinstance(v := values[p], Column) else F.lit(v)).cast("string"), F.lit("")) for i, p in enumerate(parts)]
    return F.concat(*filled)
