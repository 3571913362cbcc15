"""What a question asks for, as column expressions over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a question about data, and question words.
DATA_WORDS = ["forecast", "projection", "outlook", "trend", "rate", "percent", "%", "growth", "decline", "increase", "decrease", "target", "data", "numbers", "quarterly", "annual", "year", "month", "when", "how much", "what is the"]
QUESTION_WORDS = ["what", "when", "where", "why", "how", "which"]
YEAR = r"((?:19|20)\d{2})"
#: A question of at most so many words without a question word is a keyword search.
KEYWORD_WORDS = 5


def any_within(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring of the lower-cased text."""
    low = F.lower(text)
    found = low.contains(words[0])
    for w in words[1:]:
        found = found | low.contains(w)
    return F.coalesce(found, F.lit(False))


def word_count(text: Column) -> Column:
    """Words between white space, as Unicode has it."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def target_year(text: Column) -> Column:
    """The latest year that the text names, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))


def is_data_query(text: Column) -> Column:
    return any_within(text, DATA_WORDS)


def query_class(text: Column) -> Column:
    """keyword, numerical or semantic."""
    short = (word_count(text) <= KEYWORD_WORDS) & ~any_within(text, QUESTION_WORDS)
    number = text.rlike(r"(?U)\d") | is_data_query(text)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "semantic").when(short, "keyword").when(number, "numerical").otherwise("semantic")


def recency(published: Column, reference_year: Column, scale: float = 1.5) -> Column:
    """exp(-age / scale) by calendar years; 0 for what has no date."""
    age = F.greatest(F.lit(0), reference_year - F.year(published))
    return F.when(published.isNull(), F.lit(0.0)).otherwise(F.exp(-age / F.lit(scale)))
