"""Name tokens, code labels, lenient scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no metric meaning.
STOP_WORDS = [
    "of", "the", "an", "and", "or", "to", "in", "on", "at", "by", "for",
    "per", "vs", "with", "from", "as", "is", "not", "no",
]


def content_tokens(name: Column) -> Column:
    """Distinct metric-bearing words: alphabetic, three letters or more, singular."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    stops = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, w))
    folded = F.transform(kept, lambda w: F.when(
        (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"),
        F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(folded)


def humanize_code(code: Column) -> Column:
    """``data.freshness_age`` -> ``Data · freshness age``."""
    spaced = F.trim(F.replace(F.replace(F.coalesce(code, F.lit("")), F.lit("."), F.lit(" · ")), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, F.lit(2), F.length(spaced))))


def blank(text: Column) -> Column:
    """NULL, empty or spaces only."""
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def parse_iso(text: Column) -> Column:
    """Lenient ISO timestamp: the whole text, else its first ten characters, else NULL."""
    trimmed = F.trim(text)
    whole = F.coalesce(trimmed.try_cast("timestamp"), F.substring(trimmed, 1, 10).try_cast("date").cast("timestamp"))
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), whole)  # a cast alone would accept a bare year


def days_ago(now: Column, then: Column) -> Column:
    """Whole days from ``then`` back to ``now``, never negative, NULL when unknown."""
    days = F.date_diff(now.cast("date"), then.cast("date"))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)).cast("bigint"))


def int_or_null(value: Column) -> Column:
    return value.try_cast("double").try_cast("bigint")
