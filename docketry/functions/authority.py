"""Authority signals of a decision: age, reasoning depth, outcome and labels."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from .text import UNICODE, let


def current_year() -> Column:
    return F.year(F.current_date())


def _year_column(as_of_year: int | Column | None) -> Column:
    if as_of_year is None:
        return current_year()
    return as_of_year if isinstance(as_of_year, Column) else F.lit(int(as_of_year))


def parse_year(date: Column) -> Column:
    """The first four-digit year from 1900 to 2099 in a date text, else null."""
    found = F.regexp_extract(date.cast("string"), UNICODE + fixed.YEAR_PATTERN, 0)
    return F.nullif(found, F.lit("")).try_cast("int")


def recency_from_year(year: Column, as_of_year: int | Column | None = None) -> Column:
    age = F.greatest(F.lit(0), _year_column(as_of_year) - year)
    decay = F.exp(F.lit(-math.log(2)) * age / F.lit(fixed.RECENCY_HALF_LIFE_YEARS))
    return F.when(year.isNull(), F.lit(fixed.UNKNOWN_DATE_FACTOR)).otherwise(decay)


def recency_factor(date: Column, as_of_year: int | Column | None = None) -> Column:
    """Weight in (0, 1] that halves every seven years; 0.5 for an unknown date."""
    return recency_from_year(parse_year(date), as_of_year)


def recency_label_from_year(year: Column, as_of_year: int | Column | None = None) -> Column:
    age = _year_column(as_of_year) - year
    return (
        F.when(year.isNull(), "Unknown")
        .when(age <= fixed.RECENT_MAX_YEARS, "Recent")
        .when(age <= fixed.OLDER_MAX_YEARS, "Older")
        .otherwise("Historical")
    )


def recency_label(date: Column, as_of_year: int | Column | None = None) -> Column:
    """Recent, Older, Historical or Unknown; a date ahead of time is Recent."""
    return recency_label_from_year(parse_year(date), as_of_year)


def relevance_label(score: Column) -> Column:
    return (
        F.when(score >= fixed.HIGH_RELEVANCE, "High")
        .when(score >= fixed.MEDIUM_RELEVANCE, "Medium")
        .otherwise("Low")
    )


def authority_risk_from_year(year: Column, score: Column,
                             as_of_year: int | Column | None = None) -> Column:
    age = F.coalesce(_year_column(as_of_year) - year, F.lit(fixed.UNKNOWN_AGE))
    return (
        F.when((age > fixed.OLDER_MAX_YEARS) | (score < fixed.MEDIUM_RELEVANCE), "Verify")
        .when((age > fixed.RECENT_MAX_YEARS) | (score < fixed.HIGH_RELEVANCE), "Medium")
        .otherwise("Low")
    )


def authority_risk(date: Column, score: Column,
                   as_of_year: int | Column | None = None) -> Column:
    """Low, Medium or Verify, from age and relevance; no date counts as very old."""
    return authority_risk_from_year(parse_year(date), score, as_of_year)


def _citations(lowered: Column) -> Column:
    return F.regexp_count(lowered, F.lit(UNICODE + fixed.CITATION_PATTERN))


def _reasoning(lowered: Column) -> Column:
    """Kinds of reasoning phrase; a plain search for its words goes ahead of each pattern."""
    hits = F.lit(0)
    for pattern, words in zip(fixed.REASONING_PATTERNS, fixed.REASONING_WORDS):
        present = reduce(or_, [lowered.contains(w) for w in words])
        hits = hits + (present & lowered.rlike(UNICODE + pattern)).cast("int")
    return hits


def citation_count(text: Column) -> Column:
    """How many statutory references the text has."""
    return _citations(F.lower(F.coalesce(text, F.lit(""))))


def reasoning_hits(text: Column) -> Column:
    """How many of the six kinds of reasoning phrase occur in the text."""
    return let(F.lower(F.coalesce(text, F.lit(""))), _reasoning)


def grounding_factor(text: Column) -> Column:
    """Weight in [0.75, 1] for an analysis section, citations and reasoning phrases."""

    def factor(lowered: Column) -> Column:
        has_analysis = lowered.contains("analysis") & lowered.rlike(
            UNICODE + fixed.ANALYSIS_PATTERN)
        cap = F.lit(fixed.GROUNDING_PART_CAP)
        total = (
            F.lit(fixed.GROUNDING_BASE)
            + F.when(has_analysis, F.lit(fixed.GROUNDING_ANALYSIS)).otherwise(F.lit(0.0))
            + F.least(cap, _citations(lowered) * F.lit(fixed.GROUNDING_CITATION_STEP))
            + F.least(cap, _reasoning(lowered) * F.lit(fixed.GROUNDING_REASONING_STEP))
        )
        return F.least(F.lit(1.0), total)

    return let(F.lower(F.coalesce(text, F.lit(""))), factor)


def outcome(text: Column) -> Column:
    """Allowed, Dismissed, or Unknown when the head of the raw text says both or neither."""

    def label(head: Column) -> Column:
        allowed = head.rlike(UNICODE + fixed.ALLOWED_PATTERN)
        dismissed = head.rlike(UNICODE + fixed.DISMISSED_PATTERN)
        return (
            F.when(allowed & ~dismissed, "Allowed")
            .when(dismissed & ~allowed, "Dismissed")
            .otherwise("Unknown")
        )

    head = F.substring(F.coalesce(text, F.lit("")), 1, fixed.OUTCOME_SCAN_CHARS)
    return let(F.lower(head), label)


def with_authority(df: DataFrame, score: str, date: str, text: str | None = "text",
                   as_of_year: int | None = None) -> DataFrame:
    """Add the seven authority columns.

    ``text=None`` says that ``grounding_factor`` and ``outcome`` are already
    columns, so that a text shared by many rows is scanned only once.
    """
    if text is not None:
        df = df.withColumns({
            "grounding_factor": grounding_factor(F.col(text)),
            "outcome": outcome(F.col(text)),
        })
    year, value = F.col("_year"), F.col(score)
    return (
        df.withColumn("_year", parse_year(F.col(date)))
        .withColumns({
            "recency_factor": recency_from_year(year, as_of_year),
            "relevance_label": relevance_label(value),
            "recency_label": recency_label_from_year(year, as_of_year),
            "authority_risk": authority_risk_from_year(year, value, as_of_year),
        })
        .withColumn("authority_score", value * F.col("recency_factor") * F.col("grounding_factor"))
        .drop("_year")
    )
