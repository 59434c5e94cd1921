"""Glossary terms in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..schemas import GLOSSARY
from .text import UNICODE


def glossary(spark: SparkSession) -> DataFrame:
    """The glossary as a small dimension table."""
    return spark.createDataFrame(fixed.GLOSSARY, GLOSSARY)


def _any_term() -> str:
    return "|".join(re.escape(term).replace(r"\ ", " ") for term, _, _ in fixed.GLOSSARY)


def detect_terms(text: Column) -> Column:
    """The glossary terms in a text, lower-cased, in order of first appearance."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"{UNICODE}\b({_any_term()})\b"), F.lit(1))
    return F.array_distinct(found)
