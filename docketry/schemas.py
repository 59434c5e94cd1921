"""Column layouts shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

DECISIONS = "pos long, url string, name string, document_date string, text string"
VECTORS = "pos long, url string, embedding array<float>"
QUERIES = "query_id long, query string, q_vec array<float>"
HITS = "query_id long, url string, stage1_score double, stage1_rank int"
SECTIONS = "array<struct<name:string,text:string,priority:int,ord:int>>"
GLOSSARY = "term string, definition string, context string"

RESULT_COLUMNS = [
    "query_id", "rank", "name", "date", "url", "reranker_score", "snippet", "full_text",
    "authority_score", "recency_factor", "grounding_factor", "relevance_label",
    "recency_label", "authority_risk", "outcome", "landscape_role",
]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail, before any job starts, when ``df`` lacks a column; list what is there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available columns {df.columns}")
    return df
