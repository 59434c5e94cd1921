"""Joins between decisions, vectors, hits and the glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glossary import detect_terms, glossary
from ..session import cut_lineage
from .sizes import broadcast_within

def align(decisions: DataFrame, vectors: DataFrame, check: bool = True) -> DataFrame:
    """Vectors of the decisions, with the decisions' positions: pos, url, embedding.

    Only keys take part on the corpus side; texts stay where they are. Fails if
    nothing matches at all; a partial match is fine (see ``missing_vectors``).
    Vectors are repaired and normalised once, here, and not again per query.
    """
    from .vector_blocks import prepare_vectors

    keys = decisions.select("pos", "url")
    if check:
        for side, name in ((keys, "decisions"), (vectors.select("url"), "vectors")):
            if side.isEmpty():
                raise ValueError(f"no {name} to align")
        if keys.join(vectors.select("url"), "url", "left_semi").isEmpty():
            raise ValueError("no decision has a vector: the urls do not match")
    joined = keys.join(vectors.select("url", "embedding"), "url").select("pos", "url", "embedding")
    return prepare_vectors(joined)


def with_vectors(decisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """The decisions that have a vector."""
    return decisions.join(vectors.select("url"), "url", "left_semi")


def missing_vectors(decisions: DataFrame, vectors: DataFrame) -> DataFrame:
    """The decisions that have no vector."""
    return decisions.join(vectors.select("url"), "url", "left_anti")


def new_decisions(decisions: DataFrame, store: DataFrame) -> DataFrame:
    """Decisions whose url is not in the store; a null url is never in it."""
    return decisions.join(store.select("url"), "url", "left_anti")


def url_bucket(buckets: int) -> Column:
    """The bucket of a url, as ``sources.decisions.write_bucketed`` lays a corpus out."""
    return F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")


def hit_documents(hits: DataFrame, decisions: DataFrame, buckets: int | None = None,
                  at_most: int | None = None) -> DataFrame:
    """The decisions that any query hit, each once: one pass over the texts.

    ``hits`` is narrow and materialised. Its distinct urls are broadcast when
    they are few enough (``at_most`` bytes, if known), so texts are filtered
    where they are read. For a corpus laid out in ``buckets``, folders without
    a hit are not read at all.
    """
    urls = hits.select("url").distinct()
    if buckets is not None:
        touched = urls.select(url_bucket(buckets).alias("b")).distinct().collect()
        decisions = decisions.filter(F.col("url_bucket").isin([r["b"] for r in touched]))
    return decisions.join(broadcast_within(urls, at_most=at_most), "url", "left_semi")


def hit_lookup(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hits with the columns of their decisions, joined after the top-k.

    The hits are materialised first, because they are measured and then joined.
    """
    return decisions.join(broadcast_within(cut_lineage(hits)), "url")


def glossary_join(terms: DataFrame) -> DataFrame:
    """Add definition and context to a column ``term``; twelve rows are broadcast."""
    return terms.join(F.broadcast(glossary(terms.sparkSession)), "term")


def get_entry(terms: DataFrame, term: str = "term") -> DataFrame:
    """Look up terms written in any case; unknown terms drop out."""
    entries = glossary(terms.sparkSession)
    return (
        terms.withColumn("_key", F.lower(term))
        .join(F.broadcast(entries.withColumnRenamed("term", "entry")),
              F.col("_key") == F.lower("entry"))
        .drop("_key")
    )


def document_terms(df: DataFrame, key: str = "url", text: str = "text") -> DataFrame:
    """One row per document and glossary term: key, ord, term, definition, context."""
    found = df.select(key, F.posexplode(detect_terms(F.col(text))).alias("ord", "term"))
    return glossary_join(found).select(key, "ord", "term", "definition", "context")


def term_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """How many documents contain each glossary term (terms that occur at all)."""
    found = df.select(F.explode(detect_terms(F.col(text))).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
