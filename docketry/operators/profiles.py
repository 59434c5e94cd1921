"""Profiles and quality counts of a corpus, its sections and its vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.sections import explode_sections, parse_sections
from ..functions.text import is_truncated
from ..functions.vectors import is_bad, l2_norm
from .dedupe import duplicate_counts
from .joins import missing_vectors
from .vector_blocks import block_stats


def corpus_profile(decisions: DataFrame) -> DataFrame:
    """One row: row count, first and last date, mean text length."""
    return decisions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("document_date").alias("min_date"),
        F.max("document_date").alias("max_date"),
        F.avg(F.length("text")).alias("mean_text_length"),
    )


def marker_coverage(decisions: DataFrame) -> DataFrame:
    """Per structural marker: documents that have it, and their percentage."""
    text = F.col("text")
    markers = {
        "content_marker": text.contains(fixed.CONTENT_MARKER),
        "contents_line": text.contains(fixed.CONTENTS_LINE),
        "footnotes": text.contains(fixed.FOOTNOTE_START),
    }
    counts = decisions.agg(F.count(F.lit(1)).alias("n"),
                           *[F.count_if(hit).alias(name) for name, hit in markers.items()])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("marker"), F.col(name).alias("docs")) for name in markers]))
    return counts.select("n", rows.alias("m")).select(
        "m.marker", "m.docs",
        F.when(F.col("n") > 0, F.col("m.docs") * 100.0 / F.col("n")).alias("percent"))


def heading_frequency(decisions: DataFrame) -> DataFrame:
    """Per heading: in how many sections it occurs."""
    return explode_sections(decisions).groupBy("name").agg(F.count(F.lit(1)).alias("sections"))


def unique_headings(decisions: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: the number of distinct headings, exactly or by a sketch."""
    count = F.approx_count_distinct("name") if approximate else F.count_distinct("name")
    return explode_sections(decisions).agg(count.alias("headings"))


def section_profile(decisions: DataFrame) -> DataFrame:
    """Per document and section: name, priority and length, numbered by (priority, order).

    The number is ``place``; documents are not sorted among each other.
    """
    ordered = F.array_sort(F.transform(parse_sections(F.col("text")), lambda s: F.struct(
        s["priority"].alias("priority"), s["ord"].alias("ord"), s["name"].alias("name"),
        F.length(s["text"]).alias("length"))))
    return decisions.select("url", F.posexplode(ordered).alias("place", "s")).select(
        "url", "place", "s.name", "s.priority", "s.ord", "s.length")


def embedding_profile(vectors: DataFrame, first: int = 10) -> DataFrame:
    """One row: shape, extremes, mean, NaN and infinity flags, tiny values, first norms.

    Tasks reduce whole batches, so no row per element is made. As with arrays,
    one NaN makes the extremes and the mean NaN.
    """
    vec = F.col("embedding")
    stats = block_stats(vectors).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.max("dim").alias("dim"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"),
        (F.sum("total") / F.sum(F.col("n_rows") * F.col("dim"))).alias("mean"),
        F.coalesce(F.bool_or("nan"), F.lit(False)).alias("any_nan"),
        F.coalesce(F.bool_or("inf"), F.lit(False)).alias("any_inf"),
        F.coalesce(F.sum("tiny"), F.lit(0)).alias("n_tiny"))
    norms = (
        vectors.orderBy("pos").limit(first)
        .agg(F.array_sort(F.collect_list(F.struct("pos", l2_norm(vec).alias("norm")))).alias("n"))
        .select(F.transform("n", lambda s: s["norm"]).alias("first_norms")))
    nan = F.lit(float("nan"))
    # Two single rows, folded into one.
    both = stats.unionByName(norms, allowMissingColumns=True)
    row = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    return row.select(
        "n_rows", "dim", F.lit("float32").alias("dtype"),
        F.when(F.col("any_nan"), nan).otherwise(F.col("hi")).alias("max"),
        F.when(F.col("any_nan"), nan).otherwise(F.col("lo")).alias("min"),
        "mean", "any_nan", "any_inf", "n_tiny", "first_norms")


def vector_quality(vectors: DataFrame) -> DataFrame:
    """One row: values that are NaN or infinite, and the vectors that hold them."""
    return block_stats(vectors).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bad_values", "bad_rows")])


def quality_report(decisions: DataFrame, vectors: DataFrame,
                   hits: DataFrame | None = None) -> DataFrame:
    """Everything a load would warn about, as (metric, value) rows."""

    def rows(counts: DataFrame, **metrics: str) -> DataFrame:
        return counts.select(F.explode(F.array(*[
            F.struct(F.lit(metric).alias("metric"), F.col(column).cast("long").alias("value"))
            for metric, column in metrics.items()])).alias("m")).select("m.*")

    parts = [
        rows(vector_quality(vectors), bad_vector_values="bad_values", bad_vector_rows="bad_rows"),
        rows(decisions.agg(F.count_if(is_truncated(F.col("text"))).alias("n")),
             truncated_texts="n"),
        rows(missing_vectors(decisions.select("url"), vectors).agg(
            F.count(F.lit(1)).alias("n")), unmatched_urls="n"),
        rows(duplicate_counts(vectors, "url"), duplicate_urls="duplicates"),
    ]
    if hits is not None:
        parts.append(rows(hits.agg(F.count_if(is_bad(F.col("stage1_score"))).alias("n")),
                          non_finite_scores="n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
