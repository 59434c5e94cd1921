"""Reading a decision corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import has_text
from ..operators.joins import url_bucket
from ..operators.sizes import broadcast_within
from ..schemas import require_columns
from ..session import cut_lineage

# Bits of ``pos`` that count rows inside one file.
ROW_BITS = 40
# Largest table of file names that is sent to every executor, about two million files.
_FILE_TABLE_BYTES = 256 * 1024 * 1024


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep rows whose text has at least one character that is not white space."""
    return df.filter(has_text(F.col(text)))


def candidate_projection(df: DataFrame) -> DataFrame:
    """Rename corpus columns to the names used here; dates become strings.

    A missing name column yields ``Unnamed``; a null name stays null.
    """

    def pick(source: str, default: str) -> Column:
        return F.col(source).cast("string") if source in df.columns else F.lit(default)

    keep = [F.col("pos")] if "pos" in df.columns else []
    return df.select(
        *keep,
        pick("url_en", "").alias("url"),
        pick("name_en", "Unnamed").alias("name"),
        pick("document_date_en", "").alias("document_date"),
        F.col("unofficial_text_en").alias("text"),
    )


def dev_limit(df: DataFrame, n: int = fixed.DEV_ROW_LIMIT) -> DataFrame:
    """The first ``n`` rows by position."""
    return df.orderBy("pos").limit(n)


def with_file_position(raw: DataFrame) -> DataFrame:
    """Add ``pos``, the row order of the files, from scan metadata: no sort, no shuffle.

    With several files, the files are numbered by path. That table has one row
    per file; it is measured and sent to the scan, so texts stay where they are.
    """
    row = F.col("_metadata.row_index")
    if len(raw.inputFiles()) <= 1:
        return raw.withColumn("pos", row)
    files = cut_lineage(
        raw.select(F.col("_metadata.file_path").alias("_file")).distinct()
        .select("_file", F.row_number().over(Window.orderBy("_file")).alias("_n"))
    )
    tagged = raw.select("*", F.col("_metadata.file_path").alias("_file"), row.alias("_row"))
    pos = F.shiftleft(F.col("_n").cast("long") - 1, ROW_BITS) + F.col("_row")
    return tagged.join(broadcast_within(files, _FILE_TABLE_BYTES), "_file").withColumn("pos", pos).drop("_file", "_n", "_row")


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of fewer files than cores over the cores; leave others alone.

    One small file is one task, and text work is worth more than one core. A
    large corpus has files enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def read_decisions(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Scan a Parquet corpus: check columns, drop blank texts, optionally the first rows."""
    raw = spark.read.parquet(path)
    require_columns(raw, fixed.REQUIRED_COLUMNS)
    decisions = drop_blank_text(candidate_projection(with_file_position(raw)))
    return decisions if max_rows is None else dev_limit(decisions, max_rows)


def write_bucketed(decisions: DataFrame, path: str, buckets: int) -> None:
    """Write a corpus in folders by url bucket, for searches that touch few documents.

    Spark balances the files, so a bucket of much text becomes several.
    """
    tagged = decisions.withColumn("url_bucket", url_bucket(buckets))
    tagged.hint("rebalance", F.col("url_bucket")).write.mode("error").partitionBy(
        "url_bucket").parquet(path)
