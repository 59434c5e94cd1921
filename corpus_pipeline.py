"""A training corpus from raw documents in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each to the shared checkpoint folder as Parquet and reads it back as the next
one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, chunks, decontaminate, quality, similar
from docketry.llm.common import few_files, own_name, passing, table, written
from docketry.llm.queries import THRESHOLD, quality_model, tokenizer_path
from docketry.operators.sizes import broadcast_within
from docketry.session import ship_code


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and blank texts are scored like any other; rows that repeat an id are judged
    each by its own text; a score equal to the threshold stays.
    """
    ship_code(spark)
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir), THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles stays.

    Candidates are found by the vantage-point trees over SimHash fingerprints, then, among texts
    still apart, by shared bands of least values; every link is counted exactly.
    Null and blank texts are one group; of a group the row with the least (id, text digest)
    stays, of rows equal in both the first by its other columns; rows with a null id stay.
    """
    ship_code(spark)
    return few_files(similar.keep_one(docs), docs)


def named_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column more, and its name: the id, and a hash of the text if ids repeat."""
    name, key = own_name(docs, "_id_"), own_name(docs, "_again")
    again = written(few_files(docs.filter("doc_id is not null").groupBy("doc_id").count()
                              .filter("count > 1").select(F.col("doc_id").alias(key))), "again")
    if again.isEmpty():
        return docs.withColumn(name, F.col("doc_id")), name
    text = F.when(F.col(key).isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return docs.join(broadcast_within(again), docs["doc_id"] == F.col(key), "left").withColumn(
        name, F.when(F.col("doc_id").isNotNull(), F.struct(
            F.col("doc_id").alias("id"), text.alias("text")))).drop(key), name


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; texts of which nothing is left go.

    Null and blank texts, and rows with a null id, pass as they are. Rows that repeat an id are
    documents of their own if their texts differ. Of equal passages that of the least id stays.
    """
    ship_code(spark)
    chars = own_name(docs, "_chars")
    rows, name = named_rows(docs.withColumn(chars, F.length("text")))
    spans = written(chunks.repeated_spans(rows, name), "repeats")
    shorter = chunks.cut(rows, spans, name)
    # Rows of which nothing was cut pass as they are.
    changed = F.coalesce(F.length("text") < F.col(chars), F.lit(False))
    left = shorter.filter(~changed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return few_files(left.select(*docs.columns), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and blank texts hold none; rows that repeat an id are judged each by its own text; rows
    with a null id stay; a match at exactly the allowed distance counts.
    """
    ship_code(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them.

    Null texts count as empty; every row gives a row, whatever its id; other columns go.
    """
    import public_tokenizers

    ship_code(spark)
    return bpe.encode_texts(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

# SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; tables inside a stage are deleted once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", kept=True)
    return docs
