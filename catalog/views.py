"""SYNTHETIC decision view over the ``documents`` table.

The test documents are invented prose without headings, outcomes or
citations, so this view wraps the whole text of every document in the layout of
a decision. Which wording a document gets follows from its id. Nothing in the
library depends on this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.models import encode, hashed_terms
from docketry.operators.vector_blocks import prepare_vectors
from docketry.sources.decisions import spread_small

AS_OF_YEAR = 2026

# Wordings, picked by document id.
OUTCOMES = ["allowed", "dismissed", "considered"]
ISSUES = ["Issue", "Issues", "What I have to decide"]
ANALYSES = ["Analysis", "The law and analysis", "Law and analysis"]
PHRASES = [
    "Section 30 of the Act says that the Minister may decide about just cause.",
    "I find that voluntary leaving was proven on a balance of probabilities.",
    "Therefore, I am satisfied that s. 42 and the Regulation apply to misconduct.",
    "The evidence meets the test in the Canada Pension Plan: a Substantially Gainful job.",
    "I conclude that there was no Just Cause, and just cause is what the law asks for.",
]
HEADER = "Tribunal decision\nCitation: "
CONTENTS = "\nDecision Content\nOn this page\nDecision Overview Issue Analysis Conclusion\n"
BRIDGE = "Reasons and decision\n"
FOOTNOTES = "\nFootnote 1\nSection 1 of the Act.\nFootnote 2\nSection 2 of the Act.\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], id_: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(id_, F.lit(len(values))).cast("int"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, url, name, document_date, text: one decision per document, its whole text inside."""
    d, text = F.col("doc_id"), F.col("text")
    quarter = F.floor(F.length(text) / 4).cast("int")
    piece = [F.substring(text, F.lit(i) * quarter + 1, quarter) for i in range(3)]
    piece.append(F.substring(text, F.lit(3) * quarter + 1, F.length(text)))
    name = F.concat(F.col("source"), F.lit(" v "), d.cast("string"))
    plain = F.concat(*piece)
    structured = F.concat(
        F.when(F.pmod(d, F.lit(4)) == 0, BRIDGE).otherwise(""),
        F.lit("Decision [1] The appeal is "), _pick(OUTCOMES, d), F.lit(".\n"),
        F.lit("Overview\n[2] "), piece[0], F.lit("\n"),
        _pick(ISSUES, d), F.lit(" [3] "), piece[1], F.lit("\n"),
        _pick(ANALYSES, d), F.lit(" [4] "), _pick(PHRASES, d), F.lit("\n[5] "), piece[2],
        F.lit("\n[6] "), piece[3], F.lit("\n"),
        F.lit("Conclusion [7] "), _pick(PHRASES, d + 1), F.lit("\n"),
        F.when(F.pmod(d, F.lit(5)) == 0, FOOTNOTES).otherwise(""))
    year = F.lit(AS_OF_YEAR) - F.pmod(d, F.lit(20))
    return spread_small(table(spark, sf_dir, "documents"), "doc_id").select(
        d.alias("pos"),
        F.concat(F.lit("https://decisions.example/"), d.cast("string")).alias("url"),
        name.alias("name"),
        F.when(F.pmod(d, F.lit(17)) != 0, F.concat(year.cast("string"), F.lit("-01-15")))
        .alias("document_date"),
        F.concat(F.lit(HEADER), name, F.lit(CONTENTS),
                 F.when(F.pmod(d, F.lit(11)) == 0, plain).otherwise(structured)).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table, keyed by the url of the document with the same number."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("pos"),
        F.concat(F.lit("https://decisions.example/"), v.cast("string")).alias("url"),
        "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding asked as a query."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of the conversations as a query."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in vectors of all documents: hashed terms of the whole text, normalised."""
    docs = spread_small(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://decisions.example/"), F.col("doc_id").cast("string"))
        .alias("url"), "text")
    return prepare_vectors(encode(docs, hashed_terms(64), keep=["pos", "url"]))
