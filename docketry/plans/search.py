"""The search plan: nearest documents, second score, authority order, final choice."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.authority import grounding_factor, outcome
from ..functions.sections import pack_text
from ..functions.text import result_key, snippet
from ..operators.dedupe import dedupe_keep_first
from ..operators.joins import hit_documents
from ..operators.models import (Encoder, Scorer, TokenCounter, document_key, encode_queries,
                                generate_cards, lexical_overlap)
from ..operators.ranking import (assign_rank, authority_rerank, outcome_diversity, rerank_topk)
from ..operators.sizes import BROADCAST_BYTES, broadcast_within, measured_bytes
from ..operators.vector_blocks import semantic_topk
from ..params import NORMAL, SearchParams
from ..schemas import RESULT_COLUMNS
from ..session import cut_lineage, shuffle_partitions


class SearchOutput(NamedTuple):
    """``results``: rows per query in final order; ``summary``: one row per query."""

    results: DataFrame
    summary: DataFrame


def retrieve(queries: DataFrame, vectors: DataFrame, params: SearchParams = NORMAL,
             seed: DataFrame | None = None) -> DataFrame:
    """Stage 1, materialised: at most k narrow rows per query.

    All later stages and the summary start from these rows, and a lost executor
    cannot send the job back to the vector scan.
    """
    return cut_lineage(semantic_topk(queries, vectors, params.stage1_top_k, seed=seed))


def rerank(queries: DataFrame, hits: DataFrame, documents: DataFrame, scorer: Scorer,
           params: SearchParams = NORMAL, at_most: int | None = None) -> DataFrame:
    """Stage 2: pack each hit document once, pair it with its queries, keep the best.

    ``documents`` are the hit documents only. Pairs for a Python scorer, which
    is the costly kind, are spread evenly, since one document may be hit by
    every query.
    """
    packed = documents.select(
        "url", scorer.features(pack_text(F.col("text"), params.pack_chars)).alias("packed"))
    asked = queries.select("query_id", scorer.features(F.col("query")).alias("query"))
    if measured_bytes(asked) <= BROADCAST_BYTES:
        pairs = packed.join(broadcast_within(hits, at_most=at_most), "url").join(F.broadcast(asked), "query_id")
    else:
        # Narrow rows meet first, so that packed texts cross one shuffle, not two.
        pairs = packed.join(hits.join(asked, "query_id"), "url")
    if scorer.python is not None:
        pairs = pairs.repartition(shuffle_partitions(pairs.sparkSession), "query_id", "url")
    return rerank_topk(pairs, scorer, params.stage2_top_k, prepared=True)


def assess_results(top: DataFrame, documents: DataFrame, as_of_year: int | None = None,
                   at_most: int | None = None) -> DataFrame:
    """Stage 2.5: text signals once per surviving document, then order by authority."""
    survivors = documents.join(
        broadcast_within(top.select("url").distinct(), at_most=at_most), "url", "left_semi")
    signals = survivors.select(
        "url", "name", F.col("document_date").alias("date"),
        grounding_factor(F.col("text")).alias("grounding_factor"),
        outcome(F.col("text")).alias("outcome"))
    return authority_rerank(signals.join(broadcast_within(top, at_most=at_most), "url"),
                            text=None, as_of_year=as_of_year)


def attach_text(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """Add snippet and full text to the final rows; texts cross no shuffle by query."""
    texts = documents.select("url", F.col("text").alias("full_text"))
    return (
        texts.join(broadcast_within(ranked), "url")
        .withColumn("snippet", snippet(F.col("full_text"))).select(*RESULT_COLUMNS)
    )


def search(queries: DataFrame, decisions: DataFrame, vectors: DataFrame, *,
           scorer: Scorer = lexical_overlap, params: SearchParams = NORMAL,
           encoder: Encoder | None = None, counter: TokenCounter | None = None,
           as_of_year: int | None = None, seed: DataFrame | None = None,
           buckets: int | None = None) -> SearchOutput:
    """Answer many queries at once.

    ``queries``: query_id, query, and q_vec unless ``encoder`` is given.
    ``decisions``: pos, url, name, document_date, text; of several rows with a
    url the first counts. ``vectors``: url and embedding, one row per url.
    Texts are read in one pass, for hit documents only; stages are materialised.
    A query without hits gets a status in ``summary`` and no result rows.
    An encoder that takes ``max_tokens`` gets the mode's limit; with a ``counter``, queries
    are cut to it, and ``summary`` has a column ``query_cut``.
    ``seed`` (see ``semantic_topk``) and ``buckets`` (see ``hit_documents``)
    save work on very large tables and change no result.
    """
    if encoder is not None:
        queries = cut_lineage(encode_queries(
            queries, encoder, max_tokens=params.embedding_max_tokens, counter=counter,
            cut=None if counter is None else "query_cut"))
    hits = retrieve(queries, vectors, params, seed)
    # One row per url, and spread by url: a scan of many files leaves a few hits in each task.
    # Later narrow tables have no more rows than the hits, and at most two more numbers.
    size = measured_bytes(hits) * 2
    documents = cut_lineage(
        dedupe_keep_first(hit_documents(hits, decisions, buckets, size), "url", "pos"))
    top = cut_lineage(rerank(queries, hits, documents, scorer, params, size))
    assessed = cut_lineage(assess_results(top, documents, as_of_year, size))
    results = attach_text(assign_rank(assessed, params.landscape), documents)
    return SearchOutput(results, _summary(queries, hits, assessed, params))


def status_message(status: Column) -> Column:
    """What to tell a user about a query without results; null when there are some."""
    message = F.lit(None).cast("string")
    for value, text in fixed.STATUS_MESSAGES.items():
        message = F.when(status == value, text).otherwise(message)
    return message


def _summary(queries: DataFrame, hits: DataFrame, assessed: DataFrame,
             params: SearchParams) -> DataFrame:
    n_hits = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_hits"))
    n_results = assessed.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    n, diversity = F.coalesce("_n", F.lit(0)), outcome_diversity(assessed)
    status = (
        F.when(F.col("n_hits").isNull(), "no_candidates")
        .when(n == 0, "none_after_rerank").otherwise("ok"))
    return (
        queries.select("query_id", *[c for c in queries.columns if c == "query_cut"]).join(n_hits, "query_id", "left")
        .join(n_results, "query_id", "left").join(diversity, "query_id", "left")
        .select(
            "query_id", status.alias("status"),
            F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
            F.coalesce("outcome_diversity", F.lit(True)).alias("outcome_diversity"),
            ((n >= 2) & F.lit(params.landscape)).alias("landscape_mode"),
            *(["query_cut"] if "query_cut" in queries.columns else []))
    )


def top_cards(results: DataFrame, generator=None, *, max_chars: int | None = None,
              grounded: bool = False, max_tokens: int | None = None) -> DataFrame:
    """Summary card of every query's best result by authority: query_id, key, url, card.

    The best row is the authority-top one, also when the landscape order puts
    another row first. It is found by narrow columns; texts are read for the
    rows that stay. Whole texts are used unless ``max_chars`` (a model's limit,
    such as ``params.generation_max_chars``) is given; ``max_tokens``
    (``params.generation_max_tokens``) goes to a generator that takes it.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("authority_score"), F.asc("rank"))
    narrow = results.select("query_id", "rank", "authority_score",
                            document_key(F.col("full_text")).alias("document"))
    top = cut_lineage(narrow.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
                      .select("query_id", "rank", "document"))
    rows = results.join(broadcast_within(top.select("query_id", "rank")), ["query_id", "rank"],
                        "left_semi")
    cards = generate_cards(rows, generator, max_chars=max_chars, grounded=grounded,
                           max_tokens=max_tokens)
    return cards.join(broadcast_within(top.select("query_id", "document")), "document").drop(
        "document").select("query_id", "key", "url", "card")
