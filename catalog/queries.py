"""One query per operator, over whole test tables and whole texts."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import fixed_values as fixed
from docketry.functions import authority as A
from docketry.functions import cards as C
from docketry.functions import sections as X
from docketry.functions import text as T
from docketry.functions import vectors as V
from docketry.functions.glossary import detect_terms
from docketry.operators import batching, dedupe, joins, models, positions, profiles, ranking
from docketry.operators.vector_blocks import (prepare_vectors, semantic_topk,
                                              semantic_topk_single)
from docketry.params import FAST, NORMAL
from docketry.plans import index, search
from docketry.session import checkpoint_dir, cut_lineage
from docketry.sources import decisions as source
from docketry.sources import vector_store
from docketry.streaming.delta import index_stream, rejected_files

from . import views
from .views import AS_OF_YEAR, table

YEAR = AS_OF_YEAR


def r6(value: Column) -> Column:
    return F.round(value, 6)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources -------------------------------------------------------------------

def read_decisions(spark, sf):
    """Write the view with the corpus column names, then read it as a corpus."""
    path = scratch(spark, "corpus")
    views.decisions(spark, sf).select(
        F.col("name").alias("name_en"), F.col("document_date").alias("document_date_en"),
        F.col("url").alias("url_en"), F.col("text").alias("unofficial_text_en"),
    ).write.parquet(path)
    return source.read_decisions(spark, path).select(
        "url", "name", "document_date", F.md5(F.col("text")).alias("text_md5"))


def read_vectors(spark, sf):
    """Write the vectors twice, as two segments, and read the store: duplicates drop out."""
    path = scratch(spark, "store")
    vecs = views.vectors(spark, sf)
    vector_store.append_vectors(vecs, path)
    vector_store.append_vectors(vecs.withColumn("pos", F.col("pos") + 1_000_000), path)
    return vector_store.read_vectors(spark, path).select(
        "url", "pos", r6(V.l2_norm(F.col("embedding"))).alias("norm"))


def dev_limit(spark, sf):
    return source.dev_limit(views.decisions(spark, sf)).select("pos", "url")


# --- projections and filters ------------------------------------------------------

def drop_blank_text(spark, sf):
    lines = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split(F.col("text"), "\n")).alias("text"))
    return source.drop_blank_text(lines).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"))


def add_position(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return positions.add_position(docs, ["n_chars", "doc_id"])


def candidate_projection(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("url_en"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.pmod("doc_id", F.lit(9000)).cast("int"))
        .alias("document_date_en"),
        F.col("text").alias("unofficial_text_en"))
    return source.candidate_projection(raw).select(
        "url", "name", "document_date", F.length("text").alias("n"))


def snippet(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.snippet(F.col("text")).alias("snippet"),
        T.display_snippet(F.col("text")).alias("shown"))


def score_percent(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", T.score_percent(F.pmod("event_id", F.lit(997)) / 1024).alias("percent"))


def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def truncate_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.truncate_text(F.col("text"))).alias("cut_md5"),
        T.is_truncated(F.col("text")).alias("truncated"))


def prompts(spark, sf):
    query = table(spark, sf, "conversations").filter("role = 'user'")
    return query.select(
        "conv_id", "turn", T.embed_prompt(F.col("text")).alias("embed"),
        T.rerank_query(F.col("text")).alias("rerank"),
        T.rerank_prompt(F.col("text"), F.col("text")).alias("pair"))


def card_prompts(spark, sf):
    return views.decisions(spark, sf).select(
        "url",
        F.md5(T.card_prompt(F.col("text"), NORMAL.generation_max_chars)).alias("card_md5"),
        F.md5(T.card_prompt(F.col("text"), FAST.generation_max_chars, True)).alias("grounded_md5"))


def result_key(spark, sf):
    docs = views.decisions(spark, sf)
    some_url = F.when(F.pmod("pos", F.lit(3)) != 0, F.col("url")).otherwise("")
    return docs.select(
        "pos", T.result_key(some_url, F.col("name"), F.col("document_date")).alias("key"),
        T.result_key(some_url, F.col("name"), F.col("document_date"), "local", True)
        .alias("full_key"))


# --- vectors ---------------------------------------------------------------------

def damaged_vectors(spark, sf):
    """Embeddings in which very low elements become NaN and very high ones infinite."""
    vec = F.transform("embedding", lambda x: F.when(x < -0.3, float("nan")).when(
        x > 0.3, float("inf")).otherwise(x).cast("float"))
    return table(spark, sf, "embeddings").select("vec_id", vec.alias("embedding"))


def _vector_digest(column: str) -> list[Column]:
    total = F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return [F.round(V.l2_norm(F.col(column)), 5).alias("norm"), F.round(total, 4).alias("total"),
            F.round(F.element_at(column, 1).cast("double"), 5).alias("first")]


def sanitize_normalize(spark, sf):
    done = prepare_vectors(damaged_vectors(spark, sf))
    return done.select("vec_id", *_vector_digest("embedding"))


def sanitize_normalize_columns(spark, sf):
    done = damaged_vectors(spark, sf).withColumn(
        "embedding", V.sanitize_and_normalize(F.col("embedding")))
    return done.select("vec_id", *_vector_digest("embedding"))


def sanitize_rows(spark, sf):
    done = damaged_vectors(spark, sf).withColumn(
        "embedding", V.sanitize_rows(F.col("embedding")))
    return done.select("vec_id", *_vector_digest("embedding"))


def vector_quality(spark, sf):
    return profiles.vector_quality(damaged_vectors(spark, sf))


def clamp_score(spark, sf):
    bad = damaged_vectors(spark, sf)
    score = V.clamp_score(V.dot(F.col("embedding"), F.col("embedding")))
    return bad.select("vec_id", r6(score).alias("score"))


def yes_no_probability(spark, sf):
    first, second = (F.get("embedding", i).cast("double") * 10 for i in (0, 1))
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(V.yes_no_probability(first, second)).alias("p"))


def embedding_profile(spark, sf):
    profile = profiles.embedding_profile(views.vectors(spark, sf))
    return profile.select(
        "n_rows", F.col("dim").cast("long").alias("dim"), "dtype", r6(F.col("max")).alias("max"),
        r6(F.col("min")).alias("min"), r6(F.col("mean")).alias("mean"), "any_nan", "any_inf",
        "n_tiny", F.array_join(F.transform("first_norms", lambda x: F.format_string("%.4f", x)),
                               ",").alias("first_norms"))


# --- retrieval and ranking ---------------------------------------------------------

def _hits(spark, sf, **options):
    return semantic_topk(views.vector_queries(spark, sf), views.vectors(spark, sf),
                         NORMAL.stage1_top_k, **options)


def cosine_topk(spark, sf):
    return _hits(spark, sf).select(
        "query_id", "url", "stage1_rank", "stage1_score")


def cosine_topk_grid(spark, sf):
    """The same in blocks of queries, as for more of them than can be broadcast at once."""
    hits = _hits(spark, sf, max_broadcast_queries=400)
    return hits.select(
        "query_id", "url", "stage1_rank", "stage1_score")


def cosine_topk_single(spark, sf):
    """The documents nearest to the mean of all vectors."""
    vecs = views.vectors(spark, sf)
    mean = (
        vecs.select(F.posexplode("embedding").alias("i", "x"))
        .groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i"))
    q_vec = [row["m"] for row in mean.collect()]
    return semantic_topk_single(vecs, q_vec, NORMAL.stage1_top_k)


def hit_lookup(spark, sf):
    found = joins.hit_lookup(_hits(spark, sf), views.decisions(spark, sf))
    return found.select("query_id", "stage1_rank", "url", "name", "document_date",
                        F.length("text").alias("n"))


def _vectors(spark, sf):
    """The documents' vectors, written once: a search passes them more than once."""
    return cut_lineage(views.document_vectors(spark, sf))


def _search(spark, sf, params, decisions=None, vectors=None, **options):
    if decisions is None:
        decisions = views.decisions(spark, sf)
    if vectors is None:
        vectors = _vectors(spark, sf)
    return search.search(views.text_queries(spark, sf), decisions, vectors, params=params,
                         encoder=models.hashed_terms(64), as_of_year=YEAR, **options)


def _result_columns(results):
    return results.select(
        "query_id", "rank", "name", "date", "url", "snippet",
        F.md5("full_text").alias("text_md5"),
        *[r6(F.col(c)).alias(c) for c in ("reranker_score", "authority_score",
                                          "recency_factor", "grounding_factor")],
        "relevance_label", "recency_label", "authority_risk", "outcome", "landscape_role")


def search_normal(spark, sf):
    return _result_columns(_search(spark, sf, NORMAL).results)


def search_fast(spark, sf):
    return _result_columns(_search(spark, sf, FAST).results)


def search_summary(spark, sf):
    return _search(spark, sf, FAST).summary


def search_seeded(spark, sf):
    """Fast search that takes its bars from the embeddings' urls first."""
    vecs = _vectors(spark, sf)
    seed = vecs.join(views.vectors(spark, sf).select("url"), "url", "left_semi")
    return _result_columns(_search(spark, sf, FAST, vectors=vecs, seed=seed).results)


def search_bucketed(spark, sf):
    """Fast search over a corpus laid out by url bucket."""
    path = scratch(spark, "bucketed")
    source.write_bucketed(views.decisions(spark, sf), path, 8)
    return _result_columns(_search(spark, sf, FAST, decisions=spark.read.parquet(path),
                                   buckets=8).results)


def search_statuses(spark, sf):
    """Summaries of three searches: the whole corpus, a store without rows, texts of other urls."""
    docs, vecs = views.decisions(spark, sf), _vectors(spark, sf)
    other = docs.withColumn("url", F.concat(F.lit("other:"), "url"))
    runs = {"all": {"vectors": vecs}, "no_vectors": {"vectors": vecs.filter("url is null")},
            "no_texts": {"decisions": other, "vectors": vecs}}
    return dedupe.union_all(*[
        _search(spark, sf, FAST, **changed).summary.select(F.lit(run).alias("run"), "*")
        for run, changed in runs.items()])


def top_cards(spark, sf):
    """The card of every query's best result."""
    return search.top_cards(_search(spark, sf, FAST).results).select(
        "query_id", "key", "url", F.md5("card").alias("card_md5"))


def top_cards_grounded(spark, sf):
    """The same through a Python generator, which sees the grounded prompt of the whole text."""
    def generator(prompts):
        return ["Hello.\n**Issue:**\n- " + hashlib.md5(p.encode()).hexdigest() for p in prompts]

    cards = search.top_cards(_search(spark, sf, FAST).results, generator, grounded=True)
    return cards.select("query_id", "key", "url", F.md5("card").alias("card_md5"))


def _scored(spark, sf):
    """Results made from the conversations: a score and a date per turn, its text as decision."""
    turns = table(spark, sf, "conversations")
    n = F.col("conv_id") * 7 + F.col("turn") * 3
    said = F.concat(F.lit("The appeal is "), F.get(F.array(
        F.lit("allowed"), F.lit("dismissed"), F.lit("heard")), F.pmod(n, F.lit(3)).cast("int")),
        F.lit(". "), F.col("text"))
    return turns.select(
        F.col("conv_id").alias("query_id"),
        F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("url"),
        F.concat((F.lit(2026) - F.pmod(n, F.lit(16))).cast("string"), F.lit("-05-01"))
        .alias("date"),
        said.alias("text"), (F.pmod(n, F.lit(11)) / 10).alias("reranker_score"),
        (F.col("turn") + 1).cast("int").alias("stage2_rank"))


def rerank_topk(spark, sf):
    """Turns of a conversation ranked against its id as score; the stand-in scorer."""
    turns = table(spark, sf, "conversations")
    first = turns.filter("turn = 0").select("conv_id", F.col("text").alias("query"))
    pairs = turns.join(first, "conv_id").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("url"), "query",
        F.col("text").alias("packed"), (F.col("turn") + 1).cast("int").alias("stage1_rank"))
    ranked = ranking.rerank_topk(pairs, models.lexical_overlap, FAST.stage2_top_k)
    return ranked.select("query_id", "url", "stage2_rank",
                         r6(F.col("reranker_score")).alias("reranker_score"))


def authority_rerank(spark, sf):
    ranked = ranking.authority_rerank(_scored(spark, sf), as_of_year=YEAR)
    return ranked.select("query_id", "url", "authority_rank",
                         r6(F.col("authority_score")).alias("authority_score"))


def landscape(spark, sf):
    assessed = ranking.authority_rerank(_scored(spark, sf), as_of_year=YEAR)
    return ranking.landscape_select(assessed).select(
        "query_id", "url", "rank", "outcome", "landscape_role")


def diversity(spark, sf):
    assessed = ranking.authority_rerank(_scored(spark, sf), as_of_year=YEAR)
    return ranking.outcome_diversity(assessed)


# --- authority -----------------------------------------------------------------------

def parse_year(spark, sf):
    """The first year named in every text of the documents and decisions."""
    return views.decisions(spark, sf).select(
        "url", A.parse_year(F.col("document_date")).alias("date_year"),
        A.parse_year(F.col("text")).alias("text_year"))


def recency(spark, sf):
    date = F.col("document_date")
    return views.decisions(spark, sf).select(
        "url", r6(A.recency_factor(date, YEAR)).alias("factor"),
        A.recency_label(date, YEAR).alias("label"))


def labels(spark, sf):
    date, score = F.col("document_date"), F.pmod("pos", F.lit(101)) / 100
    return views.decisions(spark, sf).select(
        "url", A.relevance_label(score).alias("relevance"),
        A.authority_risk(date, score, YEAR).alias("risk"))


def grounding(spark, sf):
    return views.decisions(spark, sf).select(
        "url", A.citation_count(F.col("text")).alias("citations"),
        A.reasoning_hits(F.col("text")).alias("reasoning"),
        r6(A.grounding_factor(F.col("text"))).alias("factor"))


def outcome(spark, sf):
    return views.decisions(spark, sf).select("url", A.outcome(F.col("text")).alias("outcome"))


def assess(spark, sf):
    scored = views.decisions(spark, sf).withColumn("score", F.pmod("pos", F.lit(101)) / 100)
    done = A.with_authority(scored, "score", "document_date", as_of_year=YEAR)
    return done.select(
        "url", r6(F.col("authority_score")).alias("authority_score"),
        r6(F.col("recency_factor")).alias("recency_factor"),
        r6(F.col("grounding_factor")).alias("grounding_factor"),
        "relevance_label", "recency_label", "authority_risk", "outcome")


# --- sections --------------------------------------------------------------------------

def strip_boilerplate(spark, sf):
    return views.decisions(spark, sf).select(
        "url", F.md5(X.strip_boilerplate(F.col("text"))).alias("body_md5"))


def sections(spark, sf):
    return X.explode_sections(views.decisions(spark, sf)).select(
        "url", "ord", "name", "priority", F.md5("text").alias("text_md5"))


def pack_text(spark, sf):
    docs = views.decisions(spark, sf).select(
        "url", "text", X.parse_sections(F.col("text")).alias("s"))
    packed = docs.select("url", *[
        X.pack_sections(F.col("s"), F.col("text"), budget).alias(f"p{budget}")
        for budget in (300, 1000, FAST.pack_chars, NORMAL.pack_chars)])
    return packed.select("url", *[F.md5(c).alias(c) for c in packed.columns if c != "url"])


def pack_text_strict(spark, sf):
    return views.decisions(spark, sf).select(
        "url", F.md5(X.pack_text(F.col("text"), 1000, strict_budget=True)).alias("p1000"))


def truncate_analysis(spark, sf):
    """Every section of every decision cut to a third of its length."""
    secs = X.explode_sections(views.decisions(spark, sf))
    third = F.floor(F.length("text") / 3).cast("int")
    cut = X.truncate_analysis(F.col("text"), third)
    return secs.select("url", "ord", F.md5(cut).alias("cut_md5"))


def paragraph_markers(spark, sf):
    marks = X.paragraph_markers(F.col("text"))
    return views.decisions(spark, sf).select("url", F.array_join(marks, "").alias("markers"))


def heading_frequency(spark, sf):
    return profiles.heading_frequency(views.decisions(spark, sf))


def unique_headings(spark, sf):
    return profiles.unique_headings(views.decisions(spark, sf))


def section_profile(spark, sf):
    return profiles.section_profile(views.decisions(spark, sf))


def marker_coverage(spark, sf):
    return profiles.marker_coverage(views.decisions(spark, sf)).withColumn(
        "percent", r6(F.col("percent")))


def corpus_profile(spark, sf):
    return profiles.corpus_profile(views.decisions(spark, sf)).withColumn(
        "mean_text_length", F.round("mean_text_length", 4))


def quality_report(spark, sf):
    return profiles.quality_report(views.decisions(spark, sf), views.vectors(spark, sf),
                                   _hits(spark, sf))


# --- glossary and cards ------------------------------------------------------------------

def detect(spark, sf):
    return views.decisions(spark, sf).select(
        "url", F.array_join(detect_terms(F.col("text")), "|").alias("terms"))


def document_terms(spark, sf):
    return joins.document_terms(views.decisions(spark, sf))


def term_frequency(spark, sf):
    return joins.term_frequency(views.decisions(spark, sf))


def get_entry(spark, sf):
    """Every found term looked up in upper case."""
    terms = views.decisions(spark, sf).select(
        "url", F.explode(detect_terms(F.col("text"))).alias("found")).withColumn(
        "term", F.upper("found"))
    return joins.get_entry(terms).select("url", "term", "entry", "definition", "context")


def _raw_card(grounded: bool) -> Column:
    """A card as a model might return it: thinking first, then a greeting."""
    return F.concat(F.lit("<THINK>\nquiet\n</think>Here you are.\n"),
                    C.extractive_card(F.col("text"), grounded), F.lit("\n "))


def sanitize_card(spark, sf):
    card = C.sanitize_card(_raw_card(False))
    return views.decisions(spark, sf).select("url", F.md5(card).alias("card_md5"))


def card_sections(spark, sf):
    cards = views.decisions(spark, sf).select(
        "url", C.sanitize_card(_raw_card(False)).alias("card"))
    parts = cards.select("url", C.card_sections(F.col("card")).alias("p"))
    return parts.select("url", *[F.md5(f"p.{c}").alias(c) for c in (
        "issue", "key_facts", "test_applied", "outcome")])


def claim_sources(spark, sf):
    cards = views.decisions(spark, sf).select(
        "url", C.sanitize_card(_raw_card(True)).alias("card"))
    return C.claim_sources(cards).select(
        "url", "section", "ord", F.md5("claim").alias("claim_md5"), "source_ref", "confidence")


def claim_confidence(spark, sf):
    cards = views.decisions(spark, sf).select(
        "url", C.extractive_card(F.col("text"), True).alias("card"))
    return C.claim_sources(cards).groupBy("section", "confidence").agg(
        F.count(F.lit(1)).alias("claims"))


def generate_cards(spark, sf):
    """A card per distinct decision among twice as many results."""
    docs = views.decisions(spark, sf).select(
        "url", "name", F.col("document_date").alias("date"), F.col("text").alias("full_text"))
    cards = models.generate_cards(docs.unionByName(docs))
    return cards.select("key", "url", F.md5("card").alias("card_md5"))


def cards_without_url(spark, sf):
    """Most decisions share a name and date here, and a third has no url: one card each."""
    docs = views.decisions(spark, sf)
    cards = models.generate_cards(docs.select(
        F.when(F.pmod("pos", F.lit(3)) != 0, F.col("url")).alias("url"),
        F.lit("Unnamed").alias("name"), F.col("document_date").alias("date"),
        F.col("text").alias("full_text")))
    return cards.select("key", "url", F.md5("card").alias("card_md5"))


# --- joins, dedupe and index ---------------------------------------------------------------

def align(spark, sf):
    aligned = joins.align(views.decisions(spark, sf), views.vectors(spark, sf))
    return aligned.select("pos", "url", F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"))


def missing_vectors(spark, sf):
    return joins.missing_vectors(views.decisions(spark, sf), views.vectors(spark, sf)).select(
        "pos", "url")


def new_decisions(spark, sf, docs=None):
    """Decisions not in the store; every seventh has no url and is always new."""
    if docs is not None:
        return joins.new_decisions(docs, views.vectors(spark, sf))
    docs = views.decisions(spark, sf).withColumn(
        "url", F.when(F.pmod("pos", F.lit(7)) != 0, F.col("url")))
    return joins.new_decisions(docs, views.vectors(spark, sf)).select("pos", "url")


def membership_set(spark, sf):
    vecs = views.vectors(spark, sf)
    return dedupe.membership_set(dedupe.union_all(vecs, vecs))


def dedupe_keep_first(spark, sf):
    """Exact copies among the documents, and the hot key of all short ones."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"),
        F.when(F.length("text") < 2000, "short").otherwise(F.md5("text")).alias("url"))
    return dedupe.dedupe_keep_first(docs, "url", "pos")


def duplicate_counts(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("url"))
    return dedupe.duplicate_counts(docs, "url")


def merge_store(spark, sf):
    """The store, and vectors of all documents behind it: written, reported and read back."""
    path = scratch(spark, "store")
    vector_store.append_vectors(views.vectors(spark, sf), path)
    report = vector_store.merge_vectors(
        spark, path, views.document_vectors(spark, sf).withColumn("pos", F.col("pos") + 1_000_000))
    return vector_store.read_vectors(spark, path).select(
        "pos", "url", F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"),
        F.lit(report.total).cast("long").alias("total"),
        F.lit(report.added).cast("long").alias("added"))


def merge_tables(spark, sf):
    """The same without a store: two tables, one row per url."""
    store, fresh = views.vectors(spark, sf), cut_lineage(views.document_vectors(spark, sf))
    merged = dedupe.merge_store(store, fresh.withColumn("pos", F.col("pos") + 1_000_000))
    return merged.select("pos", "url", F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"))


def assign_chunks(spark, sf):
    docs = views.decisions(spark, sf).select("pos", "url", F.length("text").alias("length"))
    return batching.assign_chunks(docs).select("pos", "idx", "chunk_id")


def assign_batches(spark, sf):
    docs = batching.with_tokens(views.decisions(spark, sf)).select("pos", "length", "tokens")
    chunks = batching.assign_chunks(docs)
    return batching.assign_batches(chunks).select(
        "chunk_id", "idx", "tokens", F.col("batch_id").cast("long").alias("batch_id"))


def pending_chunks(spark, sf):
    docs = views.decisions(spark, sf).select("pos", "url", F.length("text").alias("length"))
    planned = batching.assign_chunks(docs)
    return batching.pending(planned, views.vectors(spark, sf)).select("url", "chunk_id")


def plan_route(spark, sf):
    """The route each conversation's worth of text would take, by its characters."""
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("n"))
    return sizes.select("conv_id", "n", batching.route_column(F.col("n")).alias("route"))


def _delta(spark, sf, threshold):
    """Whole texts are encoded: the stand-in has no context limit to cut them for."""
    path = scratch(spark, "store")
    vector_store.append_vectors(views.vectors(spark, sf), path)
    index.delta_index(views.decisions(spark, sf), path, models.hashed_terms(64),
                      threshold=threshold, max_chars=None)
    return vector_store.read_vectors(spark, path).select("url", "pos", *_vector_digest(
        "embedding"))


def _stops(encoder, length: int):
    """An encoder that fails at a text of this length."""
    def run(texts):
        if any(len(t) == length for t in texts):
            raise RuntimeError("broken off")
        return encoder(texts)

    return run


def _broken_off(spark, sf, first, second):
    """A chunked run whose encoder fails at the longest text, then one with another encoder."""
    path, work = scratch(spark, "store"), scratch(spark, "work")
    vector_store.append_vectors(views.vectors(spark, sf), path)
    docs = views.decisions(spark, sf)
    longest = new_decisions(spark, sf, docs).agg(F.max(F.length("text"))).first()[0]
    try:
        index.delta_index(docs, path, _stops(first, longest), threshold=1, chunk_size=100,
                          work_path=work)
    except Exception as error:
        if "broken off" not in str(error):
            raise
    index.delta_index(docs, path, second, threshold=1, chunk_size=100, work_path=work)
    return vector_store.read_vectors(spark, path).select("url", "pos", *_vector_digest(
        "embedding"))


def delta_resume(spark, sf):
    """A chunked run that was broken off: the chunks it had written are not encoded again."""
    return _broken_off(spark, sf, models.hashed_terms(64), models.hashed_terms(64))


def delta_other_encoder(spark, sf):
    """A run broken off with one encoder of a factory and gone on with another: nothing is mixed."""
    return _broken_off(spark, sf, models.hashed_terms(32), models.hashed_terms(64))


def delta_token_limit(spark, sf):
    """The delta with an encoder that counts: texts are cut at 50 words, and it sees so many."""
    path = scratch(spark, "store")
    counter = models.TokenCounter(
        lambda text: [m.end() for m in re.finditer(r"[^ ]+", text)])

    def counting(texts, max_tokens):
        return [[len([w for w in t.split(" ") if w]), len(t), max_tokens] for t in texts]

    report = index.delta_index(views.decisions(spark, sf), path, counting, max_tokens=50,
                               counter=counter, threshold=1)
    return vector_store.read_vectors(spark, path).select(
        "url", *[F.col("embedding")[i].cast("long").alias(name)
                 for i, name in enumerate(("words", "chars", "most"))],
        F.lit(report.cut).cast("long").alias("texts_cut"))


def compact_store(spark, sf):
    """Segments that repeat urls, merged by key range into one; what readers see stays."""
    path, vecs = scratch(spark, "store"), views.vectors(spark, sf)
    for part in range(3):
        vector_store.append_vectors(vecs.filter(F.col("pos") % 3 >= part).withColumn(
            "pos", F.col("pos") + 1_000_000 * (2 - part)), path)
    report = vector_store.compact(spark, path)
    return vector_store.read_vectors(spark, path).select(
        "url", "pos", F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"),
        F.lit(report.total).cast("long").alias("total"),
        F.lit(report.segments).cast("long").alias("segments"))


def delta_reindex(spark, sf):
    """A store filled by one encoder, put back, and filled by another."""
    path, docs = scratch(spark, "store"), views.decisions(spark, sf)
    vector_store.append_vectors(views.vectors(spark, sf), path)
    index.delta_index(docs, path, models.hashed_terms(32), threshold=1)
    vector_store.write_vectors(views.vectors(spark, sf), path)
    index.delta_index(docs, path, models.hashed_terms(64), threshold=1)
    return vector_store.read_vectors(spark, path).select("url", "pos", *_vector_digest(
        "embedding"))


def build_index(spark, sf):
    """The store aligned to the decisions, normalised, written and read back."""
    built = index.build_index(views.decisions(spark, sf), views.vectors(spark, sf),
                              scratch(spark, "index"))
    return built.select("pos", "url", F.round(V.l2_norm(F.col("embedding")), 4).alias("norm"))


def write_vectors(spark, sf):
    """A store of two segments is replaced by vectors of all documents."""
    path = scratch(spark, "store")
    vector_store.append_vectors(views.vectors(spark, sf), path)
    vector_store.append_vectors(views.vectors(spark, sf), path)
    vector_store.write_vectors(views.document_vectors(spark, sf), path)
    return vector_store.read_vectors(spark, path).select("url", "pos", *_vector_digest(
        "embedding"))


def delta_index(spark, sf):
    return _delta(spark, sf, fixed.CHUNKED_WRITE_THRESHOLD)


def delta_index_chunked(spark, sf):
    return _delta(spark, sf, 1)


def delta_stream(spark, sf):
    """The decisions arrive as files; the stream adds those the store lacks.

    Among the files are one of another layout, one whose text is a number and one with
    rows of nulls; dates are text in some files and dates in others.
    """
    root = scratch(spark, "stream")
    vector_store.append_vectors(views.vectors(spark, sf), f"{root}/store")
    arriving = views.decisions(spark, sf).select(
        F.col("name").alias("name_en"), F.col("document_date").alias("document_date_en"),
        F.col("url").alias("url_en"), F.col("text").alias("unofficial_text_en"),
        F.col("pos"))
    for part, day in ((0, "string"), (1, "date")):
        arriving.filter(F.col("pos") % 2 == part).drop("pos").withColumn(
            "document_date_en", F.col("document_date_en").try_cast(day)).repartition(3).write.mode(
            "append").parquet(f"{root}/in")
    nothing = arriving.drop("pos").limit(3)
    nothing.select(*[F.lit(None).cast("string").alias(c) for c in nothing.columns]).coalesce(
        1).write.mode("append").parquet(f"{root}/in")
    nothing.select(F.lit("x").alias("title"), "url_en").coalesce(1).write.mode("append").parquet(
        f"{root}/in")
    nothing.withColumn("unofficial_text_en", F.lit(1)).coalesce(1).write.mode("append").parquet(
        f"{root}/in")
    index_stream(spark, f"{root}/in", f"{root}/store", models.hashed_terms(64),
                 f"{root}/checkpoint", files_per_batch=5).awaitTermination()
    set_aside = rejected_files(spark, f"{root}/checkpoint").count()
    return vector_store.read_vectors(spark, f"{root}/store").select(
        "url", *_vector_digest("embedding"), F.lit(set_aside).cast("long").alias("files_set_aside"))


def encode_documents(spark, sf):
    return views.document_vectors(spark, sf).select("url", *_vector_digest("embedding"))


def score_pairs(spark, sf):
    """Each turn against the turn before it, by a Python scorer."""
    turns = table(spark, sf, "conversations")
    previous = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    pairs = turns.join(previous, ["conv_id", "turn"])
    scorer = models.Scorer(python=lambda queries, docs: [
        len(q) / (len(q) + len(d)) for q, d in zip(queries, docs)])
    return models.score_pairs(pairs, scorer, "query", "text").select(
        "conv_id", "turn", r6(F.col("reranker_score")).alias("score"))


QUERIES = {f.__name__: f for f in (
    read_decisions, read_vectors, dev_limit, drop_blank_text, add_position, candidate_projection,
    snippet, score_percent, estimate_tokens, truncate_text, prompts, card_prompts, result_key,
    sanitize_normalize, sanitize_normalize_columns, sanitize_rows, vector_quality, clamp_score,
    yes_no_probability, embedding_profile, cosine_topk, cosine_topk_grid, cosine_topk_single,
    hit_lookup, search_normal, search_fast, search_summary, rerank_topk, authority_rerank,
    landscape, diversity, parse_year, recency, labels, grounding, outcome, assess,
    strip_boilerplate, sections, pack_text, pack_text_strict, truncate_analysis,
    paragraph_markers, heading_frequency, unique_headings, section_profile, marker_coverage,
    corpus_profile, quality_report, document_terms, term_frequency, get_entry, sanitize_card,
    card_sections, claim_sources, claim_confidence, generate_cards, align, missing_vectors,
    new_decisions, membership_set, dedupe_keep_first, duplicate_counts, merge_store,
    assign_chunks, assign_batches, pending_chunks, plan_route, delta_index, delta_index_chunked,
    delta_stream, encode_documents, score_pairs, search_seeded, search_bucketed, search_statuses,
    top_cards, top_cards_grounded, cards_without_url, delta_resume, delta_reindex, build_index,
    write_vectors, merge_tables, delta_other_encoder, delta_token_limit, compact_store)}
QUERIES["detect_terms"] = detect
