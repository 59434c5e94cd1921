"""One query per operator, over whole tables with production parameters, and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chunks, decontaminate, language, neighbours, quality, simhash, simplex, tokens,
               topk, urls, warc, whitening)
from .common import remainder_of_id, scratch, table

THRESHOLD = 0.3
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    found = topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
    return found.select("query_id", "rank", "vec_id", "score")


def op3_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"),
                               tokenizer_path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn(
        "held_out", F.coalesce(remainder_of_id(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = language.fit(docs.filter(~F.col("held_out")))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder_of_id(F.col("doc_id"), 3) == 1, F.lit(False))
                        .alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_texts(table(spark, sf, "documents"),
                            tokenizer_path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN)


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def quality_model(spark: SparkSession, docs: DataFrame, sf: str) -> quality.QualityModel:
    labels = table(spark, sf, "labels").filter(remainder_of_id(F.col("doc_id"), 5) != 0)
    return quality.fit(docs, labels)


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf))
    return scored.select(
        "doc_id", F.coalesce(remainder_of_id(F.col("doc_id"), 5) == 0, F.lit(False))
        .alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf, "documents")).select(
        "doc_id", "begin", "end", F.col("source").alias("source_doc_id"))


def op9_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), RULES)


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.captures(spark, path)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf, "embeddings"))


def op13_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return simplex.cluster(table(spark, sf, "embeddings")).drop("compared")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {q.__name__: q for q in (
    op1_simhash, op2_topk, op3_tokens, op4_language, op5_bpe, op6_decontaminate, op7_quality,
    op8_substrings, op9_urls, op10_warc, op11_whitening, op12_neighbours, op13_clusters, pipeline)}


def clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of op13 as one query: a table of centroids and of places for each."""
    steps = ["""
        v as (
            select row_number() over () as r, vec_id,
                   list_transform(embedding, lambda x: floor(64.0 * x::double)) as x
            from embeddings
            where len(embedding) = 64
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""", f"""
        c0 as (
            select row_number() over (order by h, x) - 1 as c, x
            from (select sha256('1:' || cast(vec_id as varchar)) as h, x from v)
            order by h, x limit {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} as (
            select r, vec_id, x, c, d from (
                select v.r, vec_id, v.x, c,
                       list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, m.x)
                           + list_dot_product(m.x, m.x) as d,
                       row_number() over (partition by v.r order by d, c) as nearest
                from v cross join c{n} as m)
            where nearest = 1)""")
        if n < rounds:
            steps.append(f"""
        p{n + 1} as (
            select c, i, floor(sum(y) / count(*)) as y
            from (select c, unnest(x) as y, generate_subscripts(x, 1) as i from a{n})
            group by c, i),
        c{n + 1} as (
            select c, coalesce(m.x, old.x) as x
            from c{n} as old left join (select c, list(y order by i) as x from p{n + 1} group by c)
                as m using (c))""")
    return "with" + ",".join(steps) + f"""
        select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance,
               cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
               cast(sum(d) over () as bigint) as inertia,
               sha256(array_to_string(list_transform(m.x, lambda y: cast(y as bigint)), ','))
                   as centroid_sha256
        from a{rounds} join c{rounds} as m using (c)"""


ORACLES = {
    "op12_neighbours": """
        with recursive u as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double)
                   as e, coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x)))
                   = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as good
            from embeddings),
        l as (
            select a.r as a, b.r as b from u a join u b
                on a.r <> b.r and a.good and b.good and len(a.e) = len(b.e)
            where list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(r, m) as (
            select r, vec_id from u
            union
            select l.b, reach.m from reach join l on l.a = reach.r),
        least as (select r, min(m) as component_id from reach group by r),
        n as (select a as r, count(*) as n from l group by a)
        select vec_id, coalesce(n, 0) as n_links, component_id,
               vec_id is not distinct from component_id as kept
        from u join least using (r) left join n using (r)""",
    "op13_clusters": clusters_sql(),
    "op2_topk": """
        with v as (
            select row_number() over () as r, vec_id,
                   list_transform(embedding, lambda x: floor(256.0 * x::double)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.r as q, q.vec_id as query_id, c.vec_id,
                   cast(list_dot_product(q.v, c.v) as bigint) as score
            from v q join v c on c.r <> q.r and len(c.v) = len(q.v)
            where q.vec_id % 50 = 0)
        select distinct query_id, cast(n as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by q order by score desc, vec_id) as n
              from s)
        where n <= 5""",
    "op10_warc": """
        with p as (
            select page_id, coalesce(html, '') as html from pages),
        d as (
            select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
                   sha1(html) as payload_digest from p),
        k as (
            select payload_digest as g, max(page_id) as kept from d
            where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest,
               case when kept is null or kept = page_id then 'response' else 'revisit' end
                   as record_type,
               case when kept <> page_id then kept end as refers_to
        from d left join k on g = payload_digest and payload_bytes >= 1000""",
}
