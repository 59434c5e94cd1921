"""Extension points for models: encoder, pair scorer and card generator.

The user brings plain functions over lists of texts; Spark feeds them Arrow
batches. No model ships with this library: ``hashed_terms``, ``lexical_overlap``
and ``extractive_card`` are STAND-INS that exercise the data flow and say
nothing about ranking quality.
"""

from __future__ import annotations

import hashlib
import inspect
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions.cards import extractive_card, sanitize_card
from ..functions.text import card_prompt, embed_prompt, result_key
from ..session import bound_arrow_batches, cut_lineage
from .batching import token_estimate
from .dedupe import dedupe_keep_first
from .sizes import broadcast_within

# list of texts -> (n, d) array; may take ``max_tokens`` as well
Encoder = Callable[[list[str]], np.ndarray]
# column form (query, document) -> score, or Python form (queries, documents) -> scores
ColumnScorer = Callable[[Column, Column], Column]
PythonScorer = Callable[[list[str], list[str]], Sequence[float]]
# list of prompts -> list of cards; may take ``max_tokens`` as well
Generator = Callable[[list[str]], list[str]]

# Bytes of texts that a worker gets at once: it holds such a batch, its copy and the batch before.
TEXT_BYTES = 4 << 20

# Fixed value: a term of the stand-ins.
TERM_PATTERN = "[0-9a-zß-ÿ]+"


@dataclass(frozen=True)
class TokenCounter:
    """A model's tokenizer, as far as limits need it: where each token of a text ends."""

    ends: Callable[[str], Sequence[int]]

    def cut(self, text: str, max_tokens: int) -> tuple[str, bool]:
        """The text up to its ``max_tokens``-th token, and whether that is less than all of it."""
        ends = self.ends(text)
        if len(ends) <= max_tokens:
            return text, False
        return text[:ends[max_tokens - 1]] if max_tokens > 0 else "", True


def with_limit(model: Callable, max_tokens: int | None) -> Callable:
    """The model with its token limit, if it has one to set."""
    if max_tokens is None:
        return model
    try:
        named = "max_tokens" in inspect.signature(model).parameters
    except (TypeError, ValueError):
        named = False
    return (lambda texts: model(texts, max_tokens=max_tokens)) if named else model


def model_batches(batches: Iterator[pa.RecordBatch], text: int, group: int | None = None,
                  cut: Callable[[str], tuple[str, bool]] | None = None,
                  max_items: int = fixed.BATCH_MAX_ITEMS,
                  target_tokens: int = fixed.BATCH_TARGET_TOKENS,
                  ) -> Iterator[tuple[pa.RecordBatch, list[str], list[bool]]]:
    """(rows without their text, texts, which were cut) of one model call after another.

    A batch closes ahead of the row that would break either limit, and where the
    ``group`` column changes, as ``batching.assign_batches`` has it; the end of
    an Arrow batch closes none. What is held is one batch of texts and the rows
    it came with.
    """
    parts: list[pa.RecordBatch] = []
    texts: list[str] = []
    cuts: list[bool] = []
    tokens, now = 0, None

    def closed():
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        out = rows, list(texts), list(cuts)
        parts.clear(), texts.clear(), cuts.clear()
        return out

    for batch in batches:
        rows = batch.drop_columns([batch.schema.names[text]])
        groups = None if group is None else batch.column(group).to_pylist()
        start = 0
        for i in range(batch.num_rows):
            value = batch.column(text)[i].as_py() or ""
            value, shorter = cut(value) if cut else (value, False)
            own = token_estimate(len(value))
            here = None if groups is None else groups[i]
            if texts and (len(texts) == max_items or tokens + own > target_tokens or here != now):
                if i > start:
                    parts.append(rows.slice(start, i - start))
                yield closed()
                start, tokens = i, 0
            now = here
            texts.append(value)
            cuts.append(shorter)
            tokens += own
        if batch.num_rows > start:
            parts.append(rows.slice(start))
        del batch
    if texts:
        yield closed()


class Scorer:
    """A pair scorer, either as a column expression or as a Python function.

    A column scorer may name what it needs of a text (``features``); that is
    then computed once per query and once per document, not once per pair.
    """

    def __init__(self, column: ColumnScorer | None = None, python: PythonScorer | None = None,
                 features: Callable[[Column], Column] | None = None):
        if (column is None) == (python is None):
            raise ValueError("give either a column scorer or a Python scorer")
        if python is not None and features is not None:
            raise ValueError("features belong to a column scorer")
        self.column, self.python = column, python
        self.features = features or (lambda text: text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)))


def _overlap(query: Column, document: Column) -> Column:
    shared = F.size(F.array_intersect(document, query))
    return F.when(F.size(query) > 0, shared / F.size(query)).otherwise(F.lit(0.0))


# STAND-IN for a pair-scoring model: the share of query terms the document has.
lexical_overlap = Scorer(column=_overlap, features=_terms)


def hashed_terms(dim: int = 64) -> Encoder:
    """STAND-IN for an encoder: term counts, each term hashed to one of ``dim`` places."""

    def encode_batch(texts: list[str]) -> np.ndarray:
        place: dict[str, int] = {}
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            spots = []
            for term in re.findall(TERM_PATTERN, text.lower()):
                if term not in place:
                    place[term] = int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dim
                spots.append(place[term])
            out[i] = np.bincount(spots, minlength=dim) if spots else 0
        return out

    return encode_batch


def encode(df: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding", *,
           max_chars: int | None = None, keep: Sequence[str] = (), group: str | None = None,
           max_tokens: int | None = None, counter: TokenCounter | None = None,
           cut: str | None = None) -> DataFrame:
    """Encode a text column; returns the ``keep`` columns and the vectors.

    Model calls take batches under the item and token limits, across Arrow
    batches; ``group`` names a column of ``keep`` whose values are not mixed. A
    vector with a value that is not finite becomes all zeros. Sort rows by length
    within partitions first if padding matters to the model.

    Whole texts are encoded by default. ``max_tokens`` goes to an encoder that takes
    it; with a ``counter``, texts are cut to so many of its tokens first. ``cut``
    names a column that says which texts either limit shortened.
    """
    bound_arrow_batches(df.sparkSession, TEXT_BYTES)
    source = F.coalesce(F.col(text), F.lit(""))
    over = F.lit(False)
    if max_chars is not None:
        over, source = F.length(source) > max_chars, F.substring(source, 1, max_chars)
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *([T.StructField(cut, T.BooleanType())] if cut else []),
                           T.StructField(out, T.ArrayType(T.FloatType()))])
    shorten = None
    if counter is not None and max_tokens is not None:
        def shorten(value: str) -> tuple[str, bool]:
            return counter.cut(value, max_tokens)
    model = with_limit(encoder, max_tokens)
    at = None if group is None else list(keep).index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, cuts in model_batches(batches, len(keep) + 1, at, shorten):
            vectors = np.array(model(texts), dtype=np.float32)
            if vectors.shape[0] != len(texts):
                raise ValueError(f"{vectors.shape[0]} vectors for {len(texts)} texts")
            vectors[~np.isfinite(vectors).all(axis=1)] = 0.0
            n, d = vectors.shape
            offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)) if d else pa.array(
                np.zeros(n + 1, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), type=pa.float32()))
            columns, names = rows.columns[:len(keep)], [*keep]
            if cut:
                before = rows.column(len(keep)).to_pylist()
                columns.append(pa.array([a or b for a, b in zip(before, cuts)]))
                names.append(cut)
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, out])

    return df.select(*keep, over.alias("_cut"), source.alias("_text")).mapInArrow(run, schema)


# Texts that tell encoders apart: none, short and long ones, other scripts, numbers, repeats.
PROBES = ["", "a", "appeal allowed", "The appeal is dismissed. 2020", "Ünïcode ß 日本語 текст",
          "0 1 2 3 4 5 6 7 8 9", " ".join(f"word{i}" for i in range(4000))]


def encoder_fingerprint(spark: SparkSession, encoder: Encoder, name: str | None = None,
                        **limits) -> str:
    """What an encoder is known by: its ``name`` (with a version), or the vectors it gives.

    Without a name, fixed texts are encoded in one task, under the same limits
    as the run, and their vectors are digested. Encoders that agree on all of these are
    taken for the same; give a name to one whose vectors differ from call to call.
    """
    if name is not None:
        return f"name {name}"
    df = spark.createDataFrame([*enumerate(PROBES)], "i long, text string").coalesce(1)
    rows = sorted(encode(df, encoder, keep=["i"], **limits).collect())
    digest = hashlib.sha256()
    for row in rows:
        digest.update(np.array(row["embedding"], np.float32).tobytes() + b"|")
    return f"vectors {digest.hexdigest()}"


def encode_queries(queries: DataFrame, encoder: Encoder, instruct: bool = True,
                   **limits) -> DataFrame:
    """Add ``q_vec`` to (query_id, query); the encoder sees the instruction and the query.

    ``limits``: ``max_tokens``, ``counter`` and ``cut``, as ``encode`` has them.
    """
    shown = embed_prompt(F.col("query")) if instruct else F.col("query")
    return encode(queries.withColumn("_shown", shown), encoder, "_shown", "q_vec",
                  keep=["query_id", "query"], **limits)


def score_pairs(pairs: DataFrame, scorer: Scorer, query: str, document: str,
                out: str = "reranker_score", prepared: bool = False) -> DataFrame:
    """Add one score per (query, document) row; ``prepared`` says both are features already."""
    if scorer.column is not None:
        q, d = F.col(query), F.col(document)
        if not prepared:
            q, d = scorer.features(q), scorer.features(d)
        return pairs.withColumn(out, scorer.column(q, d).cast("double"))
    bound_arrow_batches(pairs.sparkSession)
    names = pairs.columns
    q, d = names.index(query), names.index(document)
    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.asarray(
                scorer.python(batch.column(q).to_pylist(), batch.column(d).to_pylist()),
                dtype=np.float64)
            if scores.shape != (batch.num_rows,):
                raise ValueError(f"{scores.size} scores for {batch.num_rows} pairs")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)],
                                             names=[*names, out])

    return pairs.mapInArrow(run, schema)


# Longer than any string.
_WHOLE = (1 << 31) - 1


def document_key(text: Column) -> Column:
    """What a document of ``results`` is known by: its result key, and its text without a url."""
    key = result_key(F.col("url"), F.col("name"), F.col("date"))
    none = F.coalesce(F.col("url"), F.lit("")) == ""
    return F.when(none, F.concat_ws("|", key, F.md5(text))).otherwise(key)


def one_row_each(results: DataFrame, document: Column, text: str) -> DataFrame:
    """One row per document: ``results`` with a column ``document``, texts unmoved.

    Which row stays is found by keys and digests; the rows that stay are then picked
    where they are read. Of several texts of a document the one with the least hash stays.
    """
    narrow = [c for c in ("query_id", "rank", "url", "name", "date") if c in results.columns]
    place = F.sha2(F.to_json(F.struct(F.xxhash64(text).alias("h"), *narrow)), 256)
    keyed = results.withColumns({"document": document, "_place": place})
    counts = keyed.select("document", F.xxhash64(text).alias("_h"), "_place").groupBy(
        "document", "_h", "_place").agg(F.count(F.lit(1)).alias("_n"))
    picks = cut_lineage(counts.groupBy("document").agg(
        F.min(F.struct("_h", "_place", "_n")).alias("_p")).select(
        F.col("document").alias("_document"), F.col("_p._place").alias("_pick"),
        F.col("_p._n").alias("_n")))
    if not picks.filter("_n > 1").isEmpty():
        # Rows alike in every narrow column: nothing tells them apart where they are read.
        order = keyed.withColumn("_h", F.xxhash64(text))
        return dedupe_keep_first(order, "document", "_h").drop("_h", "_place")
    return keyed.join(
        broadcast_within(picks.drop("_n")),
        F.col("document").eqNullSafe(F.col("_document")) & (F.col("_place") == F.col("_pick")),
        "left_semi").drop("_place")


def generate_cards(results: DataFrame, generator: Generator | None = None, *,
                   max_chars: int | None = None, grounded: bool = False,
                   text: str = "full_text", max_tokens: int | None = None) -> DataFrame:
    """One summary card per distinct document among ``results``: key, url, card, document.

    ``results`` has url, name, date and a text column. A document that many
    queries return is summarised once; ``document`` tells documents without a
    url apart by their text. Whole texts are used unless ``max_chars`` says
    otherwise; ``max_tokens``, the length of a card, goes to a generator that takes it.
    Without a generator the extractive stand-in is used, as plain column expressions.
    """
    documents = one_row_each(results, document_key(F.col(text)), text).select(
        result_key(F.col("url"), F.col("name"), F.col("date")).alias("key"),
        F.coalesce("url", F.lit("")).alias("url"), F.col(text).alias("text"), "document")
    if generator is None:
        shown = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
        card = sanitize_card(extractive_card(shown, grounded))
        return documents.select("key", "url", card.alias("card"), "document")

    bound_arrow_batches(results.sparkSession)
    most = _WHOLE if max_chars is None else max_chars
    prompts = documents.select(
        "key", "url", "document", card_prompt(F.col("text"), most, grounded).alias("prompt"))
    model = with_limit(generator, max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shown, _ in model_batches(batches, 3):
            cards = model(shown)
            if len(cards) != rows.num_rows:
                raise ValueError(f"{len(cards)} cards for {rows.num_rows} prompts")
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(cards, pa.string()), rows.column(2)],
                names=["key", "url", "card", "document"])

    raw = prompts.mapInArrow(run, "key string, url string, card string, document string")
    return raw.withColumn("card", sanitize_card(F.col("card")))
