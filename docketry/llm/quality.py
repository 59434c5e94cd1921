"""Document quality from a linear-chain conditional random field over lines.

Every line gets a state, good or bad. Its features are its own shape (character
classes, word lengths, repeated words) and those of the lines before and after;
neighbouring states are tied by learned weights. Labels exist per document, so
in training all lines of a document carry its label. The model is fitted on a
bounded sample of labelled documents (``SAMPLE_DOCS`` and ``SAMPLE_LINES``; only
feature rows reach the driver). The score is the mean of the forward-backward marginals of "good",
weighted by line length, between 0 and 1.

Null and empty texts are one empty line and get a score like any other. Without
labels, or with one kind only, the score is the smoothed share of good labels.
Ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts, worker_table

SAMPLE_DOCS, SAMPLE_LINES, ROUNDS = 3_000, 60_000, 200

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                             b"0123456789", b" \t\r\f\v", b".,;:?'\"()-", b"!", b"|", b"&*$%#@",
                             bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _i
CLASSES = 10
WIDTH = CLASSES + 6


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, lines per text) of all lines, in order."""
    rows: list[bytes] = []
    per_text = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
        per_text[i] = len(lines)
        rows += lines
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    symbols = _CLASS[np.frombuffer(b"".join(rows), np.uint8)].astype(np.int64)
    line = np.repeat(np.arange(len(rows)), lengths)
    counts = np.bincount(line * CLASSES + symbols, minlength=len(rows) * CLASSES)
    counts = counts.reshape(len(rows), CLASSES)
    words = [r.split() for r in rows]
    n_words = np.fromiter(map(len, words), np.int64, len(rows))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(rows))
    some = np.maximum(lengths, 1)[:, None]
    own = np.empty((len(rows), WIDTH))
    own[:, :CLASSES] = counts / some
    own[:, CLASSES] = np.log1p(lengths) / 5
    own[:, CLASSES + 1] = distinct / np.maximum(n_words, 1)
    own[:, CLASSES + 2] = np.minimum(lengths / np.maximum(n_words, 1), 40) / 10
    own[:, CLASSES + 3] = lengths == 0
    own[:, CLASSES + 4] = np.log1p(n_words / np.maximum(distinct, 1))
    own[:, CLASSES + 5] = [r[-1:] in (b".", b"?", b":") for r in rows]
    first = np.zeros(len(rows), bool)
    first[np.concatenate(([0], np.cumsum(per_text)[:-1])).astype(int)] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    features = np.hstack([own, before, after, first[:, None], last[:, None]])
    return features, np.maximum(lengths, 1).astype(float), per_text


class _Chains:
    """Lines of many documents in step order: step t holds line t of all that long."""

    def __init__(self, per_text: np.ndarray):
        order = np.argsort(-per_text, kind="stable")
        starts = (np.cumsum(per_text) - per_text)[order]
        lengths = per_text[order]
        most = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(most), side="left")
        self.steps = [starts[:n] + t for t, n in enumerate(alive)]

    def marginals(self, scores: np.ndarray, stay: np.ndarray):
        """P(good) per line; P(good, good) and P(bad, bad) with the line before."""
        def carried(x: np.ndarray) -> np.ndarray:
            return np.logaddexp(x + stay[0], 0) - np.logaddexp(x, stay[1])

        forward = scores.copy()
        backward = np.zeros_like(scores)
        good, bad = np.zeros_like(scores), np.zeros_like(scores)
        for now, nxt in zip(self.steps, self.steps[1:]):
            forward[nxt] += carried(forward[now[:len(nxt)]])
        for now, nxt in zip(self.steps[-2::-1], self.steps[:0:-1]):
            now = now[:len(nxt)]
            ahead = scores[nxt] + backward[nxt]
            backward[now] = carried(ahead)
            both = np.stack([forward[now] + ahead + stay[0], np.full(len(now), stay[1]),
                             forward[now], ahead])
            both = np.exp(both - both.max(axis=0))
            both /= both.sum(axis=0)
            good[nxt], bad[nxt] = both[0], both[1]
        return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60))), good, bad


@dataclass
class QualityModel:
    prior: float
    weights: np.ndarray | None = None
    bias: float = 0.0
    stay: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def scores(self, texts: list) -> list[float]:
        if self.weights is None:
            return [self.prior] * len(texts)
        if not texts:
            return []
        x, weight, per_text = line_features(texts)
        odds = ((x - self.mean) / self.scale) @ self.weights + self.bias
        good, _, _ = _Chains(per_text).marginals(odds, self.stay)
        text = np.repeat(np.arange(len(texts)), per_text)
        total = np.bincount(text, weight, len(texts))
        return np.clip(np.bincount(text, good * weight, len(texts)) / total, 0, 1).tolist()


def fit_lines(x: np.ndarray, per_text: np.ndarray, label: np.ndarray,
              rounds: int = ROUNDS) -> QualityModel:
    """Ascend the penalised likelihood; every document counts alike, however long."""
    prior = float((label.sum() + 1) / (len(label) + 2))
    if len(label) == 0 or label.min() == label.max():
        return QualityModel(prior)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    chains = _Chains(per_text)
    share = np.repeat(1.0 / per_text, per_text) / len(per_text)
    lines = np.repeat(label, per_text).astype(float)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(per_text) - per_text] = True
    theta = np.zeros(x.shape[1] + 3)
    theta[-3] = np.log(prior / (1 - prior))
    moment, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, gg, bb = chains.marginals(x @ theta[:-3] + theta[-3], theta[-2:])
        error = (lines - good) * share
        tied = share * ~first
        grad = np.concatenate([x.T @ error, [error.sum()],
                               [(tied * (lines - gg)).sum(), (tied * (1 - lines - bb)).sum()]])
        penalty = np.r_[np.full(x.shape[1], 1e-3), 0, 2e-2, 2e-2]
        grad -= penalty * theta
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad ** 2
        theta += 0.08 * (moment / (1 - 0.9 ** step)) / (
            np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    return QualityModel(prior, theta[:-3], float(theta[-3]), theta[-2:].copy(), mean, scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample_docs: int = SAMPLE_DOCS,
        sample_lines: int = SAMPLE_LINES) -> QualityModel:
    """Fit on at most ``sample_docs`` labelled documents, picked by a hash of the id.

    All of them take part. If they have more than ``sample_lines`` lines, the longest
    give a run of their lines only, of one length that makes the sum fit, so that a
    long document displaces no other. An id with labels that differ counts as bad.
    Of rows that repeat an id the one whose text has the least hash is taken.
    """
    picked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
              .withColumn("_h", F.xxhash64("_id")).orderBy("_h")
              .limit(min(sample_docs, sample_lines)))
    # One text per id; rows of an id combine before the shuffle.
    chosen = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(picked), "_id").groupBy("_h", "_y").agg(
        F.min_by("_text", F.xxhash64("_text")).alias("_text")))

    def make():
        def run(keys, texts):
            x, _, per_text = line_features(texts)
            cut = np.split(x.astype(np.float32), np.cumsum(per_text)[:-1])
            cut = [c[run_start(k[0], len(c), sample_lines):][:sample_lines]
                   for k, c in zip(keys, cut)]
            return [[k[0] for k in keys], [k[1] for k in keys],
                    [c.shape[0] for c in cut], [c.tobytes() for c in cut]]

        return run

    rows = map_texts(chosen, [F.col("_h"), F.col("_y"), F.col("_text")],
                     "h long, y int, n int, x binary", make)
    # The lines of all documents decide how many of each are fetched.
    from .common import written

    rows = written(rows, "lines")
    sizes = rows.select("h", "n").toPandas()
    if sizes.empty:
        return QualityModel(0.5)
    most = fair_lines(sizes["n"].to_numpy(np.int64), sample_lines)
    width = 4 * x_width()
    start = F.when(F.col("n") > most, F.pmod(F.col("h"), F.col("n") - most + 1)).otherwise(0)
    got = (rows.select("h", "y", F.least("n", F.lit(most)).alias("n"), F.substring(
        "x", (start * width + 1).cast("int"), F.lit(most * width)).alias("x"))
        .toPandas().sort_values(["h", "n"], kind="stable"))
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(n, -1)
                        for b, n in zip(got["x"], got["n"])]).astype(float)
    return fit_lines(x, got["n"].to_numpy(np.int64), got["y"].to_numpy(np.int64))


def x_width() -> int:
    """Features a line."""
    return line_features([""])[0].shape[1]


def run_start(h: int, lines: int, most: int) -> int:
    """Where a run of at most ``most`` lines begins."""
    return h % (lines - most + 1) if lines > most else 0


def fair_lines(sizes: np.ndarray, total: int) -> int:
    """The largest number of lines a document that keeps the sum within ``total``."""
    if sizes.sum() <= total:
        return int(sizes.max())
    low, high = 1, int(sizes.max())
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.minimum(sizes, middle).sum() <= total else (low, middle - 1)
    return low


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, score) per row; a map without shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(keys, texts):
            return [[k[0] for k in keys], shipped.value.scores(texts)]

        return run

    return map_texts(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {id_type}, score double",
                     make, 1 << 20)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3,
              text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, judged in the scan, all columns kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        worker_table(None)
        values = texts.to_pylist()
        out: list[float] = []
        at = 0
        while at < len(values):
            to, size = at, 0
            while to < len(values) and (to == at or size + len(values[to] or "") <= 1 << 20):
                size += len(values[to] or "")
                to += 1
            out += shipped.value.scores(values[at:to])
            at = to
        return pa.array(out, pa.float64())

    return docs.filter(scores(F.col(text_col)) >= F.lit(threshold))
