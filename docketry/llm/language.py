"""Language identification with bit-sliced Bloom filters over character n-grams.

Training counts the 3- and 4-grams of all labelled texts per language (letters
lower-cased, anything else a word boundary). A language contains an n-gram if at
least ``min_share`` of its n-grams are this one and no language has it ``ratio``
times as often; so a language holds at most 1 / ``min_share`` n-grams and the
filter has a size bound. One row of cells carries a bit per language: the AND of
``HASHES`` cells gives every language that contains an n-gram in one look-up. A
text's hits are counted per language, less the hits that the filter's fill lets
a foreign n-gram have, and the highest corrected count decides.

Null texts and texts without letters get ``und`` and score 0. Ties go to the
language with more training n-grams, then to the lesser name. Letters that no
language holds leave that same first language, score 0. Without any labelled
text every row is ``und``. Ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

HASHES, CELLS_PER_GRAM, SIZES = 4, 16, (3, 4)
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of every n-gram of the texts, and which texts have a letter."""
    parts = [np.frombuffer(("  " + (t or "").lower() + "  ").encode("utf-32-le", "surrogatepass"),
                           np.uint32) for t in texts]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    codes = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = _letters()[codes]
    has = np.bincount(row[letter], minlength=len(parts)) > 0
    symbols = np.where(letter, codes, 32).astype(np.uint64)
    hashes, rows = [], []
    mix = np.uint64(0x9E3779B97F4A7C15)
    for n in SIZES:
        count = len(symbols) - n + 1
        inner = letter[1:1 + count].copy()
        for i in range(2, n - 1):
            inner &= letter[i:i + count]
        at = np.flatnonzero(inner & (row[:count] == row[n - 1:]))
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = (value ^ symbols[at + i]) * mix
            value ^= value >> np.uint64(29)
        hashes.append(value)
        rows.append(row[at])
    return np.concatenate(hashes), np.concatenate(rows), has


def _cells(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """Cell numbers of every n-gram, one array per hash function."""
    step = (grams >> np.uint64(33)) | np.uint64(1)
    return [((grams + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)
            for i in range(HASHES)]


@dataclass
class LanguageFilter:
    languages: list[str]       # by training n-grams, most first
    cells: np.ndarray          # (cells, bytes): a bit per language
    chance: np.ndarray         # per language: share of foreign n-grams that hit

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """(n-gram, language) bits."""
        found = None
        for at in _cells(grams, len(self.cells)):
            found = self.cells[at] if found is None else found & self.cells[at]
        bits = np.unpackbits(found, axis=1, bitorder="little")
        return bits[:, :len(self.languages)]

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        grams, row, has = grams_of(texts)
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        n = np.bincount(row, minlength=len(texts)).astype(float)
        bits = self.hits(grams)
        counts = np.stack([np.bincount(row[bits[:, i] > 0], minlength=len(texts))
                           for i in range(len(self.languages))], axis=1)
        real = np.maximum(0.0, (counts - n[:, None] * self.chance) / (1.0 - self.chance))
        best = real.argmax(axis=1)
        total = real.sum(axis=1)
        for i in np.flatnonzero(has):
            names[i] = self.languages[best[i]]
            scores[i] = float(real[i, best[i]] / total[i]) if total[i] > 0 else 0.0
        return names, scores


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) over all labelled texts; counted in pieces, then by Spark."""
    def make():
        def run(keys, texts):
            grams, row, _ = grams_of(texts)
            order: dict[str, int] = {}
            number = np.array([order.setdefault(k[0], len(order)) for k in keys], np.int64)
            out: list[list] = [[], [], []]
            for lang, i in order.items():
                values, n = np.unique(grams[number[row] == i], return_counts=True)
                out[0] += [lang] * len(values)
                out[1] += values.view(np.int64).tolist()
                out[2] += n.tolist()
            return out

        return run

    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return map_texts(labelled, [F.col(lang_col), F.col(text_col)],
                     "lang string, gram long, n long", make).groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
        min_share: float = 1e-5, ratio: float = 5.0) -> LanguageFilter:
    from .common import written

    counts = written(gram_counts(docs, lang_col, text_col), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = [(r["total"], r["lang"]) for r in totals.collect()]
    languages = [lang for _, lang in sorted(names, key=lambda x: (-x[0], x[1]))]
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint8), np.zeros(0))
    # A language's shares sum to one, so at most 1 / min_share rows of it come here.
    rows = (counts.join(F.broadcast(totals), "lang")
            .filter(F.col("n") >= F.col("total") * min_share)
            .select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).toPandas())
    top = rows.groupby("gram")["share"].transform("max")
    rows = rows[rows["share"] * ratio >= top]
    # A language's bits are a filter of their own: the largest language sets the size.
    size = max(1024, CELLS_PER_GRAM * int(rows.groupby("lang").size().max()))
    cells = np.zeros((size, -(-len(languages) // 8)), np.uint8)
    chance = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        grams = rows.loc[rows["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        bit = np.uint8(1 << i % 8)
        for at in _cells(grams, size):
            cells[at, i // 8] |= bit
        chance[i] = ((cells[:, i // 8] & bit) > 0).mean() ** HASHES
    return LanguageFilter(languages, cells, chance)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; a map without shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(keys, texts):
            return [[k[0] for k in keys], *shipped.value.predict(texts)]

        return run

    return map_texts(docs, [F.col(id_col), F.col(text_col)],
                     f"{id_col} {id_type}, lang_pred string, score double", make, 2 << 20)
