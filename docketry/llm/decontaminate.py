"""Benchmark decontamination: pigeonhole edit matching.

Item and document are lower-cased and their white space becomes single spaces.
An item of m characters may appear with k = floor(``error_rate`` * m) edits.
Cut into k + 1 pieces, at least one piece of it must then occur unchanged. All
pieces of all items are searched at once (Aho-Corasick); each hit gives a place
where the item may lie, overlapping places are merged, and Myers' bit-parallel
distance decides each. Every document with an item within k edits is found,
however long it is.

Items are sent to all tasks in blocks of at most ``BLOCK_BYTES`` of text, so the
memory bound holds for any benchmark; several blocks mean several scans. Null or
blank items and texts match nothing. Items without an id match under a null id;
equal items are matched each. Repeated rows give repeated matches. An item
shorter than 1 / ``error_rate`` is matched exactly. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from .common import digest_of, map_texts, own_name, written

ERROR_RATE = 0.08
BLOCK_BYTES = 16 * 1024 * 1024


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, edits: int) -> list[tuple[int, str]]:
    """(end offset, piece) of edits + 1 pieces that cover the item; sizes differ by one at most."""
    count = edits + 1
    bounds = [len(item) * i // count for i in range(count + 1)]
    return [(b, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, char in enumerate(item):
        bits[char] = bits.get(char, 0) | 1 << i
    return bits


def best_match(bits: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(distance, end) of the best occurrence in ``text``, the first of equals (Myers 1999)."""
    mask, high = (1 << size) - 1, 1 << size - 1
    up, down, score = mask, 0, size
    best, end = size, 0
    for at, char in enumerate(text, 1):
        eq = bits.get(char, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        grow = down | (mask & ~(across | up))
        shrink = up & across
        if grow & high:
            score += 1
        elif shrink & high:
            score -= 1
        grow = (grow << 1) & mask
        shrink = (shrink << 1) & mask
        vertical = eq | down
        up = shrink | (mask & ~(vertical | grow))
        down = grow & vertical
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        import ahocorasick

        self.items = [(item_id, text, int(len(text) * error_rate + 1e-9)) for item_id, text in items
                      if text]
        self.bits: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, edits) in enumerate(self.items):
            for end, piece in pieces_of(text, edits):
                places.setdefault(piece, []).append((number, end))
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, begin, end) of the best place of every item within its edits."""
        text = normalise(text)
        if not text or not self.items:
            return []
        places: dict[int, set[int]] = {}
        for at, where in self.automaton.iter(text):
            for number, end in where:
                places.setdefault(number, set()).add(at + 1 - end)
        out = []
        for number, starts in places.items():
            item_id, item, edits = self.items[number]
            size = len(item)
            bits = self.bits.get(number)
            if bits is None:
                bits = self.bits[number] = pattern_bits(item)
            found, to = None, -1
            for lo, hi in _merged(sorted(starts), edits, size, len(text)):
                part = text[lo:hi]
                distance, end = (0, part.find(item) + size) if item in part else (
                    best_match(bits, size, part))
                if distance <= edits and (found is None or distance < found):
                    found, to = distance, lo + end
            if found is not None:
                backwards = text[max(0, to - size - edits):to][::-1]
                _, length = best_match(pattern_bits(item[::-1]), size, backwards)
                out.append((item_id, found, to - length, to))
        return out


def _merged(starts: list[int], edits: int, size: int, length: int):
    lo = hi = None
    for start in starts:
        a, b = max(0, start - edits), min(length, start + size + edits)
        if hi is not None and a <= hi:
            hi = max(hi, b)
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
    if hi is not None:
        yield lo, hi


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_col: str = "text", error_rate: float = ERROR_RATE,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, distance, begin, end): offsets count characters of the normalised text."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, {item_id_col} {item_type}, distance int, begin int, end int"
    wanted = items.select(F.col(item_id_col).alias("i"), F.col(item_col).alias("t")).filter(
        F.col("t").isNotNull())
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes))
    found = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(
            F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        shipped = spark.sparkContext.broadcast(
            [(r["i"], normalise(r["t"])) for r in part.collect()])

        def make(shipped=shipped):
            matcher = Matcher(shipped.value, error_rate)

            def run(keys, texts):
                out: list[list] = [[], [], [], [], []]
                for key, text in zip(keys, texts):
                    for item_id, distance, begin, end in matcher.find(text):
                        for column, value in zip(out, (key[0], item_id, distance, begin, end)):
                            column.append(value)
                return out

            return run

        here = map_texts(docs, [F.col(id_col), F.col(text_col)], schema, make, 2 << 20)
        found = here if found is None else found.unionByName(here)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item, each row judged by its own text.

    Rows with a null id cannot be named and stay.
    """
    digest, gone = own_name(docs, "_digest"), own_name(docs, "_gone")
    rows = docs.withColumn(digest, digest_of(text_col))
    found = written(leaks(rows.filter(F.col(id_col).isNotNull()), items, digest, text_col,
                          error_rate=error_rate).select(F.col(digest).alias(gone)).distinct(),
                    "leaks")
    return rows.join(broadcast_within(found), F.col(id_col).isNotNull()
                     & (F.col(digest) == F.col(gone)), "left_anti").select(*docs.columns)
