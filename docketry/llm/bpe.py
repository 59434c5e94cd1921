"""Byte-level BPE by prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that its encoding
can end with. Token ``t`` ends the prefix of length ``i`` if the encoding of
the prefix without ``t`` ends with some ``l`` and BPE leaves ``l + t`` as the
two tokens ``[l, t]``. Those last tokens are the whole state: an append only
adds entries, and an edit recomputes entries from the edit on.

Null text counts as empty: no tokens, digests of the empty string. Texts of any
length are encoded whole; each match of the split pattern is encoded alone and
its result is kept in a bounded table per task, so repeated words cost a lookup.
Rows with equal or null ids each give their own row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, worker_table

# Pre-tokens of a generation, and pairs, that a worker keeps.
KEPT, PAIRS_KEPT = 150_000, 500_000
_NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixEncoder:
    """Encodes byte strings with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.length_of = {rank: len(piece) for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._built: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        # Finds the tokens that end at each byte, longest first; bytes stand as Latin-1 letters.
        self._tokens = ahocorasick.Automaton()
        for piece, rank in ranks.items():
            self._tokens.add_word(piece.decode("latin-1"), (rank, len(piece)))
        if ranks:
            self._tokens.make_automaton()

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain BPE on a short string: merge the lowest rank, leftmost first."""
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i:i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], _NONE)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], _NONE)
        return parts

    def _is_built(self, token: int) -> bool:
        """Whether BPE builds the token from its bytes; else it is only ever a whole pre-token."""
        known = self._built.get(token)
        if known is None:
            known = self._built[token] = len(self._merge(self.bytes_of[token])) == 1
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE builds ``right`` and leaves the two tokens as they are."""
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        a, b = self.bytes_of[left], self.bytes_of[right]
        known = self._pairs[left << 32 | right] = (
            self._is_built(right) and self._merge(a + b) == [a, b])
        return known

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Fill ``last`` up to ``upto``; ``last[i]`` ends the encoding of ``data[:i + 1]``."""
        done, stop = len(last), len(data) if upto is None else upto
        if done >= stop:
            return last
        pairs = self._pairs.get
        at = max(0, done + 1 - self.longest)
        for end, (token, size) in self._tokens.iter(data[at:stop].decode("latin-1")):
            end += at
            if end < done:
                continue
            if end > done:
                break
            if size > end:
                fits = self._is_built(token)
            else:
                before = last[end - size]
                fits = pairs(before << 32 | token)
                if fits is None:
                    fits = self._stays_apart(before, token)
            if fits:
                last.append(token)
                done += 1
        if done < stop:
            raise ValueError(f"no token for byte {data[done]}")
        return last

    def path(self, last: list[int]) -> list[int]:
        """Token ids along the last tokens, from the end back to the start."""
        ids, at, length_of = [], len(last), self.length_of
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= length_of[token]
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token; a pre-token that is in the vocabulary is its own token."""
        if not data:
            return []
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.path(self.extend(data, []))

    def encode_all(self, words: list[str]) -> dict[str, list[int]]:
        """Encode many pre-tokens; in sorted order each reuses the prefix it shares."""
        out: dict[str, list[int]] = {}
        before, last = b"", []
        for word in sorted(words):
            data = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None or not data:
                out[word] = [] if whole is None else [whole]
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same:]
            out[word] = self.path(self.extend(data, last))
            before = data
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixState:
    """The last tokens of a growing or edited byte string."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Swap ``data[begin:end]``; returns how many entries had to be computed.

        Behind the edit an entry depends on at most the ``longest`` entries
        before it, so once that many agree with the old ones, the rest is reused.
        """
        old, shift = self.last, len(new) - (end - begin)
        self.data = self.data[:begin] + new + self.data[end:]
        last, computed, same = old[:begin], 0, 0
        edited = begin + len(new)
        while len(last) < len(self.data):
            self.encoder.extend(self.data, last, len(last) + 1)
            computed += 1
            at = len(last)
            same = same + 1 if at > edited and old[at - shift - 1] == last[-1] else 0
            if same > self.encoder.longest:
                last.extend(old[at - shift:])
                break
        self.last = last
        return computed

    def ids(self) -> list[int]:
        return self.encoder.path(self.last)


class EncodedWords:
    """Pre-tokens that a worker has encoded: count, ids as text, bytes decoded from them.

    Two generations of about ``KEPT`` words: when the young one is full it becomes the
    old one, and what was old and is not met again is let go.
    """

    def __init__(self):
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def at_hand(self, used: set[str], encoder: PrefixEncoder) -> dict[str, tuple[int, str, bytes]]:
        """A table that has all of ``used``."""
        if len(self.young) >= KEPT:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = used.difference(young)
        for word in missing.intersection(old):
            young[word] = old[word]
        for word, ids in encoder.encode_all(list(missing.difference(old))).items():
            young[word] = (len(ids), ",".join(map(str, ids)), encoder.decode(ids))
        return young


def encoder_for(path: str) -> tuple[PrefixEncoder, EncodedWords]:
    """The encoder and its table of encoded pre-tokens; a worker keeps both between tasks."""
    kept = worker_table("bpe")
    if path not in kept:
        kept.clear()
        kept[path] = PrefixEncoder(load_ranks(path)), EncodedWords()
    return kept[path]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text; no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"

    def make():
        import regex

        split = regex.compile(pattern).findall
        encoder, tables = encoder_for(vocabulary)

        def run(keys, texts):
            out: list[list] = [[k[0] for k in keys], [], [], []] + ([[]] if with_ids else [])
            pieces = [split(text or "") for text in texts]
            used = set().union(*pieces)
            kept = tables.at_hand(used, encoder)
            for found in pieces:
                n, shown, data = 0, [], []
                for count, text, decoded in map(kept.__getitem__, found):
                    n += count
                    shown.append(text)
                    data.append(decoded)
                listed = ",".join(shown)
                out[1].append(n)
                out[2].append(hashlib.sha256(listed.encode()).hexdigest())
                out[3].append(hashlib.sha256(b"".join(data)).hexdigest())
                if with_ids:
                    out[4].append([int(x) for x in listed.split(",")] if listed else [])
            return out

        return run

    return map_texts(docs, [F.col(id_col), F.col(text_col)], schema, make, 1 << 19, owner="bpe")
