"""Token counts by trie-shared dynamic programming.

A unigram tokenizer splits a word so that the sum of its pieces' scores is
largest, of equal sums with the fewest pieces. The best score of a prefix
depends on that prefix only, so words that share a prefix share the work: the
distinct pre-tokens of a piece of the table form a trie, walked depth first (in
sorted order), with the forward score and count of every node on the way. At
the end of a word its count is stored, and texts add up stored counts.

Pre-tokens are the words between white space, each with the mark of a word's
start in front. Scores are whole numbers: 1e6 * -ln(place + 2), place being the
piece's rank by the score in the vocabulary file (Zipf's law). A character that
is no piece costs its UTF-8 bytes, each a byte piece.

Null and blank texts have no tokens. Ids may be null or repeat; each row gives
its own. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, worker_table

MARK = "▁"
# Words a worker keeps; a full table keeps what the current texts use.
KEPT = 300_000
_WORST = -(1 << 62)


def zipf_scores(path: str) -> tuple[dict[str, int], list[int]]:
    """Whole-number scores of the pieces of a vocabulary file, and of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    order = sorted(range(model.get_piece_size()), key=lambda i: (-model.get_score(i), i))
    score = {i: -round(1e6 * math.log(place + 2)) for place, i in enumerate(order)}
    pieces = {model.id_to_piece(i): score[i] for i in order
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                      or model.is_unused(i))}
    worst = min(score.values(), default=0)
    bytes_ = [score.get(model.piece_to_id(f"<0x{b:02X}>"), worst) for b in range(256)]
    return pieces, bytes_


class TrieCounter:
    """Counts tokens of words; the current branch of the trie is all that is held."""

    def __init__(self, pieces: dict[str, int], byte_scores: list[int]):
        self.byte_scores = byte_scores
        self.single = {p for p in pieces if len(p) == 1}
        # Pieces read from their last character to their first.
        self._back: dict[tuple[int, str], int] = {}
        self._score_at: dict[int, int] = {}
        for piece, score in pieces.items():
            node = 0
            for char in reversed(piece):
                node = self._back.setdefault((node, char), len(self._back) + 1)
            self._score_at[node] = score

    def count_all(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """word -> (tokens, score), the words in any order."""
        out: dict[str, tuple[int, int]] = {}
        back, score_at = self._back.get, self._score_at.get
        scores, counts = [0], [0]     # of every prefix on the branch
        before = ""
        for word in sorted(words):
            data = MARK + word
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del scores[same + 1:], counts[same + 1:]
            for end in range(same + 1, len(data) + 1):
                char = data[end - 1]
                best, fewest = _WORST, 0
                if char not in self.single:
                    raw = char.encode("utf-8", "surrogatepass")
                    best = scores[end - 1] + sum(map(self.byte_scores.__getitem__, raw))
                    fewest = counts[end - 1] + len(raw)
                node = 0
                for start in range(end - 1, -1, -1):
                    node = back((node, data[start]))
                    if node is None:
                        break
                    score = score_at(node)
                    if score is not None:
                        total, n = scores[start] + score, counts[start] + 1
                        if total > best or total == best and n < fewest:
                            best, fewest = total, n
                scores.append(best)
                counts.append(fewest)
            out[word] = (counts[-1], scores[-1])
            before = data
        return out


def counter_for(path: str) -> tuple[TrieCounter, dict[str, tuple[int, int]]]:
    """The counter and its table of counted words; a worker keeps both between tasks."""
    kept = worker_table("tokens")
    if path not in kept:
        kept.clear()
        kept[path] = TrieCounter(*zipf_scores(path)), {}
    return kept[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, score) of every whole text; no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        counter, kept = counter_for(vocabulary)

        def run(keys, texts):
            words = [(t or "").split() for t in texts]
            used = set().union(*words)
            if len(kept) + len(used) > KEPT:
                for word in kept.keys() - used:
                    del kept[word]
            kept.update(counter.count_all(list(used.difference(kept))))
            out: list[list] = [[k[0] for k in keys], [], [], []]
            for found in words:
                tokens = score = 0
                for n, s in map(kept.__getitem__, found):
                    tokens += n
                    score += s
                out[1].append(len(found))
                out[2].append(tokens)
                out[3].append(score)
            return out

        return run

    return map_texts(docs, [F.col(id_col), F.col(text_col)],
                     f"{id_col} {id_type}, n_words long, n_tokens long, score long", make,
                     1 << 20, "tokens")
