"""Run-time parameters of the search plan."""

from dataclasses import dataclass

from .fixed_values import CHARS_PER_TOKEN


@dataclass(frozen=True)
class SearchParams:
    """Stage sizes and text limits of one search mode."""

    stage1_top_k: int
    stage2_top_k: int
    reranker_max_tokens: int
    generation_max_chars: int
    embedding_max_tokens: int
    generation_max_tokens: int
    landscape: bool

    @property
    def pack_chars(self) -> int:
        return self.reranker_max_tokens * CHARS_PER_TOKEN


# The two search modes.
NORMAL = SearchParams(40, 5, 8192, 24000, 8192, 1536, landscape=False)
FAST = SearchParams(20, 3, 2048, 12000, 4096, 768, landscape=True)


def params(fast: bool = False) -> SearchParams:
    return FAST if fast else NORMAL
