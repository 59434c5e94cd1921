"""Plain text columns: trimming, snippets, token estimates and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fixed

# Fixed value: every character that counts as white space in a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class, under Java's Unicode-class flag.
SPACE = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Spark inlines column expressions, so a text-sized intermediate used three
    times would be computed three times; a one-element array binds it.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Cut white space off both ends (``trim`` alone only knows the blank)."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """True when the text is not null and not white space only."""
    return text.isNotNull() & text.rlike(UNICODE + r"[^\s\x1c-\x1f]")


def snippet(text: Column, length: int = fixed.SNIPPET_LENGTH) -> Column:
    return F.substring(text, 1, length)


def display_snippet(text: Column, length: int = fixed.SNIPPET_LENGTH) -> Column:
    """The snippet, with an ellipsis when the text goes on."""
    return F.concat(snippet(text, length), F.when(F.length(text) > length, "...").otherwise(""))


def score_percent(score: Column) -> Column:
    """Score x 100 with one decimal and a percent sign.

    Rounds the exact binary value, ties to even, as C and Python do; Spark's
    own formatting rounds the printed decimal half up. The value is split so
    that every step up to the comparison with the halfway point is exact.
    """

    def shown(value: Column) -> Column:
        size = F.abs(value)
        whole = F.floor(size)
        part = size - whole
        tenth = F.floor(part * 10)
        coarse = F.floor(part * 2**26) / float(2**26)
        above = (coarse * 20 - (tenth * 2 + 1)) + (part - coarse) * 20
        up = (above > 0) | ((above == 0) & (tenth % 2 == 1))
        tenths = (whole * 10 + tenth + up.cast("int")).cast("long")
        return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"),
                        F.lit("."), (tenths % 10).cast("string"), F.lit("%"))

    return let(score.cast("double") * 100, shown)


def truncate_text(text: Column, max_chars: int = fixed.EMBED_MAX_CHARS) -> Column:
    return F.substring(text, 1, max_chars)


def is_truncated(text: Column, max_chars: int = fixed.EMBED_MAX_CHARS) -> Column:
    return F.length(text) > max_chars


def estimate_tokens(text: Column) -> Column:
    """Four characters to a token, rounded up, never less than one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / fixed.CHARS_PER_TOKEN).cast("int"))


def result_key(url: Column, name: Column, date: Column,
               backend: str | None = None, fast: bool = False) -> Column:
    """The key under which a generated summary is kept.

    The url if there is one, else a key from name and date; followed by the
    generation settings when ``backend`` is given.
    """
    fallback = F.concat(F.lit("rank-1:"), F.coalesce(name, F.lit("")),
                        F.lit(":"), F.coalesce(date, F.lit("")))
    key = F.coalesce(F.nullif(url, F.lit("")), fallback)
    if backend is None:
        return key
    return F.concat(key, F.lit(f"|backend={backend}|fast_mode={fast}"))


def embed_prompt(query: Column) -> Column:
    before, after = fixed.EMBED_LAYOUT
    return F.concat(F.lit(f"{before}{fixed.EMBEDDING_INSTRUCTION}{after}"), query)


def rerank_query(query: Column) -> Column:
    return F.concat(F.lit(f"{fixed.RERANKER_INSTRUCTION}\n"), query)


def rerank_prompt(query: Column, document: Column) -> Column:
    """The text of one query and document pair for a pair scorer."""
    before, asked, found = fixed.RERANK_LAYOUT
    return F.concat(
        F.lit(f"{before}{fixed.RERANKER_INSTRUCTION}{asked}"), query, F.lit(found), document)


def card_prompt(text: Column, max_chars: int, grounded: bool = False) -> Column:
    """The chat prompt that asks for a summary card of a decision."""
    system = fixed.GROUNDED_CARD_PROMPT if grounded else fixed.CARD_PROMPT
    start, user, end = fixed.CARD_LAYOUT
    return F.concat(F.lit(f"{start}{system}{user}"), truncate_text(text, max_chars), F.lit(end))
