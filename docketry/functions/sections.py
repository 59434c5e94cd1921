"""Sections of a structured decision, and packing them into a character budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..schemas import SECTIONS
from .text import SPACE, UNICODE, let, strip, strip_left

# m: ^ at each line; d: only \n ends a line; U: Unicode classes.
_HEADING_START = rf"(?mdU)^(?={fixed.HEADING_PATTERN}{SPACE}*{fixed.PARAGRAPH_PATTERN})"
# The heading of a part, looked for in the text up to its first closing bracket.
_HEADING_NAME = rf"(?U)\A({fixed.HEADING_PATTERN}){SPACE}*\[\d+\z"
_MARKER = UNICODE + fixed.PARAGRAPH_PATTERN


def heading_priority(name: Column) -> Column:
    """1 (most salient) to 6 by the first rule that matches the heading, else 7."""
    rules = None
    for priority, pattern in enumerate(fixed.PRIORITY_PATTERNS, start=1):
        hit = name.rlike(f"(?i){pattern}")
        rules = F.when(hit, priority) if rules is None else rules.when(hit, priority)
    return rules.otherwise(fixed.DEFAULT_PRIORITY)


def _rest(text: Column, start: Column) -> Column:
    return F.substring(text, start, F.length(text))


def _behind(text: Column, phrase: str, skip: Callable[[Column], Column] | None = None) -> Column:
    """The text behind the first ``phrase``, passed through ``skip``; else the text as it is."""

    def cut(t: Column) -> Column:
        rest = _rest(t, F.locate(phrase, t) + len(phrase))
        return F.when(t.contains(phrase), let(rest, skip) if skip else rest).otherwise(t)

    return let(text, cut)


def _skip_contents(rest: Column) -> Column:
    """Drop the end of the contents line and the line with the list of headings."""
    line_end = F.locate("\n", rest)
    list_end = F.position(F.lit("\n"), rest, line_end + 1)
    cut = F.when(line_end == 0, 0).when(list_end == 0, line_end).otherwise(list_end)
    return _rest(rest, cut + 1)


def _skip_bridge(text: Column) -> Column:
    def cut(shown: Column) -> Column:
        rest = _rest(shown, F.lit(len(fixed.BRIDGE_LINE) + 1))
        return F.when(shown.startswith(fixed.BRIDGE_LINE), strip_left(rest)).otherwise(text)

    return let(strip_left(text), cut)


def strip_boilerplate(text: Column) -> Column:
    """Drop the header, the contents list, the bridge line and the footnote block.

    Plain searches only: most of a decision is text that no pattern need see.
    """
    body = _behind(text, fixed.CONTENT_MARKER)
    body = _behind(body, fixed.CONTENTS_LINE, _skip_contents)
    return strip(F.substring_index(let(body, _skip_bridge), fixed.FOOTNOTE_START, 1))


def paragraph_markers(text: Column) -> Column:
    """All ``[N]`` markers, in order."""
    return F.regexp_extract_all(text, F.lit(_MARKER), F.lit(0))


def parse_sections(text: Column) -> Column:
    """The sections of a decision in document order.

    An array of (name, text, priority, ord). A text without headings is one
    section named ``body``; a text with nothing left after stripping is empty.
    """

    def from_parts(parts: Column) -> Column:
        named = F.transform(parts, lambda part: F.struct(
            strip(F.regexp_extract(F.substring_index(part, "]", 1), _HEADING_NAME, 1))
            .alias("name"),
            strip(part).alias("text")))
        # Text ahead of the first heading has no name and is left out.
        return F.filter(named, lambda s: s["name"] != "")

    def numbered(sections: Column) -> Column:
        return F.transform(sections, lambda s, i: F.struct(
            s["name"].alias("name"), s["text"].alias("text"),
            heading_priority(s["name"]).alias("priority"), i.alias("ord")))

    def of_cleaned(cleaned: Column) -> Column:
        whole = F.array(F.struct(
            F.lit(fixed.WHOLE_BODY_NAME).alias("name"), cleaned.alias("text"),
            F.lit(fixed.DEFAULT_PRIORITY).alias("priority"), F.lit(0).alias("ord")))
        found = let(from_parts(F.split(cleaned, _HEADING_START)),
                    lambda s: F.when(F.size(s) > 0, numbered(s)).otherwise(whole))
        return F.when(cleaned == "", F.array().cast(SECTIONS)).otherwise(found)

    return let(strip_boilerplate(F.coalesce(text, F.lit(""))), of_cleaned).cast(SECTIONS)


def truncate_analysis(text: Column, budget: Column) -> Column:
    """Cut to ``budget``, keeping the head and the start of the last two paragraphs.

    With fewer than three ``[N]`` markers, or a budget under eight characters,
    only the head is kept.
    """
    tail_room = F.floor(budget / 5).cast("int")

    def head_and_tail(markers: Column) -> Column:
        def joined(parts: Column) -> Column:
            tail_length = (
                F.length(F.element_at(parts, -1)) + F.length(F.element_at(markers, -1))
                + F.length(F.element_at(parts, -2)) + F.length(F.element_at(markers, -2)))
            return F.concat(
                F.substring(text, F.lit(1), budget - tail_room - len(fixed.GAP_MARK)),
                F.lit(fixed.GAP_MARK),
                F.substring(F.right(text, tail_length), F.lit(1), tail_room))
        return F.when(F.size(markers) >= 3, let(F.split(text, _MARKER), joined)).otherwise(
            F.substring(text, F.lit(1), budget))

    return (
        F.when(F.length(text) <= budget, text)
        .when(budget < len(fixed.GAP_MARK) + 1, F.substring(text, F.lit(1), budget))
        .otherwise(let(paragraph_markers(text), head_and_tail))
    )


def _label(section: Column) -> Column:
    return F.concat(F.lit("["), section["name"], F.lit("] "))


def pack_sections(sections: Column, raw: Column, budget: int,
                  strict_budget: bool = False) -> Column:
    """Fit sections into ``budget`` characters, the most salient ones first.

    If everything fits, all sections appear in document order. That test leaves
    the labels out of the sum, so labels may take the result over the budget;
    ``strict_budget`` counts them. Otherwise sections are taken by (priority,
    order) until no room is left and put back into document order.
    """
    gap = len(fixed.SECTION_SEPARATOR)
    per_section = gap + 3 if strict_budget else gap

    def size_of(s: Column) -> Column:
        own = F.length(s["text"]) + per_section
        return own + F.length(s["name"]) if strict_budget else own

    def all_sections(secs: Column) -> Column:
        return F.array_join(F.transform(secs, lambda s: F.concat(_label(s), s["text"])),
                            fixed.SECTION_SEPARATOR)

    state = "struct<room:int,done:boolean,packed:array<struct<ord:int,text:string>>>"
    start = F.struct(F.lit(budget).alias("room"), F.lit(False).alias("done"),
                     F.array().cast("array<struct<ord:int,text:string>>").alias("packed"))

    def take(acc: Column, s: Column) -> Column:
        room = acc["room"] - F.length(_label(s)) - gap

        def add(piece: Column) -> Column:
            return F.struct(
                (room - F.length(piece)).alias("room"), F.lit(False).alias("done"),
                F.array_append(acc["packed"], F.struct(
                    s["ord"].alias("ord"), F.concat(_label(s), piece).alias("text"))
                ).alias("packed")).cast(state)

        piece = (
            F.when(F.length(s["text"]) <= room, s["text"])
            .when(s["priority"] == 1, truncate_analysis(s["text"], room))
            .otherwise(F.substring(s["text"], F.lit(1), room)))
        full = F.struct(acc["room"].alias("room"), F.lit(True).alias("done"),
                        acc["packed"].alias("packed")).cast(state)
        return F.when(acc["done"] | (room <= 0), full).otherwise(let(piece, add))

    def greedy(secs: Column) -> Column:
        by_priority = F.array_sort(F.transform(secs, lambda s: F.struct(
            s["priority"].alias("priority"), s["ord"].alias("ord"),
            s["name"].alias("name"), s["text"].alias("text"))))
        return F.aggregate(
            by_priority, start.cast(state), take,
            lambda acc: F.array_join(
                F.transform(F.array_sort(acc["packed"]), lambda p: p["text"]),
                fixed.SECTION_SEPARATOR))

    def pack(secs: Column) -> Column:
        total = F.aggregate(secs, F.lit(-gap), lambda acc, s: acc + size_of(s))
        return (
            F.when(F.size(secs) == 0, F.substring(raw, 1, budget))
            .when(total <= budget, all_sections(secs))
            .otherwise(greedy(secs)))

    return let(sections, pack)


def pack_text(text: Column, budget: int, strict_budget: bool = False) -> Column:
    """Parse ``text`` and pack its sections into ``budget`` characters."""
    return pack_sections(parse_sections(text), text, budget, strict_budget)


def explode_sections(df: DataFrame, key: str = "url", text: str = "text") -> DataFrame:
    """One row per section: key, ord, name, priority, text."""
    return (
        df.select(key, F.explode(parse_sections(F.col(text))).alias("s"))
        .select(key, "s.ord", "s.name", "s.priority", "s.text")
    )
