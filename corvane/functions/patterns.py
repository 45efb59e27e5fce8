"""Rules for patterns that users add, and scans over texts in several segments."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH, MAX_BOUND, MAX_ARMS, MIN_LITERAL = 256, 512, 64, 3


def literal_chars(parsed) -> int:
    """Characters that every match is sure to hold literally."""
    total = 0
    for op, arg in parsed:
        if op is C.LITERAL:
            total += 1
        elif op is C.SUBPATTERN:
            total += literal_chars(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            total += arg[0] * literal_chars(arg[2])
        elif op is C.BRANCH:
            total += min(literal_chars(a) for a in arg[1])
    return total


def problems(pattern: str) -> list[str]:
    """Why a pattern is not taken; none if it is."""
    if len(pattern) > MAX_LENGTH:
        return ["too long"]
    try:
        parsed = _parser.parse(pattern)
    except re.error as e:
        return [f"no regular expression: {e}"]
    found = []

    def walk(items) -> None:
        for op, arg in items:
            if op is C.ANY:
                found.append("a dot")
            elif op is C.SUBPATTERN:
                if arg[0] is not None:
                    found.append("a capturing group")
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                if arg[1] is not C.MAXREPEAT and arg[1] > MAX_BOUND:
                    found.append("a bound over 512")
                walk(arg[2])
            elif op is C.BRANCH:
                if len(arg[1]) > MAX_ARMS:
                    found.append("more than 64 arms")
                for a in arg[1]:
                    walk(a)
            elif op in (C.ASSERT, C.ASSERT_NOT, C.GROUPREF):
                found.append("an assertion or reference")

    walk(parsed)
    if literal_chars(parsed) < MIN_LITERAL:
        found.append("fewer than 3 sure characters")
    return list(dict.fromkeys(found))


def joined_segments(segments: Column) -> Column:
    """Segments as one text with a blank line between."""
    return F.array_join(segments, "\n\n")


def split_spans(segments: Column, spans: Column) -> Column:
    """Spans (start, end, grp) of the joined text as spans (segment, start, end, grp) of the segments they touch."""
    starts = F.aggregate(segments, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.char_length(x) + 2)))
    parts = F.transform(spans, lambda s: F.filter(
        F.transform(segments, lambda x, i: F.struct(
            i.alias("segment"), F.greatest(F.lit(0), (s["start"] - F.get(starts, i)).cast("int")).alias("start"), F.least(F.char_length(x), (s["end"] - F.get(starts, i)).cast("int")).alias("end"), s["grp"].alias("grp"))),
        lambda p: p["start"] < p["end"]))
    return F.flatten(parts)
