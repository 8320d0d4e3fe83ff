"""Spans of regular expressions with SQL functions alone.

Spark gives matches without places. ``split`` and ``regexp_extract_all`` walk a text by the same steps, so
the lengths of the pieces between matches and of the matches add up to every match's place, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Sums over long match lists go by blocks of this many.
_BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def match_spans(text: Column, pattern: str, around: int = 0) -> Column:
    """Start, end (exclusive), value and ``around`` characters on either side of all leftmost matches.

    The pattern must never match the empty string. Null text has no matches. Texts without a match cost one search.
    """

    def placed(x: Column) -> Column:
        starts = let(
            F.zip_with(x["pieces"], x["found"], lambda p, m: F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0))),
            lambda sizes: let(
                F.transform(F.sequence(F.lit(0), F.floor((F.size(x["found"]) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))),
                lambda blocks: F.transform(
                    x["found"],
                    lambda m, i: _total(F.slice(blocks, F.lit(1), F.floor(i / _BLOCK).cast("int"))) + _total(F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + F.char_length(F.get(x["pieces"], i)),
                ),
            ),
        )
        before = lambda i: F.right(F.get(x["pieces"], i), F.lit(around)) if around else F.lit("")
        after = lambda i: F.left(F.get(x["pieces"], i + 1), F.lit(around)) if around else F.lit("")
        return let(starts, lambda s: F.transform(x["found"], lambda m, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.char_length(m)).alias("end"), m.alias("value"), before(i).alias("before"), after(i).alias("after")))).cast(SPAN)

    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(cut, placed)).otherwise(F.array().cast(SPAN))


def shown(kind: str, spans: Column, order: int = 0) -> Column:
    """Spans as structs that sort by start, then kind: start, order, and kind:start:end."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("shown")))


def joined(spans: Column) -> Column:
    """What ``shown`` shows, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: s["shown"]), ",")


def in_blocks(values: Column) -> Column:
    """An array cut into arrays of ``_BLOCK``; an empty one gives one empty block."""
    last = F.greatest(F.floor((F.size(values) - 1) / _BLOCK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans (sorted by start) replaced by ``mark``.

    How far the spans before one reach comes from the maxima of whole blocks and the rest of its own.
    """
    piece = lambda s, past: F.when(s["start"] >= past, F.concat(F.substring(text, past + 1, s["start"] - past), F.lit(mark))).otherwise(F.lit(""))
    most = lambda ends: F.coalesce(F.array_max(ends), F.lit(0))

    def replaced(x: Column) -> Column:
        past = lambda i: F.greatest(most(F.slice(x["maxima"], F.lit(1), F.floor(i / _BLOCK).cast("int"))), most(F.slice(x["ends"], F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))
        return F.concat(F.array_join(F.transform(spans, lambda s, i: let(past(i), lambda p: piece(s, p))), ""), F.substring(text, most(x["maxima"]) + 1, F.char_length(text)))

    done = let(F.transform(spans, lambda s: s["end"]), lambda ends: let(F.struct(ends.alias("ends"), F.transform(in_blocks(ends), most).alias("maxima")), replaced))
    return F.when(F.size(spans) > 0, done).otherwise(text)
