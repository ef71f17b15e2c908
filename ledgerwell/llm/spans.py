"""Spans of matches in a text as column expressions, with work that grows with the text and not with its square.

Places follow from the lengths of the matches and of what lies between them, by sums over blocks; a span's overlap with a sorted
list is found by halving; a masked text is joined from pieces that are cut out of short blocks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwell.llm.common import let

#: Values to a block of a running sum or maximum, and code points to a block of text that pieces are cut from.
BLOCK, CUT = 64, 4096
#: Steps of halving: lists of up to 2**30 spans.
STEPS = [1 << k for k in range(29, -1, -1)]
Fold = Callable[[Column], Column]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def highest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def blocked(values: Column, fold: Fold) -> Column:
    """struct(v, base): the values, and for each block of them the fold of all blocks before it."""
    number = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    folds = lambda v: F.transform(number(v), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))
    base = lambda f: F.transform(f, lambda x, b: fold(F.slice(f, F.lit(1), b)))
    return let(values, lambda v: F.struct(v.alias("v"), let(folds(v), base).alias("base")))


def upto(state: Column, i: Column, fold: Fold) -> Column:
    """The fold of the values up to place i, itself included."""
    b = F.floor(i / BLOCK).cast("int")
    return fold(F.array(F.get(state["base"], b), fold(F.slice(state["v"], b * BLOCK + 1, i - b * BLOCK + 1))))


def located(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The matches of a pattern that pass keep, in order: an array of (start, end, match); code points, end exclusive.

    A match holds at least one character.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))

    def measured(s: Column) -> Column:
        lengths = F.transform(s["m"], lambda m, i: F.length(m) + F.length(F.get(s["gaps"], i)))
        return F.struct(s["m"].alias("m"), blocked(lengths, total).alias("sums"))

    def placed(s: Column) -> Column:
        kept = F.sequence(F.lit(0), F.size(s["m"]) - 1)
        if keep is not None:
            kept = F.filter(kept, lambda i: keep(F.get(s["m"], i)))
        ends = F.transform(kept, lambda i: F.struct(upto(s["sums"], i, total).alias("end"), F.get(s["m"], i).alias("match")))
        return F.transform(ends, lambda e: F.struct((e["end"] - F.length(e["match"])).alias("start"), e["end"].alias("end"), e["match"].alias("match")))

    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return let(found, lambda s: F.when(F.size(s["m"]) > 0, let(measured(s), placed)).otherwise(empty))


def starting_before(spans: Column, place: Column) -> Column:
    """How many of the spans, sorted by start, begin before a place."""
    more = lambda at, step: (at + step <= F.size(spans)) & (F.get(spans, at + step - 1)["start"] < place)
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda at, step: F.when(more(at, step), at + step).otherwise(at))


def clear_of(span: Column, spans: Column) -> Column:
    """Whether a span meets none of the spans, which are sorted and don't overlap each other."""
    return let(starting_before(spans, span["end"]), lambda n: (n == 0) | (F.get(spans, n - 1)["end"] <= span["start"]))


def merged(spans: Column) -> Column:
    """Sorted spans (start, end, ...) with those that overlap made one, which keeps the other fields of the first."""

    def reached(s: Column) -> Column:
        state = blocked(F.transform(s, lambda x: x["end"]), highest)
        return let(state, lambda t: F.transform(s, lambda x, i: upto(t, i, highest)))

    def joined(s: Column, ends: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(ends, i - 1)))

        def made(h: Column) -> Column:
            stop = lambda k: F.coalesce(F.get(h, k + 1), F.size(s))
            return F.transform(h, lambda i, k: F.get(s, i).withField("end", F.get(ends, stop(k) - 1)))

        return let(heads, made)

    return let(spans, lambda s: F.when(F.size(s) > 0, let(reached(s), lambda ends: joined(s, ends))).otherwise(s))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans (start, end, mask) replaced by its mask; spans that overlap count as one, with the first's mask."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CUT).cast("int")), lambda b: F.substr(text, b * CUT + 1, F.lit(CUT)))

    def joined(s: Column) -> Column:
        def cut(a: Column, z: Column) -> Column:
            first = F.floor(a / CUT).cast("int")
            part = F.array_join(F.slice(s["blocks"], first + 1, F.floor(z / CUT).cast("int") - first + 1), "")
            return F.when(z > a, F.substr(part, a - first * CUT + 1, z - a)).otherwise("")

        before = lambda i: F.coalesce(F.get(s["spans"], i - 1)["end"], F.lit(0))
        pieces = F.transform(s["spans"], lambda x, i: F.concat(cut(before(i), x["start"]), x["mask"]))
        return F.concat(F.array_join(pieces, ""), cut(before(F.size(s["spans"])), F.length(text)))

    return F.when(F.size(spans) > 0, let(F.struct(blocks.alias("blocks"), merged(spans).alias("spans")), joined)).otherwise(text)
