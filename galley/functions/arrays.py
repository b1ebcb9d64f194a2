"""Ordered work inside one array column (one document per row).

``let`` binds a value once, so that an array used in several places is built
once however the optimizer rewrites the plan.  Steps are linear in the length of
the array, or sort it; a fold that appends to an array copies it at each step,
so ``running_sums`` folds in short blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    A fold over nothing: its end sees the value, and what it gives is passed on as
    it is, where an element of an array would be copied whole at each level.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def where(array: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """0-based positions ``i`` of the elements with ``keep(element, i)``."""
    return F.array_compact(F.transform(array, lambda x, i: F.when(keep(x, i), i)))


def runs(array: Column, breaks: Callable[[Column, Column], Column]) -> Column:
    """Runs of an array: ``array<struct(first, last, start, size)>``.

    ``breaks(x, previous)`` says whether ``x`` opens a new run (the first
    element always does).  ``first`` and ``last`` are the elements at the ends
    of a run, ``start`` is its 0-based position.
    """

    def cut(a: Column) -> Column:
        heads = where(a, lambda x, i: (i == 0) | breaks(x, F.get(a, i - 1)))
        return let(heads, lambda h: F.transform(h, lambda s, k: run(a, h, s, k)))

    def run(a: Column, h: Column, s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(h, k + 1), F.size(a))
        return F.struct(
            F.get(a, s).alias("first"),
            F.get(a, end - 1).alias("last"),
            s.alias("start"),
            (end - s).cast("long").alias("size"),
        )

    return let(array, cut)


def counts(array: Column) -> Column:
    """Distinct strings of an array with their counts: ``struct(word, n)``."""

    def heads(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(a), F.lit(1)) - 1)
        return F.filter(places, lambda i: ~F.equal_null(F.get(a, i), F.get(a, i - 1)))

    def cut(a: Column) -> Column:
        return let(
            heads(a),
            lambda h: F.transform(
                h,
                lambda s, k: F.struct(
                    F.get(a, s).alias("word"),
                    (F.coalesce(F.get(h, k + 1), F.size(a)) - s).cast("long").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(array), cut)


def at_least(ordered: Column, times: int) -> Column:
    """The strings of a sorted array that stand in it so many times."""
    return F.array_distinct(F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + (times - 1)) == x, F.lit(False))))


_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Running sums of integers from 0 on, one more than there are numbers."""

    def inner(block: Column) -> Column:
        return F.aggregate(
            block, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )

    def joined(blocks: Column) -> Column:
        totals = inner(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(
            totals,
            lambda t: F.concat(
                F.flatten(
                    F.transform(
                        blocks,
                        lambda b, k: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + F.get(t, k)),
                    )
                ),
                F.array(F.element_at(t, -1)),
            ),
        )

    def cut(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(_BLOCK))
        return let(F.transform(starts, lambda i: inner(F.slice(a, i, _BLOCK))), joined)

    return let(numbers, cut)


def scan(
    array: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    out_type: str,
    finish: Callable[[Column], Column] | None = None,
) -> Column:
    """What a sequential walk puts out, in order.

    ``step(state, x)`` is ``struct(state, out)`` with ``out`` an array of
    ``out_type``; ``finish(state)`` puts out what is left at the end.  Outputs are
    gathered block by block, so that no step copies all that came before it.
    """

    def inner(state: Column, block: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return let(
                step(acc["state"], x),
                lambda r: F.struct(
                    r["state"].alias("state"),
                    F.when(F.size(r["out"]) > 0, F.concat(acc["out"], r["out"])).otherwise(acc["out"]).alias("out"),
                ),
            )

        return F.aggregate(
            block, F.struct(state.alias("state"), F.array().cast(f"array<{out_type}>").alias("out")), one
        )

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(_BLOCK))
        return F.transform(starts, lambda i: F.slice(a, i, _BLOCK))

    def outer(a: Column) -> Column:
        none = F.array().cast(f"array<array<{out_type}>>")
        return F.aggregate(
            blocks(a),
            F.struct(start.alias("state"), none.alias("outs")),
            lambda acc, b: let(
                inner(acc["state"], b),
                lambda r: F.struct(
                    r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")
                ),
            ),
            lambda acc: F.flatten(
                F.concat(acc["outs"], F.array(finish(acc["state"]))) if finish else acc["outs"]
            ),
        )

    return let(array, outer)


def meet(left: Column, right: Column) -> Column:
    """Equal strings of two arrays: ``struct(key, l, r)``, with their 0-based
    positions on either side.  Both are sorted together, so no pair is compared."""

    def tagged(a: Column, side: int) -> Column:
        return F.transform(a, lambda k, i: F.struct(k.alias("k"), F.lit(side).alias("side"), i.alias("i")))

    def places(members: Column, side: int) -> Column:
        return F.transform(F.filter(members, lambda m: m["side"] == side), lambda m: m["i"])

    def groups(a: Column) -> Column:
        both = F.filter(
            runs(a, lambda x, prev: x["k"] != prev["k"]),
            lambda r: (r["first"]["side"] == 0) & (r["last"]["side"] == 1),
        )
        return F.transform(
            both,
            lambda r: let(
                F.slice(a, r["start"] + 1, r["size"].cast("int")),
                lambda m: F.struct(
                    r["first"]["k"].alias("key"), places(m, 0).alias("l"), places(m, 1).alias("r")
                ),
            ),
        )

    return let(F.sort_array(F.concat(tagged(left, 0), tagged(right, 1))), groups)
