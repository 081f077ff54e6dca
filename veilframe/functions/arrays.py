"""Helpers for computed arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, column: str, alias: str, *keep: str) -> DataFrame:
    """One row per element of a computed array, without computing the array twice.

    A plain ``explode`` makes the optimizer add a non-empty filter on the array and push it below the
    projection that computes it, so an expensive array would be evaluated for the filter and again
    for the rows. The outer form infers no filter; its placeholder rows are dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(column).alias(alias)).filter(F.col(alias).isNotNull())


def pinned(value: Column) -> Column:
    """The same value, computed exactly once per row.

    The optimizer pushes later filters below a projection by copying its expressions into the
    filter, and inlines a column used once into a lambda that runs per element. For rule sets that
    means running all patterns again. An expression it must treat as non-deterministic is neither
    copied nor moved; the condition is always true, so values do not change.
    """
    return F.when(F.rand(0) + F.lit(1.0) > 0, value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Elements that a running fold looks back over one by one; beyond them it looks at whole blocks.
LOOK_BACK = 32


def folded_before(items: Column, pick: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each element the fold of all earlier ones by ``pick``, which must be associative; null for the first.

    Nothing is copied per element: it folds the rest of its block onto the fold of all blocks before, which
    is found the same way from the blocks' folds.
    """
    def fold(start: Column, rest: Column) -> Column:
        return F.aggregate(rest, start, lambda a, x: F.when(a.isNull(), x).otherwise(pick(a, x)))

    def one_by_one(all_: Column) -> Column:
        return F.transform(all_, lambda x, j: fold(
            F.when(j > 0, all_[0]), F.slice(all_, F.lit(2), F.greatest(j - 1, F.lit(0)))))

    if not levels:
        return one_by_one(items)

    def over(blocks: Column) -> Column:
        def inside(heads: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, j: F.transform(
                b, lambda x, i: fold(heads[j], F.slice(b, F.lit(1), i)))))

        tops = F.transform(blocks, lambda b: fold(b[0], F.slice(b, 2, LOOK_BACK)))
        return let(tops, lambda t: let(folded_before(t, pick, levels - 1), inside))

    def cut(all_: Column) -> Column:
        count = F.floor((F.size(all_) - 1) / LOOK_BACK).cast("int")
        return F.when(F.size(all_) > LOOK_BACK, let(F.transform(F.sequence(F.lit(0), count), lambda j: F.slice(
            all_, j * LOOK_BACK + 1, LOOK_BACK)), over)).otherwise(one_by_one(all_))

    return let(items, cut)


#: Block sizes of a running fold over numbers, level by level, as powers of two.
BLOCK_BITS = (2, 4, 4)


def numbers_before(items: Column, pick: Callable[[Column, Column], Column], zero: Column, bits: tuple[int, ...] = BLOCK_BITS) -> Column:
    """For each number the fold of all earlier ones by ``pick``, which must be associative with ``zero`` as its neutral element.

    As ``folded_before``, but with little to do for each number: the smallest blocks are spelt out, not sliced.
    ``items`` is named several times, so it must be a column or a lambda's variable.
    """
    if not bits:
        return F.transform(items, lambda m, j: F.aggregate(F.slice(items, F.lit(1), j), zero, pick))
    size = 1 << bits[0]
    totals = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(items) - 1, bits[0])), lambda j: F.aggregate(
        F.slice(items, j * size + 1, size), zero, pick))

    def inside(heads: Column) -> Column:
        def here(m: Column, j: Column) -> Column:
            place, head = j.bitwiseAND(F.lit(size - 1)), heads[F.shiftright(j, bits[0])]
            if size > 4:
                return F.aggregate(F.slice(items, j - place + 1, place), head, pick)
            told, out = [head], F.when(place == 0, head)
            for back in range(1, size):
                told.append(pick(told[-1], items[j - back]))
                out = out.when(place == back, told[-1]) if back < size - 1 else out.otherwise(told[-1])
            return out

        return F.transform(items, here)

    return F.when(F.size(items) > 0, let(let(totals, lambda t: numbers_before(t, pick, zero, bits[1:])), inside)).otherwise(items)


def cut_at(items: Column, starts: Column) -> Column:
    """Slices of ``items`` from each start (counted from 0) up to the next."""
    return F.transform(starts, lambda p, k: F.slice(
        items, p + 1, F.coalesce(F.try_element_at(starts, k + 2), F.size(items)) - p))
