"""Array columns: a value bound once, and running sums in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """The sums before each element of an array of numbers, and the sum of all: one entry more than ``values``.

    The array is cut into about sqrt(n) blocks of sqrt(n) elements; sums are built up inside blocks and over the blocks, so n * sqrt(n)
    elements are copied, as appending to one array n times would copy n * n."""
    zero = F.array(F.lit(0).cast("long"))

    def grow(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        inside = F.transform(F.sequence(F.lit(1), F.size(v), width), lambda i: grow(F.slice(v, i, width)))

        def joined(parts: Column) -> Column:
            before = grow(F.transform(parts, lambda p: F.element_at(p, -1)))
            moved = lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 1, F.size(p) - 1), lambda s: s + F.get(b, k))))
            return let(before, lambda b: F.concat(moved(b), F.array(F.element_at(b, -1))))

        return F.when(F.size(v) > 0, let(inside, joined)).otherwise(zero)

    return let(values, whole)
