"""Column functions over long arrays inside a row: running sums and maxima without quadratic copying."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def _before(lengths: Column, first: Column) -> Column:
    """``first`` plus the sum of the lengths before each one, for short arrays."""
    start = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(lengths, start, step)["out"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def offsets(lengths: Column) -> Column:
    """The sum of the lengths before each one.  Counted in blocks, as an array that grows by appending is copied each time."""
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x)
    last = lambda n: F.floor((F.size(n) - 1) / _BLOCK).cast("int")
    cut = lambda n: F.transform(F.sequence(F.lit(0), last(n)), lambda b: F.slice(n, b * _BLOCK + 1, _BLOCK))
    sums = lambda blocks: F.arrays_zip(blocks.alias("b"), _before(F.transform(blocks, total), F.lit(0)).alias("at"))
    whole = lambda n: F.flatten(F.transform(let(cut(n), sums), lambda z: _before(z["b"], z["at"])))
    return let(lengths, lambda n: F.when(F.size(n) > 0, whole(n)).otherwise(F.array().cast("array<bigint>")))


def largest_before(values: Column) -> Column:
    """The largest of the values before each one, -1 if there is none; in blocks, as above."""
    kind = "array<bigint>"

    def inside(block: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("at"), F.array().cast(kind).alias("out"))
        step = lambda s, x: F.struct(F.greatest(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(block, start, step)["out"]

    last = lambda n: F.floor((F.size(n) - 1) / _BLOCK).cast("int")
    cut = lambda n: F.transform(F.sequence(F.lit(0), last(n)), lambda b: F.slice(n, b * _BLOCK + 1, _BLOCK))
    tops = lambda blocks: F.arrays_zip(blocks.alias("b"), inside(F.transform(blocks, lambda b: F.array_max(b)), F.lit(-1)).alias("at"))
    whole = lambda n: F.flatten(F.transform(let(cut(n), tops), lambda z: inside(z["b"], z["at"])))
    return let(values, lambda n: F.when(F.size(n) > 0, whole(n)).otherwise(F.array().cast(kind)))


def merged(runs: Column) -> Column:
    """``array<struct<start, end>>``, sorted by start, with overlapping or touching runs as one run each.

    A run opens where it lies behind all ends before it, and ends at the last of those before the next that opens.
    """

    def spans(rows: Column) -> Column:
        ends = F.transform(rows, lambda r: r["end"].cast("long"))
        seen = F.arrays_zip(rows.alias("r"), largest_before(ends).alias("ended"))
        opened = F.filter(seen, lambda z: z["r"]["start"] > z["ended"])
        last = F.array_max(ends)
        return let(opened, lambda o: F.transform(o, lambda z, i: F.struct(
            z["r"]["start"].cast("int").alias("start"), F.coalesce(F.get(o, i + 1)["ended"], last).cast("int").alias("end")
        )))

    return let(runs, spans)
