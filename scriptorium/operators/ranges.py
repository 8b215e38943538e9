"""Numbering rows over range partitions, so that no key and no constant decides how much one task sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.session import cut_lineage

#: The lower bits of ``monotonically_increasing_id``: the row's place in its partition.
_PLACE_BITS = (1 << 33) - 1


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` sorted over range partitions and written once, with ``part``, the partition, and ``at``, the place in it.

    The order has to end with what tells the rows of one key apart; then one key may fill as many partitions as it needs.
    """
    ordered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    return ordered.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)).alias("at")
    )


def carried(placed: DataFrame, group: list[str], last: Column | None = None) -> DataFrame:
    """What stands before each run of a group in a partition: ``part``, the group's columns with ``of_`` before their names, ``shift`` and ``carry``.

    ``at + shift`` is a row's place (from 0) in its group; ``carry`` is ``last`` of the group's row before the run.  There is
    one row for each group and partition it reaches, whatever its size.
    """
    totals = placed.groupBy(*group, "part").agg(
        F.count("*").alias("rows"), F.min("at").alias("first"), F.max_by(F.lit(None) if last is None else last, "at").alias("last")
    )
    by_part = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part")
    earlier = F.sum("rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(
        *[F.col(g).alias(f"of_{g}") for g in group], F.col("part").alias("of_part"), "first",
        (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.lag("last").over(by_part).alias("carry"),
    )


def same_run(group: list[str]) -> Column:
    """Joins placed rows with what :func:`carried` says of their run."""
    same = F.col("part") == F.col("of_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return same


def numbered(rows: DataFrame, order: list[str], group: list[str] | None = None, name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in ``order`` inside ``group``."""
    group = group or []
    placed = ranged(rows, [*group, *order])
    return placed.join(carried(placed, group), same_run(group)).select(
        *[F.col(c) for c in rows.columns], (F.col("at") + F.col("shift")).alias(name)
    )
