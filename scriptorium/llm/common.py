"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts define it, for Java regular expressions and RE2 alike.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is; pure ASCII takes the fast built-in."""
    mapped = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(mapped)


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the checkpoint folder that all executors share, and read them from there."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return rows.checkpoint()


def numbered(rows: DataFrame, order: list[str], group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """``rows`` with their place from 0 in ascending ``order`` (null first) inside ``group``; what ties is numbered as it falls.

    Rows are sorted in range partitions and written; each partition's totals per group (one row each) are summed up and
    added.  So a group of any size is sorted by many tasks, and a task that runs again reads the same rows.
    """
    group = group or []
    part, at = f"{name}_part", f"{name}_at"
    ordered = cut_lineage(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order))
    # The lower 33 bits of such an id are the row's place in its partition.
    placed = ordered.select(
        "*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at)
    )
    totals = placed.groupBy(*group, part).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    shifts = totals.select(*[F.col(g).alias(f"{name}_of_{g}") for g in group], F.col(part).alias(f"{name}_of"), shift.alias(f"{name}_shift"))
    same = F.col(part) == F.col(f"{name}_of")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{name}_of_{g}"))
    return placed.join(shifts, same).select(*[F.col(c) for c in rows.columns], (F.col(at) + F.col(f"{name}_shift")).alias(name))


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` joined with ``small``, one row of it for each ``key``; rows of one key are spread over ``salts`` tasks by the column ``by``.

    Adaptive execution splits a task further that is still too large, and broadcasts ``small`` where its size allows.
    """
    spread = rows.withColumn("salt_of", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = small.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "salt_of"], how).drop("salt_of")


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table below the shared folder: for long tables, which take less room in columns than as a checkpoint."""
    path = work_folder(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def one_of_each(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """``docs`` in which rows of equal id and ``key`` stand once; ``keys`` (``doc_id, key``) has a row for each of them.

    Only rows that are known to repeat are compared.
    """
    again = cut_lineage(keys.groupBy(F.col("doc_id").alias("again_id"), F.col("key").alias("again_key")).agg(F.count("*").alias("again_n")).where("again_n > 1"))
    if again.isEmpty():
        return docs
    same = docs["doc_id"].eqNullSafe(F.col("again_id")) & (key == F.col("again_key"))
    repeated = docs.withColumn("again_of", key).join(again, same, "left_semi").dropDuplicates(["doc_id", "again_of"]).drop("again_of")
    return docs.join(again, same, "left_anti").unionByName(repeated)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one task, sorted by ``keys`` (numbers), as one frame for each value of the keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        if held and (held[-1][keys].to_numpy()[-1] != values[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        cuts = ((values[1:] != values[:-1]).any(axis=1).nonzero()[0] + 1).tolist()
        for start, stop in zip([0, *cuts], cuts):
            yield pd.concat([*held, batch.iloc[start:stop]], ignore_index=True)
            held = []
        held.append(batch.iloc[cuts[-1] if cuts else 0 :])
    if held:
        yield pd.concat(held, ignore_index=True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (longs ``a``, ``b``).

    Returns ``node, root`` for every node whose component has a smaller node; ``root`` is the smallest.
    Alternates the large-star and small-star steps, each written to the checkpoint folder, until
    the edges stand still.  A hub is never gathered: its smallest neighbour is a partial minimum, and the
    joins are plain equi-joins of exchanged rows, which adaptive execution splits.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now, before = cut_lineage(both.distinct()), None
    while (state := _state(now)) != before:
        before = state
        now = cut_lineage(_small_star(_large_star(now)))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder in ``spark.checkpoint.dir``; only a local session without it uses a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="work-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
