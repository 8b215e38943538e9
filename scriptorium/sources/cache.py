"""The translation cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.sources.tables import CACHE

# Markers of a failed call.
NOTE_FAILURE = "[Trans Fail"
COMMENT_FAILURE = "[Translation Failed]"

_CSV = {"multiLine": "true", "escape": '"', "quote": '"', "header": "false", "encoding": "UTF-8"}


def load_cache_csv(spark: SparkSession, location: str) -> DataFrame:
    """Pairs of a headerless CSV; short rows are skipped and the last row of a key wins.

    A multi-line CSV cannot be split, so use this to import an existing cache and keep
    the large one as Parquet.
    """
    rows = (
        spark.read.schema(CACHE)
        .options(**_CSV, mode="PERMISSIVE", emptyValue="", nullValue="\u0000", lineSep="\n")
        .csv(location)
        .select(
            # Rows written with CRLF keep their carriage return in multi-line mode.
            F.regexp_replace("original", "\r\\z", "").alias("original"),
            F.regexp_replace("translated", "\r\\z", "").alias("translated"),
            # Part files carry random names, so the time of writing comes first.
            F.struct(
                F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.monotonically_increasing_id()
            ).alias("row_order"),
        )
    )
    return (
        rows.filter(F.col("original").isNotNull() & F.col("translated").isNotNull())
        .groupBy("original")
        .agg(F.max_by("translated", "row_order").alias("translated"))
    )


def append_cache_csv(pairs: DataFrame, location: str) -> None:
    pairs.select("original", "translated").write.mode("append").options(
        escape='"', quote='"', quoteAll="true", header="false", emptyValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(location)


def unseen(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """New pairs, one per key: what an append has to write.  A text without translation, or with a failure in its place, stays a miss."""
    translated = F.col("translated")
    failed = translated.contains(NOTE_FAILURE) | translated.contains(COMMENT_FAILURE)
    return (
        pairs.filter(translated.isNotNull() & ~failed)
        .groupBy("original")
        .agg(F.min("translated").alias("translated"))
        .join(cache.select("original"), "original", "left_anti")
    )
