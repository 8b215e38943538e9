"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FILES = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("file_type", T.StringType()),
        T.StructField("encoding", T.StringType()),
    ]
)

ANNOTATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

CACHE = T.StructType(
    [T.StructField("original", T.StringType()), T.StructField("translated", T.StringType())]
)


def create_if_missing(spark: SparkSession, location: str, schema: T.StructType) -> None:
    """An empty Parquet table at ``location``; an existing one is left alone."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(location)


def read_table(spark: SparkSession, location: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(location)


def append(rows: DataFrame, location: str, schema: T.StructType) -> None:
    """Append in the column order and types of ``schema``."""
    rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(location)


# -- the annotation log -------------------------------------------------------


def write_batch(rows: DataFrame, location: str, batch: str) -> None:
    """Add ``rows`` to the log under a key; writing a key again replaces its rows, so a repeated run adds nothing."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in ANNOTATIONS]).write.mode("overwrite").parquet(f"{location}/batch={batch}")


def read_log(spark: SparkSession, location: str) -> DataFrame:
    """All batches of the log, with their key in ``batch``."""
    schema = T.StructType([*ANNOTATIONS.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).option("basePath", location).parquet(location)
