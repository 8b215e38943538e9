"""Writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_version(files: DataFrame, location: str, version: int) -> None:
    """Store ``path, text`` as one version; earlier versions and the input stay as they are.

    Writing a version again replaces it, so a repeated run does not double it.
    """
    files.select("path", "text").write.mode("overwrite").parquet(f"{location}/version={version}")


def read_versions(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema("path string, text string, version int").option("basePath", location).parquet(location)


def latest_version(versions: DataFrame) -> DataFrame:
    """Newest text of each path.  Versions are compared by path and number alone; of the texts only the chosen rows are joined."""
    newest = versions.groupBy("path").agg(F.max("version").alias("version"))
    return versions.join(newest, ["path", "version"]).select("path", "version", "text")


def markdown_row(*cells: Column) -> Column:
    """One Markdown table row; pipes inside a cell are escaped."""
    shown = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
