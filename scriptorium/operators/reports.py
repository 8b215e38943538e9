"""Counts, top-k tables and Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.operators.ranges import numbered
from scriptorium.sources.sinks import markdown_row

TOP = 20


def triage_summary(triage: DataFrame) -> DataFrame:
    return triage.agg(
        F.count("*").alias("files"),
        F.count_if("is_archive").alias("archives"),
        F.count_if(F.col("encoding") == "Shift-JIS").alias("shift_jis"),
        F.count_if("is_binary").alias("binary"),
    )


def _binary_counts(triage: DataFrame, key: str) -> DataFrame:
    # Counting where binary, not filtering first: the verdict is then computed once per
    # file, in the scan that also yields the key, and folded on the map side.
    return triage.groupBy(key).agg(F.count_if("is_binary").alias("files")).filter("files > 0")


def binary_extensions(triage: DataFrame) -> DataFrame:
    return _binary_counts(triage, "extension")


def binary_types(triage: DataFrame) -> DataFrame:
    return _binary_counts(triage, "file_type")


def top_k(counts: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """The ``k`` largest counts; equal ones by key, so the choice is stable."""
    return counts.orderBy(F.desc("files"), F.asc(key)).limit(k)


def _python_bool(col: Column) -> Column:
    return F.when(col, "True").otherwise("False")


def detail_rows(triage: DataFrame) -> DataFrame:
    """``path, line``: the Markdown row of each file."""
    return triage.select(
        "path",
        markdown_row(
            F.col("path"), _python_bool(F.col("is_archive")), F.col("encoding"), F.col("file_type"), F.lit("")
        ).alias("line"),
    )


def error_rows(errors: DataFrame) -> DataFrame:
    """``path, line``: the row of each file that could not be read."""
    missing = F.lit("N/A")
    return errors.select("path", markdown_row(F.col("path"), F.lit("False"), missing, missing, F.col("error")).alias("line"))


def count_rows(counts: DataFrame, key: str) -> DataFrame:
    return counts.select(markdown_row(F.col(key), F.col("files")).alias("line"))


# Headings of the two reports and of their tables.
_DETAILS = ("## File Details", "| File Path | RCS | Encoding | File Type | Error |", "| --- | --- | --- | --- | --- |")
_EXTENSIONS = ("## Top Binary Extensions", "| Extension | Count |", "| :--- | :--- |")
_TYPES = ("", "## Top File Types", "| File Type Description | Count |", "| :--- | :--- |")


def _block(rows: DataFrame, section: int, *lines: str | Column) -> DataFrame:
    """The ``lines`` of each of ``rows``, of which there is one, in order."""
    shown = F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines])
    return rows.select(F.lit(section).alias("section"), F.posexplode(shown).alias("rank", "line")).select(
        "section", F.col("rank").cast("long").alias("rank"), F.lit("").alias("key"), "line"
    )


def compose(triage: DataFrame, errors: DataFrame) -> DataFrame:
    """Both reports as ``section, rank, key, line``: totals, a row for each file by its path, and the top tables of binary files.

    ``errors``: ``path, error`` of the files that could not be read; they count as files and have a row.  Only totals and top tables
    are gathered; the rows of the files stay spread, and :func:`write_report` puts everything in order.
    """
    seen = triage.select("is_archive", "encoding", "is_binary")
    unread = errors.select(F.lit(False).alias("is_archive"), F.lit("N/A").alias("encoding"), F.lit(False).alias("is_binary"))
    totals = triage_summary(seen.unionByName(unread))
    counted = lambda text, column: F.concat(F.lit(text), column.cast("string"))
    details = detail_rows(triage).unionByName(error_rows(errors))

    def table(section: int, counts: DataFrame, key: str) -> DataFrame:
        return top_k(counts, key).select(
            F.lit(section).alias("section"), (-F.col("files")).alias("rank"), F.col(key).alias("key"), markdown_row(F.col(key), F.col("files")).alias("line")
        )

    parts = [
        _block(
            totals, 0, "# Source Code Analysis Report", "", counted("Total files analyzed: ", F.col("files")), "",
            counted("- RCS Files: ", F.col("archives")), counted("- Shift-JIS Files: ", F.col("shift_jis")),
            counted("- Binary Files: ", F.col("binary")), "", *_DETAILS,
        ),
        details.select(F.lit(1).alias("section"), F.lit(0).cast("long").alias("rank"), F.col("path").alias("key"), "line"),
        _block(totals, 2, "", "# Binary File Analysis Report", "", counted("Total Binary Files Found: ", F.col("binary")), "", *_EXTENSIONS),
        table(3, binary_extensions(triage), "extension"),
        _block(totals, 4, *_TYPES),
        table(5, binary_types(triage), "file_type"),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def write_report(lines: DataFrame, location: str) -> None:
    """Text files whose names are in the order of the report; they are sorted in range partitions, none of which passes the driver."""
    order = ["section", "rank", "key", "line"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(location)


def read_report(spark: SparkSession, location: str) -> DataFrame:
    """``place, line`` of a written report, by file and place in the file."""
    lines = spark.read.schema("line string").text(location).select(
        "line", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return numbered(lines, ["file", "block", "row"]).select("place", "line")


def action_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("entries"))
