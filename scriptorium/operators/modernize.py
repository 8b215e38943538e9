"""Version archives and the modernisation plan.  Nothing is deleted or overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import charset as cs, paths as px


def archives(files: DataFrame) -> DataFrame:
    return files.filter(px.is_archive(F.col("path"))).withColumn("target", px.archive_target(F.col("path")))


def with_target(files: DataFrame) -> DataFrame:
    """Archives whose checked-out file is present."""
    return archives(files).join(files.select(F.col("path").alias("target")), "target", "left_semi")


def without_target(files: DataFrame) -> DataFrame:
    return archives(files).join(files.select(F.col("path").alias("target")), "target", "left_anti")


def head_text(files: DataFrame, source: str = "text") -> DataFrame:
    """Adds ``head, head_text``: the newest revision inside the archive ``source``; null if there is none.

    The archive is cut into ``@``-quoted strings and what stands between, so text that
    looks like archive syntax cannot mislead.  Keywords are not expanded.
    """
    cut = files.withColumns(
        {
            "head": F.regexp_extract(source, r"\Ahead\s+([0-9.]+)\s*;", 1),
            "parts": F.regexp_extract_all(F.col(source), F.lit(r"@(?:[^@]++|@@)*+@|[^@]++"), F.lit(0)),
        }
    )
    quoted = F.filter(
        F.transform(
            F.col("parts"),
            lambda part, i: F.struct(
                part.alias("body"),
                F.get(F.col("parts"), i - 1).alias("keyword"),
                F.get(F.col("parts"), i - 3).alias("section"),
            ),
        ),
        lambda p: p["body"].startswith("@")
        & p["keyword"].rlike(r"\btext\s*\z")
        & (F.regexp_extract(p["section"], r"([0-9.]+)\s+log\s*\z", 1) == F.col("head")),
    )
    return (
        cut.withColumn("body", F.get(quoted, F.lit(0))["body"])
        .withColumn(
            "head_text",
            F.replace(
                F.substring(F.col("body"), F.lit(2), F.length("body") - 2), F.lit("@@"), F.lit("@")
            ),
        )
        .drop("parts", "body")
    )


# Kinds of log entry.
CLEAN, EXTRACT, DELETE, CONVERT, FAIL = "Cleaned", "Extracted", "Deleted", "Converted", "Failed"


def modernize_plan(files: DataFrame, order: str = "utf8_first") -> DataFrame:
    """What a run would do, as ``file_id, path, step, action, detail``.

    An archive beside its file is only cleaned up.  One without is extracted, deleted
    and its text converted if need be; one that cannot be read fails.  A NUL anywhere
    means hands off.  Any other file is converted unless it is ASCII, UTF-8 or of no known encoding.
    """
    archive, content = px.is_archive(F.col("path")), F.col("content")
    # Contents are read once and reduced to their verdict before anything is joined.
    judged = head_text(
        files.select("file_id", "path", "content", F.when(archive, cs.latin1(content)).alias("archived")), "archived"
    ).select(
        "file_id",
        "path",
        archive.alias("archive"),
        F.col("head_text").isNotNull().alias("readable"),
        (~archive & cs.has_nul(content)).alias("binary"),
        cs.detect(
            F.when(archive, cs.bytes_of_latin1(F.col("head_text"))).otherwise(content), order
        ).alias("encoding"),
    )
    present = with_target(files.select("file_id", "path")).select("file_id", F.lit(True).alias("present"))
    legacy = ~F.col("encoding").isin("ASCII", "UTF-8", cs.UNKNOWN)
    name = px.basename(F.col("path"))
    target = F.when(F.col("archive"), px.archive_target(name)).otherwise(name)

    def step(action: str, detail: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), detail.alias("detail"))

    convert = F.when(
        legacy, step(CONVERT, F.concat(target, F.lit(" ("), F.col("encoding"), F.lit(" -> UTF-8)")))
    )
    extract = step(EXTRACT, F.concat(name, F.lit(" -> "), target))
    actions = (
        F.when(F.col("archive") & F.col("present"), F.array(step(CLEAN, name)))
        .when(F.col("archive") & ~F.col("readable"), F.array(step(FAIL, name)))
        .when(F.col("archive"), F.array_compact(F.array(extract, step(DELETE, name), convert)))
        .when(~F.col("binary"), F.array_compact(F.array(convert)))
    )
    return (
        judged.join(present, "file_id", "left")
        .select("file_id", "path", F.posexplode(actions).alias("step", "a"))
        .select("file_id", "path", "step", "a.action", "a.detail")
    )
