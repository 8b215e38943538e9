"""The append-only annotation log and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import blob as bl, text as tx
from scriptorium.operators import ranges as rg

#: The line number of the log's rows that hold a whole blob.
FILE_LEVEL = 0


def _log_order() -> Column:
    """Seconds can tie, ids cannot."""
    return F.struct("created_at", "id")


def file_annotations(files: DataFrame, annotations: DataFrame) -> DataFrame:
    return files.join(annotations, "file_id")


def latest_annotation(annotations: DataFrame) -> DataFrame:
    """Newest file-level row of each file: ``file_id, id, content, created_at``.

    A maximum with partial aggregation: a file with a third of the log sends one row
    per task, where a ranking window would sort all of it in one.
    """
    return (
        annotations.filter(F.col("line_number") == FILE_LEVEL)
        .groupBy("file_id")
        .agg(F.max_by(F.struct("id", "content", "created_at"), _log_order()).alias("a"))
        .select("file_id", "a.*")
    )


def latest_manual_note(annotations: DataFrame) -> DataFrame:
    """Newest manual row by id, whatever its line."""
    return (
        annotations.filter(F.col("type") == "manual")
        .groupBy("file_id")
        .agg(F.max_by(F.struct("id", "content"), "id").alias("a"))
        .select("file_id", "a.*")
    )


def annotation_history(annotations: DataFrame) -> DataFrame:
    """Every row with its version number in the file and the content before it.

    The log is sorted over range partitions by file, time and id, so that one busy file, even one imported at a single
    time, fills as many tasks as it needs.  Each partition's totals and last contents are carried over to the next.
    Rows without time come first.
    """
    placed = rg.ranged(annotations.select("file_id", "id", "content", "created_at"), ["file_id", "created_at", "id"])
    runs = rg.carried(placed, ["file_id"], F.col("content"))
    parts = placed.rdd.getNumPartitions()
    # Rows go back to the partition they were sorted in, where each file's run is one window.
    run = Window.partitionBy("part", "file_id").orderBy("at")
    previous = placed.repartitionById(parts, F.col("part")).withColumn("before", F.lag("content").over(run))
    return previous.join(runs, rg.same_run(["file_id"])).select(
        "file_id",
        "id",
        (F.col("at") + F.col("shift") + 1).alias("version"),
        "content",
        F.when(F.col("at") == F.col("first"), F.col("carry")).otherwise(F.col("before")).alias("previous"),
    )


# -- blobs --------------------------------------------------------------------


def parse_annotation_blob(blobs: DataFrame) -> DataFrame:
    """``file_id, line, note``: the file note, if any, has no line; a heading ``# 0`` is a line like others.

    A heading of more than 18 digits is no line number and stays in the note above it.
    """
    top = F.array(F.struct(F.lit(None).alias("line"), bl.file_note(F.col("blob")).alias("note"))).cast(bl.NOTES)
    return (
        blobs.select("file_id", F.explode(F.concat(top, bl.line_notes(F.col("blob")).cast(bl.NOTES))).alias("n"))
        .select("file_id", "n.*")
        .filter(F.col("line").isNotNull() | (F.col("note") != ""))
    )


def blob_rebuild(notes: DataFrame) -> DataFrame:
    """``file_id, blob`` from ``file_id, line, note``; of several notes of a line the greatest text counts.

    What is collected is the one value that each file's blob is.
    """
    line, note = F.col("line"), F.col("note")
    return notes.groupBy("file_id").agg(
        F.max(F.when(line.isNull(), note)).alias("top"),
        F.collect_set(F.when(line.isNotNull() & note.isNotNull(), F.struct(line.cast("bigint").alias("line"), F.lit(0).alias("rank"), note.alias("note")))).alias("notes"),
    ).select("file_id", bl.rebuild(F.col("top"), bl.last_of_lines(F.col("notes"))).alias("blob"))


def apply_line_edits(blobs: DataFrame, edits: DataFrame) -> DataFrame:
    """``file_id, blob`` after ``edits`` (``id, file_id, line, content, created_at``) in time order.

    An edit of line 0 replaces the blob, a blank one deletes its line, any other sets it; edits without time come first.
    Only what the outcome depends on is kept: the last replacement of a file and, after it, the last edit of each
    line.  Edits are merged inside the row of their file; a blob nobody edited line by line is not parsed and stays
    as it was written.  A negative line is written in its place, but reads back as text.
    """
    replaced = (
        edits.filter(F.col("line") == FILE_LEVEL)
        .groupBy("file_id")
        .agg(F.max(F.struct("created_at", "id", F.col("content").alias("blob"))).alias("r"))
    )
    # Reduced to one row per line before the join: a busy file brings no more than its lines.
    live = (
        edits.filter(F.col("line") != FILE_LEVEL)
        .groupBy("file_id", "line")
        .agg(F.max(F.struct("created_at", "id", "content")).alias("e"))
        .join(replaced, "file_id", "left")
        .filter(F.col("r").isNull() | (F.struct("e.created_at", "e.id") > F.struct("r.created_at", "r.id")))
        .groupBy("file_id")
        .agg(F.collect_list(F.struct(F.col("line").cast("bigint").alias("line"), F.col("e.content").alias("note"))).alias("edits"))
    )
    def edited(blob: Column) -> Column:
        merged = bl.last_of_lines(F.concat(bl.ranked(bl.line_notes(blob), 0), bl.ranked(F.col("edits"), 1)))
        return bl.rebuild(bl.file_note(blob), F.filter(merged, lambda n: tx.strip(n["note"]) != ""))

    blob = F.when(F.col("r").isNotNull(), F.col("r.blob")).otherwise(F.col("blob"))
    return (
        blobs.select("file_id", "blob")
        .join(replaced, "file_id", "full_outer")
        .join(live, "file_id", "full_outer")
        .select("file_id", tx.bound(blob, lambda b: F.when(F.col("edits").isNotNull(), edited(b)).otherwise(b)).alias("blob"))
    )


def merge_tool_notes(blobs: DataFrame, notes: DataFrame) -> DataFrame:
    """``file_id, blob`` with ``notes`` (``file_id, line, note``) merged in; changed blobs only.

    Notes are gathered by file first, so that only the blobs they belong to are joined and parsed.  Rows without
    line or note are left out; several notes of a line are appended in the order of their text.
    """
    new = (
        notes.filter(F.col("line").isNotNull() & F.col("note").isNotNull())
        .groupBy("file_id", F.col("line").cast("bigint").alias("line"))
        .agg(F.array_sort(F.collect_set("note")).alias("notes"))
        .groupBy("file_id")
        .agg(F.collect_list(F.struct("line", "notes")).alias("new"))
    )
    merged = bl.rebuild(bl.file_note(F.col("blob")), bl.merge_notes(
        F.coalesce(bl.line_notes(F.col("blob")), F.array().cast(bl.NOTES)), F.col("new")
    ))
    # A list of the changed blob or nothing: a filter on the merged blob would have it computed twice.
    changed = F.filter(F.array(merged), lambda m: ~m.eqNullSafe(F.col("blob")))
    return new.join(blobs.select("file_id", "blob"), "file_id", "left").select("file_id", F.explode(changed).alias("blob"))


def new_versions(blobs: DataFrame, log: DataFrame, created_at: Column, kind: str = "auto_translate") -> DataFrame:
    """``blobs`` (``file_id, blob``) as rows of the log, for the files whose newest blob in ``log`` says something else.

    Ids go on behind the largest one of ``log`` in the order of the files.
    """
    newest = latest_annotation(log).select("file_id", F.col("content").alias("was"))
    changed = blobs.join(newest, "file_id", "left").filter(~F.col("blob").eqNullSafe(F.col("was")))
    last = log.agg(F.max("id")).first()[0] or 0  # one number
    return rg.numbered(changed.select("file_id", "blob"), ["file_id"]).select(
        (F.col("place") + last + 1).alias("id"), "file_id", F.lit(FILE_LEVEL).alias("line_number"), F.col("blob").alias("content"),
        F.lit(None).cast("string").alias("author"), F.lit(kind).alias("type"), created_at.cast("timestamp_ntz").alias("created_at"),
    )


# -- lines and snapshots ------------------------------------------------------


def annotated_lines(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """Numbered lines with their note, if any."""
    return lines.join(notes, ["file_id", "line"], "left").select(
        "file_id", "line", "text", "note", F.col("note").isNotNull().alias("has_note")
    )


def current_notes(annotations: DataFrame) -> DataFrame:
    """Newest row of every line: ``file_id, line, note``."""
    return annotations.groupBy("file_id", F.col("line_number").alias("line")).agg(
        F.max_by("content", _log_order()).alias("note")
    )


def annotation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns snapshot ``old`` into ``new``: ``file_id, line, action, note``.

    A stale line is removed only if it has something written on it.
    """
    was, now = F.col("was"), F.col("now")
    return (
        old.select("file_id", "line", F.col("note").alias("was"), F.lit(True).alias("in_old"))
        .join(
            new.select("file_id", "line", F.col("note").alias("now"), F.lit(True).alias("in_new")),
            ["file_id", "line"],
            "full_outer",
        )
        .select(
            "file_id",
            "line",
            F.when(F.col("in_old").isNull(), "create")
            .when(F.col("in_new").isNull(), F.when(F.coalesce(was, F.lit("")) != "", "remove").otherwise("keep"))
            .when(was.eqNullSafe(now), "unchanged")
            .otherwise("update")
            .alias("action"),
            F.coalesce(now, was).alias("note"),
        )
    )


def tool_output(outputs: DataFrame) -> DataFrame:
    """Notes inside mixed tool output: ``file_id, line, note, error``; every output gives notes or exactly one error row.

    JSON goes from the first ``{`` to the end.  Of a repeated key the last counts; a key that is no number, or a null
    note, spoils the whole output, as does text behind the JSON.  An ``error`` counts if there are no ``annotations``.
    """
    start = F.coalesce(F.instr("output", "{"), F.lit(0))
    json = F.when(start > 0, F.substring(F.col("output"), start, F.length("output")))
    # The reader ignores what follows a value; inside a list and inside an object the same text cannot both go unnoticed.
    listed = F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<struct<annotations:map<string,string>,error:string>>")
    nested = F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")
    entries = F.transform(
        F.map_entries(F.col("p")[0]["annotations"]),
        lambda e, i: F.struct(F.trim(e["key"]).try_cast("bigint").alias("line"), i.alias("rank"), e["value"].alias("note")),
    )
    failure = (
        F.when(start == 0, "no JSON")
        .when(F.col("p").isNull() | (F.size("p") != 1) | F.col("q.v").isNull(), "bad JSON")
        .when(F.size(F.col("p")[0]["annotations"]) > 0, F.when(
            F.exists("entries", lambda e: e["line"].isNull() | e["note"].isNull()), "bad note"
        ))
        .otherwise(F.coalesce(F.col("p")[0]["error"], F.lit("no annotations")))
    )
    found = F.when(F.col("failure").isNull(), bl.last_of_lines(F.col("entries"))).otherwise(
        F.array(F.struct(F.lit(None), F.lit(None))).cast(bl.NOTES)
    )
    return (
        outputs.withColumn("p", listed)
        .withColumn("q", nested)
        .withColumn("entries", entries)
        .withColumn("failure", failure)
        .select("file_id", F.explode(found).alias("r"), "failure")
        .select("file_id", "r.line", "r.note", F.col("failure").alias("error"))
    )
