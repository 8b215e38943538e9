"""Shapes of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotations as an, encoding as en, modernize as md, segments as sg, translation as tr
from scriptorium.plans import translation
from scriptorium.session import working_dir


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark):
    location = working_dir(spark, "files")
    spark.range(200).select(
        F.col("id").alias("file_id"), F.concat(F.lit("f"), "id", F.lit(".c")).alias("path"),
        F.lit("// あ\n").alias("text"), F.encode(F.lit("a"), "UTF-8").alias("content"), F.lit("unused").alias("unused"),
    ).write.parquet(location)
    return spark.read.parquet(location)


NARROW = {
    "lines": sg.line_segments, "sentences": sg.sentence_segments, "tokens": sg.code_tokens, "segments": sg.code_segments,
    "items": sg.detected_items, "places": sg.placed_segments, "candidates": sg.translation_candidates,
    "flags": sg.translated_flags, "numbered": sg.numbered_lines, "triage": en.classify, "structure": en.encoding_structural,
    "runs": en.sjis_runs, "chunks": en.chunk_probe, "heads": md.head_text,
}


@pytest.mark.parametrize("name", list(NARROW))
def test_narrow_operators_stay_in_the_jvm_without_shuffle(files, name):
    frame = NARROW[name](files)
    frame = frame.drop("path", "content", "unused", "text") if name == "heads" else frame
    shape = plan(frame).replace("Windows-31J", "")  # an encoding, not an operator
    for word in ("Exchange", "Window", "EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in shape
    assert "unused" not in shape.split("ReadSchema")[1].split("\n")[0]


def test_only_conversion_uses_python(files):
    assert plan(en.to_utf8(files)).count("ArrowEvalPython") == 1


def test_latest_is_a_partial_aggregate(spark):
    log = spark.range(10).select(
        "id", (F.col("id") % 3).alias("file_id"), F.lit(0).alias("line_number"), F.lit("c").alias("content"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
    )
    shape = plan(an.latest_annotation(log))
    assert "partial_max_by" in shape and "Window" not in shape


def test_injection_cuts_files_in_their_row(spark, files):
    """No window, and nothing but texts, candidates and gathered translations is exchanged."""
    location = working_dir(spark, "cache")
    spark.createDataFrame([("あ", "a")], "original string, translated string").write.parquet(location)
    shape = plan(tr.inject_translations(files, spark.read.parquet(location)))
    assert "Window" not in shape and "REPARTITION" not in shape and shape.count("Generate explode") == 1


@pytest.mark.parametrize("operator", ["edits", "merge"])
def test_blobs_are_parsed_once(spark, operator):
    blobs = spark.range(5).selectExpr("id AS file_id", "concat('a @lines\n# 1\n', id) AS blob")
    edits = spark.range(5).selectExpr("id", "id AS file_id", "1 AS line", "'x' AS content", "'x' AS note", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at")
    frame = an.apply_line_edits(blobs, edits) if operator == "edits" else an.merge_tool_notes(blobs, edits)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_texts_are_cut_once(spark, files):
    """Injection reads the stored pieces for its candidates and for its result, and the translator's texts are stored before they are read twice."""
    location = working_dir(spark, "cut")
    spark.createDataFrame([("あ", "a")], "original string, translated string").write.parquet(f"{location}/cache")
    injected = tr.inject_translations(files, spark.read.parquet(f"{location}/cache"))
    assert "regexp_extract_all" not in plan(injected) and injected.count() == 200
    rows = [(i, "é la maison // " * i, "fr", "s") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{location}/documents.parquet")
    assert "regexp_extract_all" not in plan(translation.user_translator(spark, location))
