"""Blobs, edits and snapshots against a plain one-after-the-other replay."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotations as an, ranges as rg
from scriptorium.session import working_dir
from scriptorium.sources import tables as tb


def parse(blob):
    top, mark, rest = blob.partition("@lines")
    if not mark:
        return blob, {}
    pieces = re.split(r"^#\s*(\d+)\s*", rest.strip(), flags=re.MULTILINE)
    notes = {}
    for number, note in zip(pieces[1::2], pieces[2::2]):
        if note.strip():
            notes[int(number)] = note.strip()
    return top.strip(), notes


def build(top, notes):
    body = "".join(f"# {line}\n{notes[line].strip()}\n" for line in sorted(notes) if notes[line].strip())
    return (top.strip() + "\n\n" + ("@lines\n" + body if notes else "")).strip()


def random_blobs(count, seed=11):
    rng = random.Random(seed)
    parts = ["@lines", "\n", "\n", "# 3", "# 0", "# 12345678901\n", "#4x", "# 12\n", "note", " ", "　", "#", "5", "\n#\n7", "\t", "a # 9"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(count)]


@pytest.fixture(scope="module")
def blobs(spark):
    values = random_blobs(1500)
    return values, spark.createDataFrame(list(enumerate(values)), "file_id long, blob string").repartition(8)


def test_parse(blobs):
    values, frame = blobs
    found = {}
    for row in an.parse_annotation_blob(frame).collect():
        found.setdefault(row.file_id, {})[row.line] = row.note
    for number, blob in enumerate(values):
        top, notes = parse(blob)
        assert found.get(number, {}) == {**notes, **({None: top} if top else {})}, repr(blob)


def test_round_trip(spark):
    rng = random.Random(2)
    notes = {
        n: {line: f"note {rng.random()}\nmore" for line in rng.sample(range(50), rng.randrange(1, 6))} for n in range(200)
    }
    rows = [(n, line, note) for n, lines in notes.items() for line, note in lines.items()]
    frame = spark.createDataFrame(rows, "file_id long, line long, note string")
    rebuilt = an.blob_rebuild(frame)
    assert {r.file_id: r.blob for r in rebuilt.collect()} == {n: build("", lines) for n, lines in notes.items()}
    assert an.parse_annotation_blob(rebuilt).exceptAll(frame).count() == 0


def test_edits_equal_replay(spark):
    rng = random.Random(4)
    start = {n: build(f"file {n}", {k: f"was {k}" for k in rng.sample(range(1, 9), 3)}) for n in range(40)}
    start[40], start[41] = "", "only a file note"
    edits, clock = [], dt.datetime(2024, 1, 1)
    for number in range(1200):
        clock += dt.timedelta(seconds=rng.randrange(2))
        line = 0 if rng.random() < 0.03 else rng.randrange(1, 9)
        content = rng.choice(["", " 　", f"edit {number}"]) if line else build("reset", {1: f"reset {number}"})
        edits.append((number, rng.randrange(44), line, content, clock))
    expected = dict(start)
    for _, file_id, line, content, _ in edits:
        top, notes = parse(expected.get(file_id, ""))
        if line == 0:
            expected[file_id] = content
            continue
        notes.pop(line, None)
        if content.strip():
            notes[line] = content
        expected[file_id] = build(top, notes)
    frame = spark.createDataFrame(edits, "id long, file_id long, line int, content string, created_at timestamp_ntz")
    result = an.apply_line_edits(
        spark.createDataFrame(list(start.items()), "file_id long, blob string"), frame.repartition(8)
    )
    assert {r.file_id: r.blob for r in result.collect()} == expected


def test_merge_appends_once(spark):
    blob = build("top", {3: "old", 4: "has Translated: x inside"})
    base = spark.createDataFrame([(1, blob), (2, build("", {1: "n"})), (3, "untouched")], "file_id long, blob string")
    notes = spark.createDataFrame(
        [(1, 3, "new"), (1, 4, "Translated: x"), (1, 9, "added"), (2, 1, "n"), (7, 1, "first")],
        "file_id long, line int, note string",
    )
    merged = an.merge_tool_notes(base, notes)
    # File 2 already says so: no new version.  File 7 had no blob.
    assert {r.file_id: r.blob for r in merged.collect()} == {
        1: build("top", {3: "old\n\nnew", 4: "has Translated: x inside", 9: "added"}),
        7: build("", {1: "first"}),
    }
    again = an.merge_tool_notes(merged, notes.filter("file_id IN (1, 7)"))
    assert again.count() == 0


def test_history_across_slots(spark):
    """One file holds most of the log, over many slots and inside one."""
    rng = random.Random(9)
    rows = [
        (n, 1 if n % 3 else n, 5, f"c{n}", None, "manual", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(40_000)))
        for n in range(3000)
    ]
    log = spark.createDataFrame(
        rows, "id long, file_id long, line_number int, content string, author string, type string, created_at timestamp_ntz"
    ).repartition(8)
    expected = {}
    for row in sorted(rows, key=lambda r: (r[6], r[0])):
        seen = expected.setdefault(row[1], [])
        seen.append((row[0], len(seen) + 1, seen[-1][3] if seen else None, row[3]))
    found = {}
    for row in an.annotation_history(log).collect():
        found.setdefault(row.file_id, []).append((row.id, row.version, row.previous, row.content))
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in found.items()} == expected


@pytest.fixture
def fixed_partitions(spark):
    """Small partitions are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_history_of_a_bulk_import_is_even(spark, fixed_partitions):
    """A third of the log belongs to one file and to one time: no task sorts much more than another."""
    log = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("file_id"), (F.lit(50_000) - F.col("id")).alias("id"),
        F.concat(F.lit("c"), "id").alias("content"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"),
    )
    placed = rg.ranged(log, ["file_id", "created_at", "id"])
    sizes = sorted(r["count"] for r in placed.groupBy("part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    history = an.annotation_history(log)
    tasks = sorted(r["count"] for r in history.groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 2 * tasks[len(tasks) // 2]
    busy = history.filter("file_id = 7").orderBy("version").collect()
    assert [r.version for r in busy] == list(range(1, 8002))[: len(busy)] and len(busy) >= 8000
    assert [r.previous for r in busy[1:]] == [r.content for r in busy[:-1]] and busy[0].previous is None


def test_numbering(spark):
    rows = spark.createDataFrame([(g, n) for g in (None, 1, 2, 2, 2) for n in (5, None, 3)], "g long, n long")
    got = rg.numbered(rows, ["n"], ["g"])
    assert sorted((r.g or 0, r.place) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)] + [(2, p) for p in range(9)]
    assert rg.numbered(rows.limit(0), ["n"]).count() == 0


def test_appending_again_adds_nothing(spark):
    location = working_dir(spark, "log")
    when = dt.datetime(2024, 1, 1)
    start = spark.createDataFrame([(1, 1, 0, "top", "a", "manual", when), (2, 2, 0, "same", "a", "manual", when)], tb.ANNOTATIONS)
    tb.write_batch(start, location, "import")
    blobs = spark.createDataFrame([(1, "top and more"), (2, "same"), (3, "new")], "file_id long, blob string")
    for batch in ("b1", "b1", "b2"):
        log = tb.read_log(spark, location).filter(F.col("batch") != batch)
        tb.write_batch(an.new_versions(blobs, log, F.lit("2024-02-01")), location, batch)
        rows = tb.read_log(spark, location)
        assert rows.count() == 4 and rows.select("id").distinct().count() == 4
        newest = {r.file_id: (r.id, r.content) for r in an.latest_annotation(rows).collect()}
        assert newest == {1: (3, "top and more"), 2: (2, "same"), 3: (4, "new")}


def test_latest_breaks_ties_by_id(spark):
    when = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [(1, 1, 0, "a", when, "manual"), (2, 1, 0, "b", when, "x"), (3, 1, 4, "c", when, "manual")],
        "id long, file_id long, line_number int, content string, created_at timestamp_ntz, type string",
    )
    assert an.latest_annotation(log).first().content == "b"
    assert an.latest_manual_note(log).first().content == "c"


def test_diff_keeps_empty_stale_lines(spark):
    schema = "file_id long, line int, note string"
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "c"), (1, 4, "d")], schema)
    new = spark.createDataFrame([(1, 3, "c"), (1, 4, "D"), (1, 5, "e")], schema)
    assert {r.line: r.action for r in an.annotation_diff(old, new).collect()} == {
        1: "remove", 2: "keep", 3: "unchanged", 4: "update", 5: "create",
    }


def test_tool_output(spark):
    rows = [
        (1, 'log {"annotations": {"3": "a", "4": "b {c}"}}'), (2, "no json"), (3, '{"annotations": {"1'),
        (4, '{"error": "gone"}'), (5, '{"annotations": {}}'),
        (6, '{"annotations": {"1": "a"}} {"annotations": {"1": "b"}}'), (7, '{"annotations": {"1": "a"}}] }'),
        (8, '{"annotations": {"1": "a"}}} x}'), (9, '{"annotations": {"1": "a"}}, "w": {}'), (10, None), (11, '{"annotations": {"x": "a"}}'),
        (12, '{"annotations": {"5": "a", "5": "b"}} \n'), (13, "{}"), (14, '{"annotations": {"1": null}}'), (15, '{"annotations": "x"}'),
    ]
    found = an.tool_output(spark.createDataFrame(rows, "file_id long, output string")).collect()
    assert sorted((r.file_id, r.line, r.note, r.error) for r in found if r.line) == [
        (1, 3, "a", None), (1, 4, "b {c}", None), (12, 5, "b", None),
    ]
    assert {r.file_id: r.error for r in found if r.error} == {
        2: "no JSON", 3: "bad JSON", 4: "gone", 5: "no annotations", **dict.fromkeys((6, 7, 8, 9), "bad JSON"), 10: "no JSON",
        11: "bad note", 13: "no annotations", 14: "bad note", 15: "no annotations",
    }
    assert len(found) == len(rows) + 1


def test_history_keeps_rows_without_time(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES (1L, 1L, 'old', NULL), (2L, 1L, 'older', NULL), (3L, 1L, 'new', TIMESTAMP_NTZ'2024-01-01 00:00:00'),
           (4L, NULL, 'alone', NULL) AS t(id, file_id, content, created_at)"""
    )
    got = {r.id: (r.version, r.previous) for r in an.annotation_history(rows).collect()}
    assert got == {1: (1, None), 2: (2, "old"), 3: (3, "older"), 4: (1, None)}


def test_line_zero_long_and_negative_lines(spark):
    blob = "head\n\n@lines\n# 0\nzero\n# 2\ntwo\n# 12345678901\nfar"
    base = spark.createDataFrame([(1, blob)], "file_id long, blob string")
    assert an.blob_rebuild(an.parse_annotation_blob(base)).first().blob == blob
    note = spark.createDataFrame([(1, 0, "tool"), (1, 2, "b"), (1, 2, "a"), (1, None, "x")], "file_id long, line int, note string")
    assert an.merge_tool_notes(base, note).first().blob == blob.replace("zero", "zero\n\ntool").replace("two", "two\n\na\n\nb")
    edits = spark.createDataFrame(
        [(1, 1, -1, "minus", None), (2, 1, 3, "old", None), (3, 1, 3, "three", dt.datetime(2024, 1, 1))],
        "id long, file_id long, line int, content string, created_at timestamp_ntz",
    )
    assert an.apply_line_edits(base, edits).first().blob == blob.replace("# 0", "# -1\nminus\n# 0").replace("# 1234", "# 3\nthree\n# 1234")
