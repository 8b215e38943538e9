import csv
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import paths as px
from scriptorium.operators import modernize as md, paths as po, reports as rp, tools as tl
from scriptorium.session import spread, working_dir
from scriptorium.sources import cache as ca, catalog as ct, sinks as sk, tables as tb
from scriptorium.streaming import increments as inc


@pytest.fixture
def tree(tmp_path):
    files = {"a.c": b"int", "sub/b.h": b"x\x00", "sub/deep/Makefile": b"all:", "sub/c.txt,v": b"head 1.1;", "e.S": b"y"}
    for name, content in files.items():
        path = tmp_path / "root dir" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "root dir"), files


def test_scan(spark, tree):
    root, files = tree
    found = ct.scan_files(spark, root)
    assert {r.path.replace("%20", " "): bytes(r.content) for r in found.collect()} == files
    assert {r.path for r in ct.scan_files(spark, root, "{*.c,*.h}").collect()} == {"a.c", "sub/b.h"}
    assert {r.path for r in ct.scan_files(spark, root, max_bytes=3).collect()} == {"a.c", "sub/b.h", "e.S"} - {""} - (
        {p for p, c in files.items() if len(c) > 3}
    )
    kept = ct.with_suffixes(found, px.REENCODE_SUFFIXES, px.REENCODE_NAMES)
    assert {r.path for r in kept.collect()} == {"a.c", "sub/b.h", "sub/deep/Makefile", "e.S"}


def test_unreadable_files_become_rows(spark, tree):
    root, files = tree
    listing = spark.createDataFrame(ct.scan_files(spark, root).select("path").collect())
    read = ct.scan_files(spark, root, lenient=True)
    os.remove(os.path.join(root, "sub/b.h"))
    errors = ct.unreadable(listing, read.filter("content IS NOT NULL"))
    assert [tuple(r) for r in errors.collect()] == [("sub/b.h", "cannot be read")]
    assert read.filter("content IS NOT NULL").count() == len(files) - 1


def test_listing_opens_no_file(spark, tree):
    plan = ct.catalog(ct.scan_files(spark, tree[0], max_bytes=100))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "LessThanOrEqual(length,100)" in plan


def test_too_large_files_are_told(spark, tree):
    root = tree[0]
    small, large = ct.scan_files(spark, root, max_bytes=3), ct.too_large(spark, root, 3)
    assert {r.error for r in large.collect()} <= {"too large"}
    assert small.count() + large.count() == ct.scan_files(spark, root).count()


def test_a_new_checkpoint_keeps_what_is_indexed(spark):
    """The old input is gone and the checkpoint is lost; numbering starts again, the index stays."""
    base = working_dir(spark, "restart")
    for k, names in enumerate((["a/b", "a/c"], ["c"])):
        spark.createDataFrame([(n, n) for n in names], inc.ARRIVALS).write.parquet(f"{base}/in{k}")
        stream = spark.readStream.schema(inc.ARRIVALS).parquet(f"{base}/in{k}")
        inc.index_arrivals(stream, f"{base}/out", f"{base}/checkpoint{k}").awaitTermination()
    assert sorted(r.path for r in inc.indexed(spark, f"{base}/out").collect()) == ["a/b", "a/c", "c"]


def test_rescan_adds_nothing(spark, tree):
    listing = ct.catalog(ct.scan_files(spark, tree[0]))
    assert ct.new_files(listing, listing.filter("path = 'a.c'")).count() == 4
    assert ct.new_files(listing, listing).count() == 0


def _short(path, attempt):
    """Ids of one hex digit, so that most paths collide."""
    return F.conv(F.substring(F.md5(F.concat(path, F.lit(str(attempt)))), 1, 1), 16, 10).cast("long")


@pytest.mark.parametrize("wish", [ct.path_id, _short])
def test_ids_stay_over_runs_and_collisions(spark, wish):
    paths = lambda names: spark.createDataFrame([(n, n) for n in names], "path string, filename string")
    none = spark.createDataFrame([], "file_id long, path string")
    first = ct.with_ids(paths([f"a/{n}" for n in range(6)]), none, wish)
    one = {r.path: r.file_id for r in first.collect()}
    assert one == {r.path: r.file_id for r in ct.with_ids(paths([f"a/{n}" for n in reversed(range(6))]), none, wish).collect()}
    listing = paths([f"a/{n}" for n in range(6)] + [f"b/{n}" for n in range(7)])
    second = ct.with_ids(ct.new_files(listing, first), first, wish)
    index = first.unionByName(second)
    ids = {r.path: r.file_id for r in index.collect()}
    assert len(ids) == len(set(ids.values())) == 13 and one.items() <= ids.items()
    assert ct.new_files(listing, index).count() == 0
    # Ids are found again from the paths and the collisions alone.
    moved = ct.collisions(index, wish)
    assert (moved.count() > 0) == (wish is _short)
    assert {r.path: r.file_id for r in ct.ids_of(listing, moved, wish).collect()} == ids


def test_suffix_rule(spark):
    names = {"a.c": ".c", "a.C": ".c", ".bashrc": "(no extension)", "d.x/name": "(no extension)", "a.": "(no extension)",
             "a.tar.gz": ".gz", "x/.a.b": ".b", "..a": ".a", "": "(no extension)", "f.c,v": ".c,v"}
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", px.extension(F.col("path")).alias("e"))
    assert {r.path: r.e for r in rows.collect()} == names


def test_cache_csv(spark, tmp_path):
    """As another tool writes it: CRLF row ends, quotes, newlines, short rows, a repeated key."""
    folder = tmp_path / "cache"
    folder.mkdir()
    rows = [["a", "first"], ["short"], ['q"uote', "x,y"], ["two\nlines", "2\nlines"], ["a", "last"]]
    with open(folder / "cache.csv", "w", newline="", encoding="utf-8") as file:
        csv.writer(file).writerows(rows)
    loaded = ca.load_cache_csv(spark, str(folder))
    assert {r.original: r.translated for r in loaded.collect()} == {
        "a": "last", 'q"uote': "x,y", "two\nlines": "2\nlines",
    }
    fresh = spark.createDataFrame([("a", "again"), ("n", "1"), ("n", "2")], tb.CACHE)
    ca.append_cache_csv(ca.unseen(fresh, loaded), str(folder))
    assert {r.original: r.translated for r in ca.load_cache_csv(spark, str(folder)).collect()}["n"] == "1"
    assert ca.load_cache_csv(spark, str(folder)).count() == 4
    failed = spark.createDataFrame([("x", "[Translation Failed]"), ("y", "[Trans Fail: down]"), ("z", "Z")], tb.CACHE)
    assert [r.original for r in ca.unseen(failed, loaded).collect()] == ["z"]


def test_versions_replace_themselves(spark):
    location = working_dir(spark, "versions")
    files = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, text string")
    sk.write_version(files, location, 1)
    for _ in range(2):
        sk.write_version(files.filter("path = 'a'").withColumn("text", F.lit("2")), location, 2)
    assert sorted(map(tuple, sk.latest_version(sk.read_versions(spark, location)).collect())) == [("a", 2, "2"), ("b", 1, "1")]
    assert sk.read_versions(spark, location).count() == 3


def test_tables_are_made_once(spark):
    location = working_dir(spark, "tables")
    tb.create_if_missing(spark, location, tb.CACHE)
    tb.append(spark.createDataFrame([("a", "b")], tb.CACHE), location, tb.CACHE)
    tb.create_if_missing(spark, location, tb.CACHE)
    assert tb.read_table(spark, location, tb.CACHE).count() == 1


def test_working_dir_is_shared():
    """The folder the cluster names is used; without one only a local session goes on."""
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert working_dir(session("/shared/checkpoints", "yarn"), "x").startswith("/shared/checkpoints/x-")
    with pytest.raises(ValueError):
        working_dir(session(None, "yarn"), "x")
    assert os.path.dirname(working_dir(session(None, "local[2]"), "x")) != "/shared/checkpoints"


def test_replayed_batches(spark):
    base = working_dir(spark, "stream")
    listing = spark.createDataFrame([("a/b", "b"), ("c", "c")], "path string, filename string")
    for _ in range(2):
        listing.write.mode("append").parquet(f"{base}/in")
    source = lambda: spark.readStream.schema(inc.ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    inc.index_arrivals(source(), f"{base}/out", f"{base}/one").awaitTermination()
    first = sorted(map(tuple, inc.indexed(spark, f"{base}/out").collect()))
    # A lost checkpoint replays every batch from the start.
    inc.index_arrivals(source(), f"{base}/out", f"{base}/two").awaitTermination()
    assert first == sorted(map(tuple, inc.indexed(spark, f"{base}/out").collect())) == [("a/b", "b"), ("c", "c")]


def test_a_thousand_batches_leave_few_folders(spark):
    """Merging by the same rule without Spark: what counts always covers every batch once."""
    spans = []
    for batch in range(1000):
        while part := inc.due(spans):
            spans = inc.live([*spans, (part[0][0], part[-1][1])])
        spans.append((batch, batch))
        covered = [b for low, high in inc.live(spans) for b in range(low, high + 1)]
        assert covered == list(range(batch + 1))
    assert len(inc.live(spans)) <= 3 * inc.SPAN


def test_merged_folders_replace_batches(spark, monkeypatch):
    monkeypatch.setattr(inc, "SPAN", 3)
    base = working_dir(spark, "merged")
    names = [f"d/{n % 12}" for n in range(14)]
    for name in names:
        spark.createDataFrame([(name, name), (name, None)], inc.ARRIVALS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = lambda: spark.readStream.schema(inc.ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    inc.index_arrivals(source(), f"{base}/out", f"{base}/one").awaitTermination()
    folder = inc._Folder(spark, f"{base}/out")
    run, = folder.runs()
    spans = folder.spans(run)
    assert spans and len(spans) < 14 and max(high - low for low, high in spans) >= 8
    files = [n for s in inc.live(spans) for n in folder.names(folder.at(run, *s)) if n.endswith(".parquet")]
    assert len([n for n in files]) <= 14
    expected = sorted({(n, n) for n in names})
    assert sorted(map(tuple, inc.indexed(spark, f"{base}/out").collect())) == expected
    # A folder that was written but not renamed, or not finished, is not read.
    spark.createDataFrame([("x", "x")], inc.ARRIVALS).write.parquet(f"{base}/out/_merging-{run}-0-99")
    os.makedirs(f"{base}/out/run={run}/span=0-50".replace("file:", ""), exist_ok=True)
    assert sorted(map(tuple, inc.indexed(spark, f"{base}/out").collect())) == expected
    # Another run adds only what is new, although its state starts empty.
    spark.createDataFrame([("d/1", "d/1"), ("late", "late")], inc.ARRIVALS).write.mode("append").parquet(f"{base}/in")
    inc.index_arrivals(source(), f"{base}/out", f"{base}/two").awaitTermination()
    assert sorted(map(tuple, inc.indexed(spark, f"{base}/out").collect())) == sorted([*expected, ("late", "late")])
    inc.index_arrivals(source(), f"{base}/out", f"{base}/two").awaitTermination()
    assert inc.indexed(spark, f"{base}/out").count() == 13


def test_a_batch_reads_only_its_own_rows(spark):
    base = working_dir(spark, "plan")
    for k in range(2):
        spark.range(k * 50, k * 50 + 50).selectExpr("concat('p', id) AS path", "concat('p', id) AS filename").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(inc.ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = inc.index_arrivals(stream, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert read == [50, 50] and inc.indexed(spark, f"{base}/out").count() == 100


def test_newest_rows_survive_merging(spark, monkeypatch):
    monkeypatch.setattr(inc, "SPAN", 2)
    base = working_dir(spark, "newest")
    log = spark.range(60).selectExpr(
        "id", "id % 4 AS file_id", "IF(id % 3 = 0, 0, 5) AS line_number", "concat('c', id) AS content", "'a' AS author", "'manual' AS type",
        "CAST(timestamp_seconds((id * 7) % 20) AS timestamp_ntz) AS created_at",
    )
    for k in range(6):
        log.filter(f"id % 6 = {k}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    inc.follow_annotations(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    expected = sorted(map(tuple, inc._newest(log.filter("line_number = 0")).collect()))
    assert sorted(map(tuple, inc.followed(spark, f"{base}/out").collect())) == expected and len(expected) == 4


def test_files_arrive(spark, tree):
    """Files on disk are indexed as they appear, once each, over restarts."""
    root, files = tree
    base = working_dir(spark, "watch")

    def run():
        inc.index_arrivals(inc.watch_files(spark, root, 2), f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return sorted(r.path for r in inc.indexed(spark, f"{base}/out").collect())

    assert run() == sorted(files)
    with open(os.path.join(root, "late.c"), "w") as file:
        file.write("x")
    assert run() == sorted([*files, "late.c"])


def test_resolution(spark):
    files = spark.createDataFrame(
        [(1, "x/dir/a.c"), (2, "dir/a.c"), (3, "mydir/a.c"), (4, "w\\a.c"), (5, "a.c")], "file_id long, path string"
    )
    asked = spark.createDataFrame([(r,) for r in ("dir/a.c", "dir\\a.c", "ir/a.c", "a.c", "w/a.c", "w\\a.c", "no", "/a.c")], "request string")
    found = lambda **k: {r.request: r.file_id for r in po.resolve_path(asked, files, **k).collect()}
    assert found() == {"dir/a.c": 2, "dir\\a.c": 1, "ir/a.c": None, "a.c": 5, "w/a.c": 4, "w\\a.c": 4, "no": None, "/a.c": 1}
    assert found(anchored=False) == {"dir/a.c": 2, "dir\\a.c": 1, "ir/a.c": 1, "a.c": 5, "w/a.c": 4, "w\\a.c": 4, "no": None, "/a.c": 1}


def test_hot_name_builds_no_pairs(spark):
    """A third of the files and of the requests share one name."""
    name = F.when(F.col("id") % 3 == 0, "Makefile").otherwise(F.concat(F.lit("f"), "id"))
    files = spark.range(30_000).select(F.col("id").alias("file_id"), F.concat(F.lit("d"), "id", F.lit("/"), name).alias("path"))
    found = po.resolve_path(files.select(F.col("path").alias("request")), files)
    assert found.filter("path = request").count() == 30_000


def test_only_asked_endings_are_made(spark):
    """Long paths, few requests: as many endings as requests can meet, and the files of one name in many tasks."""
    files = spark.range(8000).select(F.col("id").alias("file_id"), F.concat(F.repeat(F.lit("dir/"), 40), "id", F.lit("/Makefile")).alias("path"))
    requests = spark.createDataFrame([("5/Makefile",), ("r/77/Makefile",), ("none",)], "request string")
    for anchored in (True, False):
        wanted = po._asked_endings(requests, anchored)
        made = po.endings(files.hint("merge"), wanted, anchored)
        assert made.groupBy("file_id").count().agg(F.max("count")).first()[0] <= 2
        assert made.select(F.length("key")).distinct().count() <= 2
        tasks = made.select(F.pmod(F.xxhash64("path"), F.lit(po.NAME_SALTS)).alias("salt")).groupBy("salt").count().collect()
        assert len(tasks) == po.NAME_SALTS and max(r["count"] for r in tasks) <= 2 * min(r["count"] for r in tasks)
    found = {r.request: r.file_id for r in po.resolve_path(requests, files, anchored=False).collect()}
    assert found == {"5/Makefile": 5, "r/77/Makefile": 77, "none": None}


def test_tree_and_listing(spark):
    tree = po.path_tree(spark.createDataFrame([("b/x",), ("B.c",), ("a/y/z",), ("c",)], "path string"))
    top = [r.name for r in po.dir_listing(tree).collect() if r.parent == ""]
    assert top == ["a", "b", "B.c", "c"]


def test_head_revision(spark):
    text = "1.2\nlog\n@x@ text\n@@\n"
    quoted = text.replace("@", "@@")
    archive = f"head 1.10;\naccess;\n\n1.10\ndate;\n\ndesc\n@{quoted}@\n\n\n1.10\nlog\n@l@\ntext\n@{quoted}@\n\n1.1\nlog\n@@\ntext\n@old@\n"
    rows = md.head_text(spark.createDataFrame([(1, archive), (2, "not one")], "file_id long, text string")).collect()
    assert {r.file_id: (r.head, r.head_text) for r in rows} == {1: ("1.10", text), 2: ("", None)}


def test_tools(spark):
    rows = tl.tools_available(spark.createDataFrame([(1, "A.C"), (2, "b.py")], "file_id long, path string")).collect()
    assert {r.file_id for r in rows if r.tool == "format_code"} == {1} and len(rows) == 11


def test_top_k_ties(spark):
    counts = spark.createDataFrame([(f"k{n:02}", 1 + (n == 7)) for n in range(30)], "key string, files long")
    assert [r.key for r in rp.top_k(counts, "key", 3).collect()] == ["k07", "k00", "k01"]
    assert "TakeOrderedAndProject" in rp.top_k(counts, "key")._jdf.queryExecution().executedPlan().toString()


def test_spread_leaves_large_inputs(spark):
    many, few = spark.range(0, 100, 1, 64), spark.range(0, 100, 1, 2)
    assert spread(many, "id") is many
    assert spread(few, "id").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_seen_paths_are_an_aggregate_in_the_jvm(spark):
    """A path is indexed in the first batch that holds it, with the least of its names there; no row goes to Python."""
    base = working_dir(spark, "aggregate")
    batches = [[("a", "z"), ("a", None), ("a", "b"), (None, "n")], [("a", "a"), ("c", None), (None, "m")], [("c", "c"), ("d", "d")]]
    for rows in batches:
        spark.createDataFrame(rows, inc.ARRIVALS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(inc.ARRIVALS).parquet(f"{base}/in")
        query = inc.index_arrivals(stream, f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
    got = [tuple(r) for r in inc.indexed(spark, f"{base}/out").collect()]
    assert sorted(got, key=str) == sorted([("a", "b"), (None, "n"), ("c", None), ("d", "d")], key=str)
    assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["stateStoreSave"]
