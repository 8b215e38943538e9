from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import segments as sg, translation as tr
from scriptorium.sources import cache as ca

SOURCE = (
    "int a; // あ\n"
    '\tf("い", "x"); g("う"); /* え */\n'
    'h("お") // plain\n'
    "/* か */ /* き */\n"
    "//Translated: done\n"
    'last("く")'
)
CACHE = [
    ("あ", "A"), ("い", "I"), ("う", "U"), ("え", "E"), ("お", "O"), ("か", "KA"), ("き", "KI"), ("く", "KU"),
]
EXPECTED = (
    "int a; // あ\n       //Translated: A\n"
    '\tf("い", "x"); g("う"); /* え */\n\t                     //Translated: E\n'
    '\t//Translated: "I"\n\t//Translated: "U"\n'
    'h("お") // plain\n       //Translated: "O"\n'
    "/* か */\n//Translated: KA /* き */\n"
    "//Translated: done\n"
    'last("く")\n//Translated: "KU"\n'
)


def _frames(spark, source=SOURCE, cache=CACHE):
    return (
        spark.createDataFrame([(1, "a.c", source), (2, "b.c", "int plain;")], "file_id long, path string, text string"),
        spark.createDataFrame(cache, "original string, translated string"),
    )


def test_injection(spark):
    files, cache = _frames(spark)
    found = tr.inject_translations(files, cache).collect()
    assert [(r.file_id, r.text) for r in found] == [(1, EXPECTED)]


def test_translated_comments_are_left_alone(spark):
    """What a run adds after a comment is seen by the next run."""
    source = "/* あ */\n// い\ncode();\n// う\n"
    files, cache = _frames(spark, source)
    once = tr.inject_translations(files, cache).select("file_id", "text")
    assert once.first().text == (
        "/* あ */\n//Translated: A\n// い\n//Translated: I\ncode();\n// う\n//Translated: U\n"
    )
    assert sg.translation_candidates(once).count() == 0
    assert tr.inject_translations(once, cache).count() == 0


def test_failed_and_equal_translations_are_dropped(spark):
    files, _ = _frames(spark, "// あ\n// い\n// う\n")
    cache = spark.createDataFrame(
        [("あ", "[Translation Failed]"), ("い", " い "), ("う", "")], "original string, translated string"
    )
    assert tr.inject_translations(files, cache).count() == 0


def test_candidates(spark):
    files, _ = _frames(spark)
    rows = sg.translation_candidates(files).orderBy("seq").collect()
    assert [r.text for r in rows] == ["あ", "い", "う", "え", "お", "か", "く"]  # き is followed by its translation


def test_loop(spark):
    """Detect, look up, translate the misses, append, write back."""
    files = spark.createDataFrame(
        [(1, "a.txt", "あ い。\nう\nう"), (2, "b.c", "/* う */ x; // う\n"), (3, "c.txt", "none")],
        "file_id long, path string, text string",
    )
    items = sg.detected_items(files, strategy="line")
    cache = spark.createDataFrame([("あ い。", "a i")], "original string, translated string")
    asked = tr.cache_misses(items, cache)
    assert [r.text for r in asked.collect()] == ["う"]
    added = tr.translate(asked, lambda texts: [t.replace("う", "u") for t in texts])
    notes = tr.notes_per_line(tr.translation_writeback(items, cache.unionByName(added.drop("error"))))
    assert {(r.file_id, r.line): r.note for r in notes.collect()} == {
        (1, 1): "Translated: a i", (1, 2): "Translated: u", (1, 3): "Translated: u", (2, 1): "Translated: u\nTranslated: u",
    }


def test_batches_hold_at_most_a_chunk(spark):
    texts = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("text"))
    batches = tr.translation_batches(texts)
    assert batches.groupBy("batch").count().agg(F.min("count"), F.max("count"), F.sum("count")).first()[:] == (20, 20, 3000)
    rows = batches.orderBy("batch", "position").collect()
    assert [r.text for r in rows] == sorted(f"t{n}" for n in range(3000))
    assert tr.translation_batches(texts.limit(0)).count() == 0
    sizes = []
    tr.translate(texts.coalesce(1), lambda part: sizes.append(len(part)) or part).count()


def test_failing_translator(spark):
    """A list that fails, or is answered in another length, is tried text by text; failures stay misses."""
    def translator(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [] if "odd" in texts else [t.upper() for t in texts if t != "gone"]

    texts = spark.createDataFrame([("a",), ("bad",), ("b",), ("odd",), ("c",), ("gone",)], "text string").coalesce(1)
    done = tr.translate(texts, translator, chunk=2)
    assert {r.original: (r.translated, r.error) for r in done.collect()} == {
        "a": ("A", None), "b": ("B", None), "c": ("C", None), "bad": (None, "RuntimeError: down"),
        "odd": (None, "ValueError: 0 answers to 1 text"), "gone": (None, "ValueError: 0 answers to 1 text"),
    }
    empty = spark.createDataFrame([], "original string, translated string")
    assert ca.unseen(done, empty).count() == 3


def test_cache_join_has_exchanges_of_its_own(spark):
    """Else AQE could not split the partition of a hot text."""
    items = spark.range(1000).select((F.col("id") % 3).cast("string").alias("text"), "id")
    cache = spark.range(1000).selectExpr("CAST(id AS string) AS original", "'t' AS translated")
    with_hint = tr.cache_lookup(items.hint("merge"), cache)
    plan = with_hint._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(text_key") == 2


def test_hot_text_keeps_every_place(spark):
    """A third of all items are one licence line."""
    files = spark.range(3000).select(
        F.col("id").alias("file_id"),
        F.concat(F.lit("f"), "id", F.lit(".txt")).alias("path"),
        F.when(F.col("id") % 3 == 0, "許").otherwise(F.concat(F.lit("字"), "id")).alias("text"),
    )
    items = sg.detected_items(files)
    # Appended once per place, as concurrent runs might.
    cache = items.select(F.col("text").alias("original"), F.lit("t").alias("translated"))
    assert tr.cache_lookup(items, cache).filter("translated = 't'").count() == 3000


def test_other_scripts(spark):
    files = spark.createDataFrame([(1, "a.txt", "café\nnone")], "file_id long, path string, text string")
    assert [r.text for r in sg.line_segments(files, tx.ACCENTED_LATIN).collect()] == ["café"]


def test_indentation_of_pieces(spark):
    """The line up to a comment, with all but tabs as spaces, as it is found from numbered lines."""
    import random

    rng = random.Random(7)
    parts = ["a", "\n", "\t", " ", "/* x */", "/* x\n y */", "// z\n", '"s"', '"s\nt"', "'c'", "\r\n", "/", "あ"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(300)]
    files = spark.createDataFrame(rows, "file_id long, text string")
    cut = sg.pieces_of(files, "\\x00-\\uffff").where("pieces IS NOT NULL")
    found = cut.select("file_id", F.posexplode(sg._indented(F.col("pieces"))).alias("seq", "s")).select("file_id", "seq", "s.type", "s.raw", "s.indentation")
    got = sorted(map(tuple, found.where("type <> 'code'").collect()))
    assert got == sorted((r.file_id, r.seq, r.type, r.raw, r.indentation) for r in sg.placed_segments(files).collect()) and len(got) > 500
