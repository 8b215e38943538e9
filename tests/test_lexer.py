"""The regular expressions against a character-by-character scan of random texts."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import lexer as lx, text as tx
from scriptorium.operators import segments as sg


def scan(text, char_literals):
    """Pieces as (type, raw, start)."""
    pieces, at, end = [], 0, len(text)

    def code(raw, start):
        if pieces and pieces[-1][0] == lx.CODE:
            pieces[-1] = (lx.CODE, pieces[-1][1] + raw, pieces[-1][2])
        else:
            pieces.append((lx.CODE, raw, start))

    while at < end:
        start, here = at, text[at]
        if here == '"' or (here == "'" and char_literals):
            at += 1
            while at < end and text[at] != here:
                at += 2 if text[at] == "\\" else 1
            at = min(at + 1, end)
            if here == '"':
                pieces.append((lx.STRING, text[start:at], start))
            else:
                code(text[start:at], start)
        elif text.startswith("//", at):
            at = text.find("\n", at)
            at = end if at < 0 else at
            pieces.append((lx.SINGLE, text[start:at], start))
        elif text.startswith("/*", at):
            at = text.find("*/", at + 2)
            at = end if at < 0 else at + 2
            pieces.append((lx.BLOCK, text[start:at], start))
        else:
            at += 1
            code(here, start)
    return pieces


def random_texts(count, seed=7):
    rng = random.Random(seed)
    alphabet = ['"', "'", "/", "*", "//", "/*", "*/", "\\", "\n", "\n", "\t", " ", "a", ":", "12:", "あ", "\\\n", "\x85", "#"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark):
    values = random_texts(3000)
    return values, spark.createDataFrame(list(enumerate(values)), "file_id long, text string").repartition(8)


@pytest.mark.parametrize("char_literals", [True, False])
def test_pieces(texts, char_literals):
    values, files = texts
    rows = files.select("file_id", lx.tokens(F.col("text"), char_literals).alias("t")).collect()
    for row in rows:
        assert row.t == [raw for _, raw, _ in scan(values[row.file_id], char_literals)]


@pytest.mark.parametrize("char_literals", [True, False])
def test_places(texts, char_literals):
    values, files = texts
    found = {}
    for row in sg.placed_segments(files, char_literals).collect():
        found.setdefault(row.file_id, []).append((row.seq, row.type, row.raw, row.line, row.indentation))
    for number, text in enumerate(values):
        expected = []
        for seq, (kind, raw, start) in enumerate(scan(text, char_literals)):
            if kind == lx.CODE:
                continue
            prefix = text[:start].rpartition("\n")[2]
            indentation = None if kind == lx.STRING else "".join("\t" if c == "\t" else " " for c in prefix)
            expected.append((seq, kind, raw, text.count("\n", 0, start) + 1, indentation))
        assert sorted(found.get(number, [])) == expected, repr(text)


def test_sentences(spark):
    rng = random.Random(3)
    parts = ["a", "b.", "c!", "。", " ", "　", "\n", "\n", "12:", "3", "?", "\x1c", "："]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    files = spark.createDataFrame(list(enumerate(values)), "file_id long, text string")
    found = {}
    for row in sg.sentence_segments(files, ranges=None).collect():
        found.setdefault(row.file_id, []).append((row.seq, row.line, row.text))
    for number, text in enumerate(values):
        expected, waiting, first = [], [], None
        for line, raw in enumerate(text.split("\n") + [""], 1):
            stripped = raw.strip()
            if stripped:
                first = first or line
                waiting.append(stripped)
            if waiting and (not stripped or stripped.endswith(tuple("。．.!?！？"))):
                expected.append((len(expected), first, " ".join(waiting)))
                waiting, first = [], None
        assert sorted(found.get(number, [])) == expected, repr(text)


def test_strip_is_unicode(spark):
    values = [" 　a ", "\x1c\x85b\xa0", "c", "", "​ d"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(tx.strip(F.col("t"))).collect()
    assert [r[0] for r in rows] == [v.strip() for v in values]


def test_unterminated_and_short_blocks(spark):
    text = "/*/ a\n// b"
    files = spark.createDataFrame([(1, text), (2, '"a\\'), (3, "x /* あ"), (4, "/**/")], "file_id long, text string")
    rows = sg.placed_segments(files).withColumn("inner", lx.inner(F.col("raw"))).collect()
    assert {r.file_id: (r.type, r.inner) for r in rows} == {
        1: (lx.BLOCK, "/ a\n// b"), 2: (lx.STRING, "a"), 3: (lx.BLOCK, "あ"), 4: (lx.BLOCK, ""),
    }


def test_very_long_pieces(spark):
    """A backtracking loop would end the JVM here."""
    literal = '"' + "x\\n" * 700_000 + '"'
    comment = "/*" + "* y\n" * 400_000 + "*/"
    code = "a/b 'c' " * 250_000
    files = spark.createDataFrame([(1, literal), (2, comment), (3, code + literal)], "file_id long, text string")
    rows = {(r.file_id, r.type): (r.n, r.line) for r in sg.placed_segments(files).select(
        "file_id", "type", F.length("raw").alias("n"), "line").collect()}
    assert rows == {(1, lx.STRING): (2_100_002, 1), (2, lx.BLOCK): (1_600_004, 1), (3, lx.STRING): (2_100_002, 1)}


def test_one_long_line(spark):
    """Many segments on one line cost no more than as many on many lines."""
    files = spark.createDataFrame([(1, '/* a\n*/' + 'f("x") ' * 100_000)], "file_id long, text string")
    assert sg.code_segments(files, ranges=None).agg(F.count("*"), F.max("line")).collect()[0] == (100_001, 2)
