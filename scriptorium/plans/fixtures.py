"""Input views over the sample tables, for Spark and, row for row the same, as SQL.

The sample tables hold no source code, no Japanese and no legacy bytes.  The views
turn every document into such a file by fixed replacements, so inputs grow with the
tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.session import spread

# Extension by file number modulo 8.
EXTENSIONS = (".c", ".h", ".cpp", ".txt", ".c,v", ".PY", "", ".jp")

# Text replacements that make prose look like commented source.
CODE_MARKS = (
    (" of ", " /* of "),
    (" and ", " and */ "),
    (" the ", ' "the é\\" " '),
    (" is ", " // is è\n\t "),
    (" to ", " 'to' "),
    (" this ", " // ñthis\n  //TRANSLATED: this\n"),
    (" that ", " /* éthat\nèthat\n*/ /* k */ "),
    (" de ", ' "de é" '),
    (" la ", " // la\n"),
    (" der ", " /* der ö */ "),
    (" die ", " 'd\\'\"e' "),
)
# Accented letters to kana, kanji, ideographic space and sentence ends.
LATIN_LETTERS = "éèêçñóíüäöß"
SCRIPT_LETTERS = "あ漢カーえお　ゐ字。！"

# Letters written in a double-byte encoding: the n-th becomes the n-th hiragana.
UPPER_ACCENTS, UPPER_PLAIN = "ÉÈÊÇÑÓÍÜÄÖ", "EEECNOIUAO"
KANA_LETTERS = "éèêçñóíüäößqwkzjx"
HIRAGANA = "".join(chr(0x3041 + n) for n in range(len(KANA_LETTERS)))
SJIS_TRAILS = "".join(chr(0x9F + n) for n in range(len(KANA_LETTERS)))
EUC_TRAILS = "".join(chr(0xA1 + n) for n in range(len(KANA_LETTERS)))
LATIN1_UPPER = "".join(map(chr, range(0xC0, 0x100)))
UTF8_TRAILS = "".join(map(chr, range(0x80, 0xC0)))

# First bytes of the binary files, by (file number div 64) modulo 8.
MAGIC = (
    "\x7fELF", "\x89PNG\r\n\x1a\n", "GIF89a", "GIF87a", "\xff\xd8\xff\xe0", "PK\x03\x04", "\x1f\x8b\x08", "%PDF-1.4",
)
CHUNKS = ("\x00\x00\x00\x0eTEXT\x00\x00\x00\xb0", "\x00TEXT\x01\x02\x03\x04", "\x00TEX")

# Ends of some files: a circled one and the sign of a stock company in Windows-31J, bytes no encoding takes, a Western letter.
WINDOWS_SIGNS, NOISE, WESTERN = "\x87\x40\x87\x8a", "\x81\xad\xfd\x80", " \xe9 !"

ARCHIVE_ID_BASE = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(value: str) -> str:
    """SQL literal of any string, NUL included."""
    parts = ["'" + part.replace("'", "''") + "'" for part in value.split("\x00")]
    return "(" + "||chr(0)||".join(parts) + ")"


# -- source files -------------------------------------------------------------


def _path() -> Column:
    end = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    number = F.floor(F.col("doc_id") / 2).cast("string")
    return F.concat("source", F.lit("/"), "lang", F.lit("/f"), number, end)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, path, text``."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), _path().alias("path"), "text")


def _replaced(text: Column, pairs) -> Column:
    # Byte search is several times as fast as ``translate`` over long texts.
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Line breaks by file number modulo 7: Windows, old Macintosh, mixed; the others have plain ones.
def _broken(text: Column) -> Column:
    shape = F.col("file_id") % 7
    mixed = F.replace(F.replace(text, F.lit("e\n"), F.lit("e\r\n")), F.lit(".\n"), F.lit(".\r"))
    return (
        F.when(shape == 3, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(shape == 4, F.replace(text, F.lit("\n"), F.lit("\r")))
        .when(shape == 5, mixed).otherwise(text)
    )


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as commented, partly Japanese source with all kinds of line breaks: ``file_id, path, text``."""
    text = _broken(_replaced(F.col("text"), (*CODE_MARKS, *zip(LATIN_LETTERS, SCRIPT_LETTERS))))
    return src_files(spark, sf_dir).select("file_id", "path", text.alias("text"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, an archive beside each even one, and an archive in ``old/`` for each odd one."""
    files = src_files(spark, sf_dir)
    even = F.col("file_id") % 2 == 0
    return files.unionByName(
        files.select(
            (F.col("file_id") + ARCHIVE_ID_BASE).alias("file_id"),
            F.concat(F.when(even, "").otherwise("old/"), "path", F.lit(",v")).alias("path"),
            "text",
        )
    )


_CASES = " ".join(f"WHEN {n} THEN {quoted(e)}" for n, e in enumerate(EXTENSIONS))
SQL = {
    "src_files": (
        (),
        f"""SELECT doc_id AS file_id,
       source || '/' || lang || '/f' || (doc_id // 2) || CASE doc_id % 8 {_CASES} END AS path, text
FROM documents""",
    ),
    "tree_files": (
        ("src_files",),
        f"""SELECT file_id, path, text FROM src_files
UNION ALL
SELECT file_id + {ARCHIVE_ID_BASE}, CASE WHEN file_id % 2 = 0 THEN '' ELSE 'old/' END || path || ',v', text
FROM src_files""",
    ),
}


def _nested_replace(column: str) -> str:
    for old, new in CODE_MARKS:
        column = f"replace({column}, {quoted(old)}, {quoted(new)})"
    return column


SQL["marked_files"] = (
    ("src_files",),
    f"""SELECT file_id, path, CASE file_id % 7 WHEN 3 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 4 THEN replace(text, chr(10), chr(13))
       WHEN 5 THEN replace(replace(text, 'e' || chr(10), 'e' || chr(13) || chr(10)), '.' || chr(10), '.' || chr(13)) ELSE text END AS text
FROM (SELECT file_id, path,
       translate({_nested_replace("text")}, {quoted(LATIN_LETTERS)}, {quoted(SCRIPT_LETTERS)}) AS text
FROM src_files)""",
)
# As every operator reads them, and the break each is written back with.
SQL["read_files"] = (
    ("marked_files",),
    r"""SELECT file_id, path, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text,
       CASE WHEN regexp_matches(text, '[\r\n]') THEN regexp_extract(text, '\r\n|\r|\n') ELSE chr(10) END AS style
FROM marked_files""",
)

# -- raw bytes ----------------------------------------------------------------


def archive_of(text: Column) -> Column:
    """Two-revision archive whose head is ``text``."""
    return F.concat(F.lit(_ARCHIVE_HEAD), F.replace(text, F.lit("@"), F.lit("@@")), F.lit(_ARCHIVE_TAIL))


_ARCHIVE_HEAD = (
    "head\t1.2;\naccess;\nsymbols;\nlocks; strict;\ncomment\t@ * @;\n\n\n"
    "1.2\ndate\t99.01.02.03.04.05;\tauthor a;\tstate Exp;\nbranches;\nnext\t1.1;\n\n"
    "1.1\ndate\t98.01.02.03.04.05;\tauthor a;\tstate Exp;\nbranches;\nnext\t;\n\n\n"
    "desc\n@text\n@@1.2\nlog\n@@x@@ text\n@\n\n\n1.2\nlog\n@second\n@\ntext\n@"
)
_ARCHIVE_TAIL = "@\n\n\n1.1\nlog\n@first\n@\ntext\n@d1 1\na1 1\nold\n@\n"


def _double_byte(text: Column, lead: str, trails: str) -> Column:
    return _replaced(text, [(letter, lead + trail) for letter, trail in zip(KANA_LETTERS, trails)])


def _kind() -> Column:
    return F.floor(F.col("file_id") / 8) % 8


def _variant() -> Column:
    return F.floor(F.col("file_id") / 64) % 8


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight kinds of bytes: ``file_id, path, content, length``.

    ASCII, Shift-JIS, EUC-JP, UTF-8, binary with a signature, NUL at the very end,
    a lone lead byte at the end, and a chunked word processor file.  Some of the first kind end
    in Windows-31J signs, in noise, or in a Western letter.
    """
    files = src_files(spark, sf_dir)
    base = _replaced(F.col("text"), zip(UPPER_ACCENTS, UPPER_PLAIN))
    sjis = _double_byte(base, "\x82", SJIS_TRAILS)
    ascii_ = F.regexp_replace(base, r"[^\x00-\x7f]", "?")
    magic = F.element_at(F.array(*[F.lit(m) for m in MAGIC]), (_variant() + 1).cast("int"))
    chunk = F.element_at(F.array(*[F.lit(c) for c in CHUNKS]), (_variant() % 4 + 1).cast("int"))
    raw = (
        F.when((_kind() == 0) & (_variant() == 1), F.concat(ascii_, F.lit(WINDOWS_SIGNS)))
        .when((_kind() == 0) & (_variant() == 2), F.concat(ascii_, F.lit(NOISE)))
        .when((_kind() == 0) & (_variant() == 3), F.concat(ascii_, F.lit(WESTERN)))
        .when(_kind() == 0, ascii_)
        .when(_kind() == 1, sjis)
        .when(_kind() == 2, _double_byte(base, "\xa4", EUC_TRAILS))
        .when(_kind() == 4, F.concat(magic, F.lit("\x00"), sjis))
        .when(_kind() == 5, F.concat(ascii_, F.lit("\x00")))
        .when(_kind() == 6, F.concat(sjis, F.lit("\x82")))
        .when(_variant() % 4 == 3, F.concat(sjis, F.lit("TEXT\x00\x00")))
        .otherwise(F.concat(chunk, sjis))
    )
    content = F.when(_kind() == 3, F.encode("text", "UTF-8")).otherwise(F.encode(raw, "ISO-8859-1"))
    return files.select("file_id", "path", content.alias("content")).withColumn(
        "length", F.octet_length("content").cast("long")
    )


def _sql_double_byte(column: str, lead: str, trails: str) -> str:
    return (
        f"translate(regexp_replace({column}, '([{KANA_LETTERS}])', {quoted(lead)} || '\\1', 'g'), "
        f"{quoted(KANA_LETTERS)}, {quoted(trails)})"
    )


def _sql_cases(values: tuple[str, ...], selector: str) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {n} THEN {quoted(v)}" for n, v in enumerate(values)) + " END"


SQL["legacy_base"] = (
    ("src_files",),
    rf"""SELECT file_id, path, text, (file_id // 8) % 8 AS kind, (file_id // 64) % 8 AS variant,
       regexp_replace(base, '[^\x00-\x7f]', '?', 'g') AS ascii_text,
       {_sql_double_byte("base", chr(0x82), SJIS_TRAILS)} AS sjis,
       {_sql_double_byte("base", chr(0xA4), EUC_TRAILS)} AS euc,
       translate(base, {quoted(KANA_LETTERS)}, {quoted(HIRAGANA)}) AS kana, regexp_matches(base, '[{KANA_LETTERS}]') AS foreign_letters
FROM (SELECT *, translate(text, {quoted(UPPER_ACCENTS)}, {quoted(UPPER_PLAIN)}) AS base FROM src_files)""",
)
# raw: one character per byte; kind 3 spells out the UTF-8 bytes.
# label: what each kind has to be taken for, UTF-8 first; hiragana in EUC-JP reads as half-width kana in Shift-JIS.
SQL["legacy_files"] = (
    ("legacy_base",),
    rf"""SELECT file_id, path, kind, variant, text, kana, ascii_text, CASE kind
       WHEN 0 THEN CASE variant WHEN 1 THEN 'Windows-31J' WHEN 2 THEN 'unknown' WHEN 3 THEN 'ISO-8859-1' ELSE 'ASCII' END
       WHEN 3 THEN CASE WHEN regexp_matches(text, '[À-ÿ]') THEN 'UTF-8' ELSE 'ASCII' END
       WHEN 4 THEN CASE WHEN variant IN (4, 6) THEN 'unknown' WHEN variant = 1 OR foreign_letters THEN 'Shift-JIS' ELSE 'ASCII' END
       WHEN 5 THEN 'ASCII' WHEN 6 THEN 'unknown'
       WHEN 7 THEN CASE WHEN foreign_letters OR variant % 4 = 0 THEN 'Shift-JIS' ELSE 'ASCII' END
       ELSE CASE WHEN foreign_letters THEN 'Shift-JIS' ELSE 'ASCII' END END AS label, CASE kind
       WHEN 0 THEN ascii_text || CASE variant WHEN 1 THEN {quoted(WINDOWS_SIGNS)} WHEN 2 THEN {quoted(NOISE)} WHEN 3 THEN {quoted(WESTERN)} ELSE '' END
       WHEN 1 THEN sjis WHEN 2 THEN euc
       WHEN 3 THEN regexp_replace(translate(text, {quoted(LATIN1_UPPER)}, {quoted(UTF8_TRAILS)}),
                                  '([\x{{80}}-\x{{bf}}])', {quoted(chr(0xC3))} || '\1', 'g')
       WHEN 4 THEN {_sql_cases(MAGIC, "variant")} || chr(0) || sjis
       WHEN 5 THEN ascii_text || chr(0)
       WHEN 6 THEN sjis || {quoted(chr(0x82))}
       WHEN 7 THEN CASE WHEN variant % 4 = 3 THEN sjis || {quoted("TEXT" + chr(0) * 2)}
                        ELSE {_sql_cases(CHUNKS, "variant % 4")} || sjis END END AS raw
FROM legacy_base""",
)


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as an archive: ``file_id, path, text``."""
    return src_files(spark, sf_dir).select(
        "file_id", F.concat("path", F.lit(",v")).alias("path"), archive_of(F.col("text")).alias("text")
    )


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy files, each with an archive beside it or alone in ``old/``: ``file_id, path, content``."""
    files = legacy_files(spark, sf_dir).select("file_id", "path", "content")
    even = F.col("file_id") % 2 == 0
    archived = archive_of(F.decode("content", "ISO-8859-1"))
    return files.unionByName(
        files.select(
            (F.col("file_id") + ARCHIVE_ID_BASE).alias("file_id"),
            F.concat(F.when(even, "").otherwise("old/"), "path", F.lit(",v")).alias("path"),
            F.encode(archived, "ISO-8859-1").alias("content"),
        )
    )


# -- annotations --------------------------------------------------------------


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as annotation log."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("file_id"),
        F.get_json_object("props", "$.k").cast("int").alias("line_number"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("content"),
        F.lit(None).cast("string").alias("author"),
        F.when(F.col("event_type") == "view", "auto_translate").otherwise("manual").alias("type"),
        F.col("ts").alias("created_at"),
    )


SQL["annotations"] = (
    (),
    """SELECT event_id AS id, user_id AS file_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS line_number,
       event_type || ' ' || event_id AS content, CAST(NULL AS VARCHAR) AS author,
       CASE WHEN event_type = 'view' THEN 'auto_translate' ELSE 'manual' END AS type, ts AS created_at
FROM events""",
)


def line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as edits: ``id, file_id, line, content, created_at``; errors blank a line."""
    return annotations(spark, sf_dir).select(
        "id",
        "file_id",
        F.col("line_number").alias("line"),
        F.when(F.col("line_number") == 0, F.concat(F.lit("reset "), "id", F.lit("\n@lines\n# 5\nfive")))
        .when(F.col("content").startswith("error"), " 　")
        .otherwise(F.col("content"))
        .alias("content"),
        "created_at",
    )


SQL["line_edits"] = (
    ("annotations",),
    """SELECT id, file_id, line_number AS line, CASE
         WHEN line_number = 0 THEN 'reset ' || id || chr(10) || '@lines' || chr(10) || '# 5' || chr(10) || 'five'
         WHEN content LIKE 'error%' THEN ' ' || chr(12288) ELSE content END AS content, created_at
FROM annotations""",
)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as annotation blob, one note per line, in five shapes: ``file_id, blob``."""
    numbered = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.concat(F.lit("# "), (i + 1).cast("string"), F.lit("\n"), line, F.lit("\n")),
        ),
        "",
    )
    head = F.concat(F.lit("note "), F.col("doc_id").cast("string"), F.lit("\n\n@lines\n"))
    shape = F.col("doc_id") % 5
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("file_id"),
        F.when(shape == 0, F.concat(head, F.lit("# 0\nzero\n"), numbered))
        .when(shape == 1, F.concat(head, numbered, F.lit("# 1\nlast one counts\n#2x\n# 12345678901\nfar\n# 3\n 　\n@lines\n")))
        .when(shape == 2, F.col("text"))
        .when(shape == 3, F.concat(F.lit("  @lines # 7 not a heading\n#9\n"), "text"))
        .otherwise("")
        .alias("blob"),
    )


SQL["blobs"] = (
    (),
    """SELECT doc_id AS file_id, CASE doc_id % 5
         WHEN 0 THEN head || '# 0' || chr(10) || 'zero' || chr(10) || numbered
         WHEN 1 THEN head || numbered || '# 1' || chr(10) || 'last one counts' || chr(10) || '#2x' || chr(10)
                     || '# 12345678901' || chr(10) || 'far' || chr(10) || '# 3' || chr(10) || ' ' || chr(12288) || chr(10) || '@lines' || chr(10)
         WHEN 2 THEN text
         WHEN 3 THEN '  @lines # 7 not a heading' || chr(10) || '#9' || chr(10) || text
         ELSE '' END AS blob
FROM (SELECT *, 'note ' || doc_id || chr(10) || chr(10) || '@lines' || chr(10) AS head,
             array_to_string(list_transform(string_split(text, chr(10)),
                 lambda line, i: '# ' || i || chr(10) || line || chr(10)), '') AS numbered
      FROM documents)""",
)


# -- translation --------------------------------------------------------------


def translation_cache(texts: DataFrame) -> DataFrame:
    """A stand-in cache: texts that do not end like a sentence, in capitals; those with "tion" have failed."""
    text = F.col("text")
    return texts.filter(~text.endswith(".")).select(
        text.alias("original"),
        F.when(text.contains("tion"), F.concat(F.lit("[Trans Fail: "), text, F.lit("]")))
        .otherwise(F.upper(text))
        .alias("translated"),
    ).distinct()


def cache_sql(source: str) -> str:
    """The same over the ``text`` column of a CTE."""
    return f"""SELECT DISTINCT text AS original, CASE WHEN contains(text, 'tion')
       THEN '[Trans Fail: ' || text || ']' ELSE upper(text) END AS translated
FROM {source} WHERE NOT ends_with(text, '.')"""


def with_views(body: str, *views: str, **extra: str) -> str:
    """``body`` behind the CTEs it needs; ``extra`` adds further ones in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dependency in SQL[name][0]:
            add(dependency)
        if name not in needed:
            needed.append(name)

    for view in views:
        add(view)
    ctes = [f"{name} AS ({SQL[name][1]})" for name in needed] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
