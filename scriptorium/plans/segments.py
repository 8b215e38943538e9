"""Lines, sentences, comments and literals.

The check SQL works the other way round from the operators: it cuts first and finds
lines, islands and followers with windows afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import lexer as lx, text as tx
from scriptorium.operators import annotations as an, segments as sg
from scriptorium.plans import fixtures as fx
from scriptorium.plans.dialect import IS_CODE, JA, strip
from scriptorium.plans.fixtures import SQL, quoted
from scriptorium.plans.register import Register

query = Register()

_NL = "chr(10)"
_END = quoted(f"[{tx.SENTENCE_END}]$")


def newlines(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, {_NL}, '')))"


# -- check views --------------------------------------------------------------

SQL["text_lines"] = (
    ("read_files",),
    f"""SELECT file_id, path, line::INTEGER AS line, {strip("raw")} AS text FROM (
SELECT file_id, path, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line
FROM (SELECT file_id, path, string_split(text, {_NL}) AS parts FROM read_files))""",
)
SQL["all_lines"] = (
    ("text_lines",),
    """SELECT file_id, path, (row_number() OVER (PARTITION BY file_id ORDER BY line) - 1)::INTEGER AS seq, line, text
FROM text_lines WHERE text <> ''""",
)
SQL["all_sentences"] = (
    ("text_lines",),
    f"""SELECT file_id, path, (row_number() OVER (PARTITION BY file_id ORDER BY line) - 1)::INTEGER AS seq, line, text FROM (
SELECT file_id, path, min(line) AS line, string_agg(text, ' ' ORDER BY line) AS text FROM (
SELECT *, coalesce(sum((text = '' OR regexp_matches(text, {_END}))::INTEGER)
       OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
FROM text_lines) WHERE text <> '' GROUP BY file_id, path, part)""",
)

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*["\\]?'
_CHAR = r"'[^'\\]*(?:\\.[^'\\]*)*['\\]?"
_COMMENTS = r"//[^\n]*|/\*[^*]*(?:\*+[^*/][^*]*)*(?:\*+/?)?"


def _cut_sql(pattern: str, source: str) -> str:
    """Pieces with the line and offset they start at; code still in parts."""
    return f"""SELECT file_id, path, n, raw,
       CASE WHEN raw LIKE '"%' THEN 'string_literal' WHEN raw LIKE '//%' THEN 'comment_single'
            WHEN raw LIKE '/*%' THEN 'comment_block' ELSE 'code' END AS type,
       (1 + coalesce(sum({newlines("raw")}) OVER before, 0))::INTEGER AS line,
       coalesce(sum(length(raw)) OVER before, 0)::BIGINT AS start
FROM (SELECT file_id, path, unnest(cuts) AS raw, generate_subscripts(cuts, 1) AS n
      FROM (SELECT file_id, path, regexp_extract_all(text, {quoted(pattern)}) AS cuts FROM {source}))
WINDOW before AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


_WITH_CHARS = rf"""(?s){_STRING}|{_CHAR}|{_COMMENTS}|[^"'/]+|/"""
_NO_CHARS = rf"""(?s){_STRING}|{_COMMENTS}|[^"/]+|/"""

SQL["cuts"] = (("read_files",), _cut_sql(_WITH_CHARS, "read_files"))
SQL["plain_cuts"] = (("read_files",), _cut_sql(_NO_CHARS, "read_files"))
# Neighbouring code joined to islands.
SQL["pieces"] = (
    ("cuts",),
    """SELECT file_id, path, (row_number() OVER (PARTITION BY file_id ORDER BY first_n) - 1)::INTEGER AS seq, type, raw, line, start
FROM (SELECT file_id, path, type, min(n) AS first_n, string_agg(raw, '' ORDER BY n) AS raw, min(line) AS line, min(start) AS start
      FROM (SELECT *, sum((type <> 'code')::INTEGER) OVER (PARTITION BY file_id ORDER BY n) AS island FROM cuts)
      GROUP BY file_id, path, type, island)""",
)
_CLOSED = "(length(raw) >= 4 AND ends_with(raw, '*/'))"
_BODY = f"substring(raw, 3, length(raw) - CASE WHEN {_CLOSED} THEN 4 ELSE 2 END)"
_INNER = (
    f"""CASE type WHEN 'string_literal' THEN regexp_extract(raw, '(?s)^"([^"\\\\]*(?:\\\\.[^"\\\\]*)*)', 1)
     WHEN 'comment_single' THEN {strip("substring(raw, 3)")} WHEN 'comment_block' THEN {strip(_BODY)} END"""
)
SQL["inner_texts"] = (("pieces",), f"SELECT *, {_INNER} AS content FROM pieces")


def _items(view: str) -> str:
    """One item per literal or comment."""
    return f"""SELECT file_id, path, (row_number() OVER (PARTITION BY file_id ORDER BY n) - 1)::INTEGER AS seq, line, {_INNER} AS text
FROM {view} WHERE type <> 'code'"""


def _line_items(view: str) -> str:
    """The same, but block comments line by line."""
    return f"""SELECT file_id, path, (row_number() OVER (PARTITION BY file_id ORDER BY n, part) - 1)::INTEGER AS seq,
       (line + part - 1)::INTEGER AS line, CASE WHEN type = 'comment_block' THEN {strip("chunk")} ELSE {_INNER} END AS text
FROM (SELECT *, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS part
      FROM (SELECT *, CASE WHEN type = 'comment_block' THEN string_split({_BODY}, {_NL}) ELSE [''] END AS chunks
            FROM {view} WHERE type <> 'code'))"""


SQL["code_items"] = (("plain_cuts",), _items("plain_cuts"))
SQL["code_line_items"] = (("plain_cuts",), _line_items("plain_cuts"))

_COLUMNS = "file_id, seq, line, text"


def _detected(plain: str, code: str) -> str:
    return f"""SELECT {_COLUMNS} FROM {plain} WHERE NOT {IS_CODE} AND regexp_matches(text, {JA})
UNION ALL SELECT {_COLUMNS} FROM {code} WHERE {IS_CODE} AND regexp_matches(text, {JA})"""


SQL["detected"] = (("all_sentences", "code_items"), _detected("all_sentences", "code_items"))
SQL["detected_lines"] = (("all_lines", "code_line_items"), _detected("all_lines", "code_line_items"))

# The next piece that is not blank code.
SQL["followed"] = (
    ("inner_texts",),
    f"""SELECT *, coalesce(lead(type) OVER w IN ('comment_single', 'comment_block')
           AND starts_with(lower(lead(content) OVER w), 'translated:'), false) AS already_translated
FROM inner_texts WHERE type <> 'code' OR {strip("raw")} <> ''
WINDOW w AS (PARTITION BY file_id ORDER BY seq)""",
)
SQL["candidates"] = (
    ("followed",),
    f"""SELECT file_id, seq, type, content AS text FROM followed
WHERE type <> 'code' AND NOT already_translated AND regexp_matches(content, {JA})""",
)
SQL["indented"] = (
    ("inner_texts",),
    r"""SELECT i.*, CASE WHEN i.type IN ('comment_single', 'comment_block') THEN
       regexp_replace(regexp_extract(substring(m.text, 1, start::BIGINT), '[^\n]*$'), '[^\t]', ' ', 'g') END AS indentation
FROM inner_texts i JOIN read_files m USING (file_id)""",
)

# -- queries ------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return fx.marked_files(spark, d)


@query(fx.with_views(f"SELECT {_COLUMNS} FROM all_lines WHERE regexp_matches(text, {JA})", "all_lines"))
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return sg.line_segments(_files(spark, d))


@query(fx.with_views(f"SELECT {_COLUMNS} FROM all_sentences", "all_sentences"))
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return sg.sentence_segments(_files(spark, d), ranges=None)


@query(fx.with_views(f"SELECT {_COLUMNS} FROM code_items WHERE regexp_matches(text, {JA})", "code_items"))
def code_segments(spark: SparkSession, d: str) -> DataFrame:
    return sg.code_segments(_files(spark, d))


@query(fx.with_views(f"SELECT {_COLUMNS} FROM code_line_items WHERE regexp_matches(text, {JA})", "code_line_items"))
def code_segments_by_line(spark: SparkSession, d: str) -> DataFrame:
    return sg.code_segments(_files(spark, d), strategy="line")


@query(
    fx.with_views(
        f"SELECT page_id AS file_id, {_COLUMNS.split(', ', 1)[1]} FROM (SELECT file_id AS page_id, * FROM items)",
        sources="SELECT page_id AS file_id, url AS path, html AS text FROM pages",
        cuts_of_pages=_cut_sql(_NO_CHARS, "sources"),
        items=_items("cuts_of_pages"),
    )
)
def page_segments(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("text"))
    return sg.code_segments(pages, ranges=None)


@query(fx.with_views("SELECT file_id, seq, type, raw FROM pieces", "pieces"))
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sg.code_tokens(_files(spark, d))


@query(
    fx.with_views(
        "SELECT type, count(*)::BIGINT AS segments, sum(length(raw))::BIGINT AS characters FROM pieces GROUP BY type", "pieces"
    )
)
def segments_by_type(spark: SparkSession, d: str) -> DataFrame:
    return sg.segments_by_type(sg.code_tokens(_files(spark, d)))


@query(fx.with_views("SELECT file_id, seq, type, content FROM inner_texts WHERE type <> 'code'", "inner_texts"))
def comment_inner(spark: SparkSession, d: str) -> DataFrame:
    return sg.code_tokens(_files(spark, d)).filter(F.col("type") != lx.CODE).select(
        "file_id", "seq", "type", lx.inner(F.col("raw")).alias("content")
    )


@query(
    fx.with_views("SELECT file_id, seq, type, line, indentation FROM indented WHERE type <> 'code'", "indented")
)
def indentation(spark: SparkSession, d: str) -> DataFrame:
    return sg.placed_segments(_files(spark, d)).select("file_id", "seq", "type", "line", "indentation")


@query(fx.with_views("SELECT file_id, seq, type, already_translated FROM followed WHERE type <> 'code'", "followed"))
def already_translated(spark: SparkSession, d: str) -> DataFrame:
    return sg.translated_flags(_files(spark, d))


@query(fx.with_views("SELECT * FROM candidates", "candidates"))
def translation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return sg.translation_candidates(_files(spark, d))


@query(fx.with_views("SELECT * FROM detected", "detected"))
def detected_items(spark: SparkSession, d: str) -> DataFrame:
    return sg.detected_items(_files(spark, d))


@query(fx.with_views("SELECT * FROM detected_lines", "detected_lines"))
def detected_lines(spark: SparkSession, d: str) -> DataFrame:
    return sg.detected_items(_files(spark, d), strategy="line")


_OFFSETS = "unnest([strpos(text, '\"'), length(text) // 2, length(text)])"


@query(
    fx.with_views(
        f"""SELECT DISTINCT file_id, "offset"::INTEGER AS "offset", (length(seen) - length(replace(seen, {_NL}, '')) + 1)::INTEGER AS line
FROM (SELECT file_id, "offset", replace(replace(substring(marked, 1, "offset"), chr(57344), ''), chr(13), {_NL}) AS seen
      FROM (SELECT *, {_OFFSETS} AS "offset", replace(text, chr(13) || {_NL}, chr(57344) || {_NL}) AS marked FROM marked_files))""",
        "marked_files",
    )
)
def line_of_offset(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    size = F.length(text)
    offsets = F.array_distinct(F.array(F.instr(text, '"'), F.floor(size / 2).cast("int"), size))
    return (
        _files(spark, d)
        .select("file_id", "text", F.explode(offsets).alias("offset"))
        .select("file_id", "offset", tx.line_of_offset(text, F.col("offset")).alias("line"))
    )


@query(
    fx.with_views(
        f"""SELECT l.file_id, l.line, l.text, n.note, n.note IS NOT NULL AS has_note
FROM (SELECT file_id, unnest(parts) AS text, generate_subscripts(parts, 1)::INTEGER AS line
      FROM (SELECT file_id, string_split(CASE WHEN ends_with(text, {_NL}) THEN text[:-2] ELSE text END, {_NL}) AS parts FROM src_files)) l
LEFT JOIN (SELECT file_id, line_number AS line, arg_max(content, (created_at, id)) AS note FROM annotations GROUP BY ALL) n
USING (file_id, line)""",
        "src_files", "annotations",
    )
)
def annotated_lines(spark: SparkSession, d: str) -> DataFrame:
    return an.annotated_lines(sg.numbered_lines(fx.src_files(spark, d)), an.current_notes(fx.annotations(spark, d)))
