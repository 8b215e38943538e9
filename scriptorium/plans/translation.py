"""The translation loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import segments as sg, translation as tr
from scriptorium.plans import fixtures as fx, segments  # noqa: F401  (its check views are used below)
from scriptorium.plans.dialect import strip
from scriptorium.plans.fixtures import SQL, quoted
from scriptorium.plans.register import Register
from scriptorium.session import stored

query = Register()

SQL["item_cache"] = (("detected",), fx.cache_sql("detected"))
SQL["written_back"] = (
    ("detected", "item_cache"),
    """SELECT d.file_id, d.seq, d.line, d.text, c.translated FROM detected d JOIN item_cache c ON c.original = d.text
WHERE c.translated <> '' AND c.translated <> d.text AND NOT contains(c.translated, '[Trans Fail')""",
)
SQL["line_notes"] = (
    ("written_back",),
    "SELECT file_id, line, string_agg('Translated: ' || translated, chr(10) ORDER BY seq) AS note FROM written_back GROUP BY file_id, line",
)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return sg.detected_items(fx.marked_files(spark, d))


def _kept_items(spark: SparkSession, d: str) -> DataFrame:
    """The items for queries that read them twice, for the stand-in cache and for the lookup: cut once and stored."""
    return stored(_items(spark, d), "items")


def _written_back(spark: SparkSession, d: str) -> DataFrame:
    items = _kept_items(spark, d)
    return tr.translation_writeback(items, fx.translation_cache(items))


def line_notes(spark: SparkSession, d: str) -> DataFrame:
    return tr.notes_per_line(_written_back(spark, d))


@query(fx.with_views("SELECT DISTINCT text FROM detected", "detected"))
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return tr.distinct_texts(_items(spark, d))


@query(
    fx.with_views(
        "SELECT file_id, seq, line, text, translated FROM detected LEFT JOIN item_cache ON original = text", "detected", "item_cache"
    )
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    items = _kept_items(spark, d)
    return tr.cache_lookup(items, fx.translation_cache(items))


_MISSES = "SELECT DISTINCT text FROM detected WHERE text NOT IN (SELECT original FROM item_cache)"


@query(fx.with_views(_MISSES, "detected", "item_cache"))
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    items = _kept_items(spark, d)
    return tr.cache_misses(items, fx.translation_cache(items))


@query(
    fx.with_views(
        """SELECT place // 20 AS batch, (place % 20)::INTEGER AS position, text
FROM (SELECT text, row_number() OVER (ORDER BY encode(text)) - 1 AS place FROM misses)""",
        "detected", "item_cache", misses=_MISSES,
    )
)
def translation_batches(spark: SparkSession, d: str) -> DataFrame:
    items = _kept_items(spark, d)
    return tr.translation_batches(tr.cache_misses(items, fx.translation_cache(items)))


@query(fx.with_views("""SELECT text AS original, CASE WHEN length(text) % 5 > 0 THEN '<' || reverse(text) || '>' END AS translated,
       CASE WHEN length(text) % 5 = 0 THEN 'ValueError: refused' END AS error FROM misses""", "detected", "item_cache", misses=_MISSES))
def user_translator(spark: SparkSession, d: str) -> DataFrame:
    """The hook with a stand-in translator that refuses every list with a text whose length is divisible by five."""

    def stand_in(texts: list[str]) -> list[str]:
        if any(len(text) % 5 == 0 for text in texts):
            raise ValueError("refused")
        return [f"<{text[::-1]}>" for text in texts]

    items = _kept_items(spark, d)
    misses = tr.cache_misses(items, fx.translation_cache(items))
    return tr.translate(misses, stand_in)


@query(
    fx.with_views(
        f"""SELECT original, translated,
       translated <> '' AND translated <> original AND NOT contains(translated, '[Trans Fail') AS as_note,
       translated <> '' AND {strip("translated")} <> {strip("original")} AND NOT contains(translated, '[Translation Failed]') AS as_comment
FROM tried""",
        "detected",
        tried="""SELECT DISTINCT text AS original, CASE length(text) % 6 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN text || ' '
WHEN 3 THEN '[Trans Fail: x]' WHEN 4 THEN '[Translation Failed]' ELSE upper(text) || '.' END AS translated FROM detected""",
    )
)
def translation_keep(spark: SparkSession, d: str) -> DataFrame:
    text, size = F.col("text"), F.length("text") % 6
    translated = (
        F.when(size == 0, "").when(size == 1, text).when(size == 2, F.concat(text, F.lit(" ")))
        .when(size == 3, "[Trans Fail: x]").when(size == 4, "[Translation Failed]")
        .otherwise(F.concat(F.upper(text), F.lit(".")))
    )
    tried = tr.distinct_texts(_items(spark, d)).select(text.alias("original"), translated.alias("translated"))
    return tried.select(
        "original",
        "translated",
        tr.keeps_note(F.col("original"), F.col("translated")).alias("as_note"),
        tr.keeps_comment(F.col("original"), F.col("translated")).alias("as_comment"),
    )


@query(fx.with_views("SELECT * FROM written_back", "written_back"))
def translation_writeback(spark: SparkSession, d: str) -> DataFrame:
    return _written_back(spark, d)


@query(fx.with_views("SELECT file_id, seq, 'Translated: ' || translated AS note FROM written_back", "written_back"))
def format_note(spark: SparkSession, d: str) -> DataFrame:
    return _written_back(spark, d).select("file_id", "seq", tr.format_note(F.col("translated")).alias("note"))


@query(fx.with_views("SELECT * FROM line_notes", "line_notes"))
def notes_per_line(spark: SparkSession, d: str) -> DataFrame:
    return line_notes(spark, d)


_QUOTED = "'//Translated: \"' || translated || '\"'"


@query(
    fx.with_views(
        f"""SELECT file_id, replace(string_agg(output.text, '' ORDER BY seq, step, origin) || coalesce(chr(10) || any_value(tail), ''), chr(10), any_value(style)) AS text
FROM output JOIN read_files USING (file_id) LEFT JOIN (SELECT file_id, string_agg({_QUOTED} || chr(10), '' ORDER BY seq) AS tail
                       FROM waiting WHERE target IS NULL GROUP BY file_id) USING (file_id)
GROUP BY file_id""",
        "candidates", "indented", "read_files",
        cand_cache=fx.cache_sql("candidates"),
        found=f"""SELECT file_id, seq, type, translated FROM candidates JOIN cand_cache ON original = text
WHERE {strip("translated")} <> {strip("text")} AND translated <> '' AND NOT contains(translated, '[Translation Failed]')""",
        rows_="""SELECT i.file_id, i.seq, i.type, i.raw, i.indentation, f.translated,
       i.type = 'comment_single' OR (i.type = 'code' AND contains(i.raw, chr(10))) AS flushes
FROM indented i LEFT JOIN found f USING (file_id, seq) WHERE i.file_id IN (SELECT file_id FROM found)""",
        aimed="""SELECT *, min(CASE WHEN flushes THEN seq END)
       OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM rows_""",
        waiting="SELECT * FROM aimed WHERE type = 'string_literal' AND translated IS NOT NULL",
        output=f"""SELECT file_id, seq, 0 AS step, seq AS origin,
       CASE WHEN type = 'code' AND flushes THEN substring(raw, 1, strpos(raw, chr(10))) ELSE raw END AS text FROM aimed
UNION ALL SELECT file_id, seq, 3, seq, substring(raw, strpos(raw, chr(10)) + 1) FROM aimed WHERE type = 'code' AND flushes
UNION ALL SELECT file_id, seq, 1, seq, chr(10) || indentation || '//Translated: ' || translated
          FROM aimed WHERE type LIKE 'comment%' AND translated IS NOT NULL
UNION ALL SELECT w.file_id, w.target, 2, w.seq, CASE WHEN t.type = 'code' THEN chr(9) || {_QUOTED.replace("translated", "w.translated")} || chr(10)
          ELSE chr(10) || t.indentation || {_QUOTED.replace("translated", "w.translated")} END
          FROM waiting w JOIN aimed t ON t.file_id = w.file_id AND t.seq = w.target""",
    )
)
def inject_translations(spark: SparkSession, d: str) -> DataFrame:
    files = sg.pieces_of(fx.marked_files(spark, d))
    return tr.inject_translations(files, fx.translation_cache(sg.translation_candidates(files)))
