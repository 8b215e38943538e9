"""The annotation log, blobs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import blob as bl
from scriptorium.operators import annotations as an
from scriptorium.plans import fixtures as fx, translation
from scriptorium.plans.dialect import strip
from scriptorium.plans.fixtures import SQL
from scriptorium.plans.register import Register
from scriptorium.session import working_dir
from scriptorium.sources import tables as tb

query = Register()

_NL = "chr(10)"

# A heading is a line "# <number>"; what follows up to the next one belongs to it.


def parsed_sql(source: str) -> str:
    rest = r"regexp_replace(text, '^#\s*[0-9]+', '')"
    return rf"""WITH cut AS (SELECT file_id, blob, strpos(blob, '@lines') AS mark FROM {source}),
numbered AS (SELECT file_id, n, text,
        CASE WHEN regexp_matches(text, '^#\s*[0-9]+') THEN regexp_extract(text, '^#\s*([0-9]+)', 1)::BIGINT END AS heading
    FROM (SELECT file_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS n
          FROM (SELECT file_id, string_split({strip("substring(blob, mark + 6)")}, {_NL}) AS parts FROM cut WHERE mark > 0))),
blocks AS (SELECT *, count(heading) OVER (PARTITION BY file_id ORDER BY n) AS block FROM numbered),
notes AS (SELECT file_id, block, max(heading) AS line,
        {strip(f"string_agg(CASE WHEN heading IS NULL THEN text ELSE {rest} END, {_NL} ORDER BY n)")} AS note
    FROM blocks WHERE block > 0 GROUP BY file_id, block)
SELECT file_id, line, arg_max(note, block) AS note FROM notes WHERE note <> '' GROUP BY file_id, line
UNION ALL
SELECT file_id, NULL::BIGINT, note FROM (SELECT file_id, CASE WHEN mark > 0 THEN {strip("substring(blob, 1, mark - 1)")} ELSE blob END AS note FROM cut)
WHERE note <> ''"""


def rebuilt_sql(source: str) -> str:
    return f"""SELECT file_id, {strip(f'''coalesce(max({strip("note")}) FILTER (line IS NULL), '') || {_NL} || {_NL} ||
    CASE WHEN count(*) FILTER (line IS NOT NULL) > 0 THEN '@lines' || {_NL} || coalesce(string_agg('# ' || line || {_NL} || {strip("note")} || {_NL}, ''
         ORDER BY line) FILTER (line IS NOT NULL AND {strip("note")} <> ''), '') ELSE '' END''')} AS blob FROM {source} GROUP BY file_id"""


SQL["parsed"] = (("blobs",), parsed_sql("blobs"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return fx.annotations(spark, d)


# -- log ----------------------------------------------------------------------


@query(
    fx.with_views(
        "SELECT f.file_id, f.path, a.id, a.line_number, a.content, a.type, a.created_at FROM src_files f JOIN annotations a USING (file_id)",
        "src_files", "annotations",
    )
)
def file_annotations(spark: SparkSession, d: str) -> DataFrame:
    files = fx.src_files(spark, d).select("file_id", "path")
    return an.file_annotations(files, _log(spark, d)).drop("author")


_LATEST = """SELECT file_id, id, content, created_at FROM
(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS n FROM annotations WHERE line_number = 0)
WHERE n = 1"""


@query(fx.with_views(_LATEST, "annotations"))
def latest_annotation(spark: SparkSession, d: str) -> DataFrame:
    return an.latest_annotation(_log(spark, d))


@query(
    fx.with_views(
        """SELECT file_id, id, content FROM
(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY id DESC) AS n FROM annotations WHERE type = 'manual') WHERE n = 1""",
        "annotations",
    )
)
def latest_manual_note(spark: SparkSession, d: str) -> DataFrame:
    return an.latest_manual_note(_log(spark, d))


@query(
    fx.with_views(
        """SELECT file_id, id, row_number() OVER w AS version, content, lag(content) OVER w AS previous
FROM annotations WINDOW w AS (PARTITION BY file_id ORDER BY created_at, id)""",
        "annotations",
    )
)
def annotation_history(spark: SparkSession, d: str) -> DataFrame:
    return an.annotation_history(_log(spark, d))


@query(
    fx.with_views(
        f"SELECT l.file_id, l.id, l.content, p.path FROM ({_LATEST}) l LEFT JOIN src_files p USING (file_id)", "annotations", "src_files"
    )
)
def limit_one(spark: SparkSession, d: str) -> DataFrame:
    """One newest row for every file at once, in place of one limited query per file."""
    paths = fx.src_files(spark, d).select("file_id", "path")
    return an.latest_annotation(_log(spark, d)).select("file_id", "id", "content").join(paths, "file_id", "left")


# -- blobs --------------------------------------------------------------------


@query(fx.with_views("SELECT * FROM parsed", "parsed"))
def parse_annotation_blob(spark: SparkSession, d: str) -> DataFrame:
    return an.parse_annotation_blob(fx.blobs(spark, d))


@query(
    fx.with_views(
        "SELECT file_id, line, note, row_number() OVER (PARTITION BY file_id ORDER BY line)::INTEGER AS place FROM parsed WHERE line IS NOT NULL",
        "parsed",
    )
)
def sort_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes by line, as a blob stores them."""
    rebuilt = an.blob_rebuild(an.parse_annotation_blob(fx.blobs(spark, d)))
    return rebuilt.select("file_id", F.posexplode(bl.line_notes(F.col("blob"))).alias("pos", "n")).select(
        "file_id", "n.line", "n.note", (F.col("pos") + 1).alias("place")
    )


@query(fx.with_views(rebuilt_sql("parsed"), "parsed"))
def blob_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return an.blob_rebuild(an.parse_annotation_blob(fx.blobs(spark, d)))


@query(
    fx.with_views(
        """SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM live) THEN coalesce(r.blob, '') ELSE b.blob END AS blob
FROM base b LEFT JOIN rebuilt r USING (file_id)""",
        "blobs", "line_edits",
        resets="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, id DESC) AS n FROM line_edits WHERE line = 0) WHERE n = 1",
        live="""SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.file_id, e.line ORDER BY e.created_at DESC, e.id DESC) AS n
FROM line_edits e LEFT JOIN resets r ON r.file_id = e.file_id
WHERE e.line <> 0 AND (r.id IS NULL OR (e.created_at, e.id) > (r.created_at, r.id))) WHERE n = 1""",
        base="SELECT file_id, coalesce(r.content, b.blob) AS blob FROM blobs b FULL JOIN resets r USING (file_id)",
        base_notes=parsed_sql("base"),
        merged=f"""SELECT file_id, line, coalesce(l.content, n.note) AS note FROM base_notes n FULL JOIN live l USING (file_id, line)
WHERE {strip("coalesce(l.content, n.note)")} <> ''""",
        rebuilt=rebuilt_sql("merged"),
    ).replace(
        "FROM base b LEFT JOIN rebuilt r USING (file_id)",
        "FROM (SELECT * FROM base UNION ALL SELECT DISTINCT file_id, NULL FROM live WHERE file_id NOT IN (SELECT file_id FROM base)) b LEFT JOIN rebuilt r USING (file_id)",
    )
)
def apply_line_edits(spark: SparkSession, d: str) -> DataFrame:
    return an.apply_line_edits(fx.blobs(spark, d), fx.line_edits(spark, d))


@query(
    fx.with_views(
        """SELECT file_id, r.blob FROM rebuilt r LEFT JOIN blobs b USING (file_id) WHERE r.blob IS DISTINCT FROM b.blob""",
        "parsed", "line_notes",
        merged=f"""SELECT file_id, line, CASE WHEN p.note IS NULL THEN n.note WHEN n.note IS NULL OR contains(p.note, n.note) THEN p.note
ELSE p.note || {_NL} || {_NL} || n.note END AS note
FROM parsed p FULL JOIN line_notes n USING (file_id, line) WHERE file_id IN (SELECT file_id FROM line_notes)""",
        rebuilt=rebuilt_sql("merged"),
    )
)
def merge_tool_notes(spark: SparkSession, d: str) -> DataFrame:
    return an.merge_tool_notes(fx.blobs(spark, d), translation.line_notes(spark, d))


_BATCH_TIME = "2100-01-01 00:00:00"


@query(
    fx.with_views(
        """SELECT file_id, id, content, created_at FROM merged UNION ALL
SELECT file_id, id, content, created_at FROM newest WHERE file_id NOT IN (SELECT file_id FROM merged)""",
        "annotations",
        newest=_LATEST,
        notes="""SELECT file_id, string_agg('# ' || line || chr(10) || note || chr(10), '' ORDER BY line) AS lines FROM
(SELECT file_id, line_number AS line, arg_max(content, (created_at, id)) AS note FROM annotations WHERE line_number <> 0 AND type = 'manual' GROUP BY ALL)
WHERE note LIKE 'purchase%' GROUP BY file_id""",
        merged=f"""SELECT file_id, (SELECT max(id) FROM annotations) + row_number() OVER (ORDER BY file_id) AS id,
       trim(coalesce(content, '') || {_NL} || {_NL} || '@lines' || {_NL} || lines, {_NL}) AS content, TIMESTAMP '{_BATCH_TIME}' AS created_at
FROM notes LEFT JOIN newest USING (file_id)""",
    )
)
def append_versions(spark: SparkSession, d: str) -> DataFrame:
    """Notes merged into the newest blobs go back to the log under a batch key, twice as a repeated run would; then the newest rows."""
    location = working_dir(spark, "log")
    tb.write_batch(_log(spark, d), location, "import")
    for _ in range(2):
        log = tb.read_log(spark, location).filter("batch <> 'tool-1'")
        notes = an.current_notes(log.filter("line_number <> 0 AND type = 'manual'")).filter("note LIKE 'purchase%'")
        blobs = an.latest_annotation(log).select("file_id", F.col("content").alias("blob"))
        merged = an.merge_tool_notes(blobs, notes)
        tb.write_batch(an.new_versions(merged, log, F.lit(_BATCH_TIME)), location, "tool-1")
    return an.latest_annotation(tb.read_log(spark, location))


# -- snapshots ----------------------------------------------------------------

_SNAPSHOT = """SELECT file_id, line_number AS line, CASE WHEN note LIKE '%7' THEN '' ELSE note END AS note FROM
(SELECT file_id, line_number, arg_max(content, (created_at, id)) AS note FROM annotations WHERE {which} GROUP BY ALL)"""


@query(
    fx.with_views(
        """SELECT file_id, line, CASE WHEN o.note IS NULL THEN 'create'
       WHEN n.note IS NULL THEN CASE WHEN o.note <> '' THEN 'remove' ELSE 'keep' END
       WHEN o.note = n.note THEN 'unchanged' ELSE 'update' END AS action, coalesce(n.note, o.note) AS note
FROM older o FULL JOIN newer n USING (file_id, line)""",
        "annotations",
        older=_SNAPSHOT.format(which="type = 'manual'"),
        newer=_SNAPSHOT.format(which="content NOT LIKE 'purchase%'"),
    )
)
def annotation_diff(spark: SparkSession, d: str) -> DataFrame:
    def snapshot(which: str) -> DataFrame:
        notes = an.current_notes(_log(spark, d).filter(which))
        return notes.withColumn("note", F.when(F.col("note").endswith("7"), "").otherwise(F.col("note")))

    return an.annotation_diff(snapshot("type = 'manual'"), snapshot("content NOT LIKE 'purchase%'"))
