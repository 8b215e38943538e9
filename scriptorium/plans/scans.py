"""Scans, sources, sinks and path rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import charset as cs, paths as px, text as tx
from scriptorium.operators import annotations as an, encoding as en, paths as po, tools as tl
from scriptorium.plans import fixtures as fx
from scriptorium.plans.dialect import EXTENSION, FILENAME, IS_CODE, JA, PARENT, ends_with_any
from scriptorium.plans.register import Register
from scriptorium.session import working_dir
from scriptorium.sources import cache as ca, catalog as ct, sinks as sk, tables as tb

query = Register()


# -- scans --------------------------------------------------------------------


@query(fx.with_views(f"SELECT path, {FILENAME} AS filename, {PARENT} AS parent, {EXTENSION} AS extension FROM src_files", "src_files"))
def scan_catalog(spark: SparkSession, d: str) -> DataFrame:
    return ct.catalog(fx.src_files(spark, d))


@query(
    fx.with_views(
        f"""SELECT path, {ends_with_any(FILENAME, px.COMMENT_SUFFIXES)} AS commented
FROM tree_files WHERE {ends_with_any(FILENAME, px.REENCODE_SUFFIXES)} OR {FILENAME} = 'Makefile'""",
        "tree_files",
    )
)
def scan_by_extension(spark: SparkSession, d: str) -> DataFrame:
    kept = ct.with_suffixes(fx.tree_files(spark, d), px.REENCODE_SUFFIXES, px.REENCODE_NAMES)
    return kept.select("path", px.has_suffix(F.col("path"), px.COMMENT_SUFFIXES).alias("commented"))


_DIRS = """SELECT DISTINCT array_to_string(list_slice(parts, 1, n), '/') AS dir FROM
(SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(path, '/') AS parts FROM tree_files))"""
_EXCLUDED = "SELECT dir FROM dirs WHERE regexp_matches(dir, '^src1[0-9]*$') OR dir LIKE '%/de'"


def _dirs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dirs = po.directories(fx.tree_files(spark, d))
    return dirs, dirs.filter(F.col("dir").rlike("^src1[0-9]*$") | F.col("dir").endswith("/de"))


@query(
    fx.with_views(
        """SELECT dir FROM dirs WHERE NOT EXISTS
(SELECT 1 FROM excluded e WHERE dirs.dir = e.dir OR starts_with(dirs.dir, e.dir || '/'))""",
        "tree_files", dirs=_DIRS, excluded=_EXCLUDED,
    )
)
def dir_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    return po.include_exclude(*_dirs(spark, d))


@query(fx.with_views("SELECT dir FROM dirs EXCEPT SELECT dir FROM excluded", "tree_files", dirs=_DIRS, excluded=_EXCLUDED))
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    dirs, excluded = _dirs(spark, d)
    return dirs.subtract(excluded)


_KNOWN = "SELECT path FROM src_files"


def _new(spark: SparkSession, d: str) -> DataFrame:
    known = fx.src_files(spark, d)
    scanned = ct.catalog(fx.tree_files(spark, d)).select("path", "filename")
    # The same tree listed twice: a repeated listing must not add a path twice.
    return ct.new_files(scanned.unionByName(scanned), known)


# The upper half of an MD5 as a signed number.
_ID = "CASE WHEN u >= 9223372036854775808 THEN CAST(u - 18446744073709551616 AS BIGINT) ELSE CAST(u AS BIGINT) END"


def _ids_sql(source: str) -> str:
    return f"SELECT *, {_ID} AS file_id FROM (SELECT *, CAST(('0x' || substring(md5(path), 1, 16))::UBIGINT AS HUGEINT) AS u FROM ({source}))"


@query(
    fx.with_views(
        "SELECT path, filename, file_id FROM (" + _ids_sql(f"SELECT DISTINCT path, {FILENAME} AS filename FROM tree_files WHERE path NOT IN (SELECT path FROM known)") + ")",
        "tree_files", known=_KNOWN,
    )
)
def incremental_new_files(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: the source files are indexed with their ids, then what a listing of the whole tree adds."""
    first = ct.catalog(fx.src_files(spark, d)).select("path", "filename").dropDuplicates(["path"])
    known = ct.with_ids(first, spark.createDataFrame([], "file_id long, path string"))
    return ct.with_ids(_new(spark, d), known)


@query(
    fx.with_views(
        "SELECT count(DISTINCT path)::BIGINT AS new_files FROM tree_files WHERE path NOT IN (SELECT path FROM known)",
        "tree_files", known=_KNOWN,
    )
)
def new_file_count(spark: SparkSession, d: str) -> DataFrame:
    return _new(spark, d).agg(F.count("*").alias("new_files"))


_BYTES = "from_hex(array_to_string(list_transform(string_split(head, ''), lambda c: printf('%02X', unicode(c))), ''))"


@query(
    fx.with_views(
        f"""SELECT file_id, cap, length(head)::INTEGER AS kept, md5({_BYTES}) AS digest FROM
(SELECT file_id, cap, substring(raw, 1, cap) AS head FROM legacy_files,
 (VALUES (1024), (10000), (20000), (1000000)) caps(cap))""",
        "legacy_files",
    )
)
def bounded_prefix(spark: SparkSession, d: str) -> DataFrame:
    return en.bounded_prefix(fx.legacy_files(spark, d))


@query(
    fx.with_views(
        r"""SELECT file_id, replace(replace(replace(CASE WHEN kind = 3 THEN text
                ELSE regexp_replace(raw, '[\x{80}-\x{ff}]', chr(65533), 'g') END,
              chr(10), CASE file_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END),
            chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text
FROM legacy_files""",
        "legacy_files",
    )
)
def read_text_replace(spark: SparkSession, d: str) -> DataFrame:
    # Windows and old Macintosh line ends, which reading turns into newlines.
    end = F.when(F.col("file_id") % 3 == 0, b"\r\n").when(F.col("file_id") % 3 == 1, b"\r").otherwise(b"\n")
    chars = F.replace(cs.latin1(F.col("content")), F.lit("\n"), cs.latin1(end))
    return fx.legacy_files(spark, d).select("file_id", tx.text_from_bytes(cs.bytes_of_latin1(chars)).alias("text"))


# -- stored tables ------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, with quotes, commas and newlines in them."""
    return fx.marked_files(spark, d).select(
        "path", F.col("text").alias("original"), F.concat(F.lit("T: "), "text").alias("translated")
    )


@query(fx.with_views("SELECT DISTINCT text AS original, 'T: ' || text AS translated FROM marked_files", "marked_files"))
def cache_load(spark: SparkSession, d: str) -> DataFrame:
    location = working_dir(spark, "cache")
    ca.append_cache_csv(_pairs(spark, d), location)
    return ca.load_cache_csv(spark, location)


@query(
    fx.with_views(
        f"""SELECT DISTINCT text AS original,
       CASE WHEN text IN (SELECT text FROM marked_files WHERE {IS_CODE}) THEN 'T: ' ELSE 'U: ' END || text AS translated
FROM marked_files""",
        "marked_files",
    )
)
def cache_append(spark: SparkSession, d: str) -> DataFrame:
    location = working_dir(spark, "cache")
    pairs = _pairs(spark, d)
    # The texts of source files are known already.
    pairs.filter(px.is_code_file(F.col("path"))).select("original", "translated").distinct().write.parquet(location)
    again = pairs.select("original", F.concat(F.lit("U: "), "original").alias("translated"))
    ca.unseen(again, tb.read_table(spark, location, tb.CACHE)).write.mode("append").parquet(location)
    return tb.read_table(spark, location, tb.CACHE)


@query(
    fx.with_views(
        f"""SELECT f.file_id, f.path, {FILENAME} AS filename, 'file' AS file_type, 'UTF-8' AS encoding,
       a.id AS annotation_id, a.line_number, a.content
FROM src_files f LEFT JOIN annotations a ON a.file_id = f.file_id""",
        "src_files", "annotations",
    )
)
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    base = working_dir(spark, "catalog")
    files, notes = f"{base}/files", f"{base}/annotations"
    for location, schema in ((files, tb.FILES), (notes, tb.ANNOTATIONS), (files, tb.FILES)):
        tb.create_if_missing(spark, location, schema)
    source = fx.src_files(spark, d)
    rows = source.select(
        "file_id", "path", px.basename(F.col("path")).alias("filename"),
        F.lit("file").alias("file_type"), F.lit("UTF-8").alias("encoding"),
    )
    tb.append(rows, files, tb.FILES)
    tb.append(fx.annotations(spark, d), notes, tb.ANNOTATIONS)
    stored = tb.read_table(spark, notes, tb.ANNOTATIONS)
    return tb.read_table(spark, files, tb.FILES).join(stored, "file_id", "left").select(
        "file_id", "path", "filename", "file_type", "encoding",
        F.col("id").alias("annotation_id"), "line_number", "content",
    )


@query(
    fx.with_views(
        """SELECT s.path, CASE WHEN m.text <> s.text THEN 2 ELSE 1 END::INTEGER AS version, m.text
FROM src_files s JOIN marked_files m USING (file_id)""",
        "src_files", "marked_files",
    )
)
def versioned_rewrite(spark: SparkSession, d: str) -> DataFrame:
    location = working_dir(spark, "versions")
    source, marked = fx.src_files(spark, d), fx.marked_files(spark, d)
    sk.write_version(source, location, 1)
    changed = marked.join(source.select("file_id", F.col("text").alias("was")), "file_id").filter("text <> was")
    sk.write_version(changed, location, 2)
    return sk.latest_version(sk.read_versions(spark, location))


@query(
    """WITH o AS (SELECT event_id AS file_id, event_id % 10 AS shape, json_extract_string(props, '$.k') AS k, event_type FROM events)
SELECT file_id, CASE WHEN shape = 0 THEN k::BIGINT END AS line, CASE WHEN shape = 0 THEN event_type || ' {x}' END AS note,
       CASE shape WHEN 1 THEN 'bad JSON' WHEN 2 THEN 'not found' WHEN 3 THEN 'no JSON' WHEN 6 THEN 'bad note'
                  WHEN 7 THEN 'bad JSON' WHEN 8 THEN 'no annotations' WHEN 9 THEN 'no JSON' END AS error
FROM o WHERE shape NOT IN (4, 5)
UNION ALL SELECT file_id, 1, 'one', NULL FROM o WHERE shape = 4
UNION ALL SELECT file_id, 200, 'two', NULL FROM o WHERE shape = 4
UNION ALL SELECT file_id, 7, 'last ' || k, NULL FROM o WHERE shape = 5"""
)
def tool_output_json(spark: SparkSession, d: str) -> DataFrame:
    shape = F.col("event_id") % 10
    k = F.get_json_object("props", "$.k")
    output = (
        F.when(shape == 0, F.concat(F.lit('noise\n{"annotations": {"'), k, F.lit('": "'), "event_type", F.lit(' {x}"}}\n')))
        .when(shape == 1, F.concat(F.lit('noise {"annotations": {"'), k, F.lit('": "cut')))
        .when(shape == 2, F.lit('noise {"error": "not found"}'))
        .when(shape == 3, F.concat(F.lit("Traceback "), k))
        .when(shape == 4, '{"annotations": {"1": "one", "200": "two"}}')
        .when(shape == 5, F.concat(F.lit('{"annotations": {"7": "first", "7": "last '), k, F.lit('"}}')))
        .when(shape == 6, F.concat(F.lit('{"annotations": {"1": "one", "line '), k, F.lit('": "lost"}}')))
        .when(shape == 7, F.concat(F.lit('{"annotations": {"1": "one"}}\nTraceback '), k))
        .when(shape == 8, "{}")
    )
    events = fx.table(spark, d, "events").select(F.col("event_id").alias("file_id"), output.alias("output"))
    return an.tool_output(events)


# -- path rules ---------------------------------------------------------------


@query(
    fx.with_views(
        f"SELECT file_id, path, {FILENAME} AS filename, {PARENT} AS parent, {EXTENSION} AS extension FROM tree_files",
        "tree_files",
    )
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    windows = fx.tree_files(spark, d).select("file_id", F.replace("path", F.lit("/"), F.lit("\\")).alias("path"))
    path = px.forward_slashes(F.col("path"))
    return windows.select("file_id", path.alias("path")).select(
        "file_id", "path", px.basename(F.col("path")).alias("filename"), px.parent(F.col("path")).alias("parent"),
        px.extension(F.col("path")).alias("extension"),
    )


@query(
    fx.with_views(
        "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN path ELSE 'a?b' || path || '?' END AS path FROM src_files", "src_files"
    )
)
def path_sanitize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode("path", "UTF-8")
    broken = F.concat(F.lit(b"a\xffb"), raw, F.lit(b"\x82"))
    name = F.when(F.col("file_id") % 2 == 0, raw).otherwise(broken).cast("string")
    return fx.src_files(spark, d).select("file_id", px.sanitise(name).alias("path"))


_REQUEST = "CASE file_id % 4 WHEN 0 THEN path WHEN 1 THEN '../' || path WHEN 2 THEN '/' || path ELSE 'a..b/' || path END"


@query(
    fx.with_views(
        f"""SELECT file_id, request FROM (SELECT file_id, {_REQUEST} AS request FROM src_files)
WHERE NOT regexp_matches(request, '\\.\\.|^/')""",
        "src_files",
    )
)
def path_guard(spark: SparkSession, d: str) -> DataFrame:
    requests = fx.src_files(spark, d).select("file_id", F.expr(_REQUEST).alias("request"))
    return requests.filter(px.is_safe_request(F.col("request")))


@query(
    fx.with_views(
        "SELECT path, path LIKE '%,v' AS is_archive, CASE WHEN path LIKE '%,v' THEN path[:-3] END AS target FROM tree_files",
        "tree_files",
    )
)
def is_version_archive(spark: SparkSession, d: str) -> DataFrame:
    archive = px.is_archive(F.col("path"))
    return fx.tree_files(spark, d).select(
        "path", archive.alias("is_archive"), F.when(archive, px.archive_target(F.col("path"))).alias("target")
    )


@query(
    fx.with_views(
        f"SELECT file_id, CASE {EXTENSION} "
        + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in tl.LANGUAGES.items())
        + " ELSE 'text' END AS language FROM tree_files",
        "tree_files",
    )
)
def language_by_extension(spark: SparkSession, d: str) -> DataFrame:
    return fx.tree_files(spark, d).select("file_id", tl.language(F.col("path")).alias("language"))


@query(fx.with_views(f"SELECT file_id, {IS_CODE} AS is_code FROM tree_files", "tree_files"))
def is_code_file(spark: SparkSession, d: str) -> DataFrame:
    return fx.tree_files(spark, d).select("file_id", px.is_code_file(F.col("path")).alias("is_code"))


@query(
    fx.with_views(
        f"""SELECT file_id, regexp_matches(text, {JA}) AS japanese, regexp_matches(text, '[À-ÿ]') AS accented
FROM marked_files""",
        "marked_files",
    )
)
def contains_script(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return fx.marked_files(spark, d).select(
        "file_id",
        tx.contains_script(text).alias("japanese"),
        tx.contains_script(text, tx.ACCENTED_LATIN).alias("accented"),
    )


@query(
    fx.with_views(
        "SELECT file_id, tool, name FROM tree_files, (VALUES "
        + ", ".join(f"('{k}', '{n}')" for k, n, _ in tl.TOOLS)
        + ") t(tool, name) WHERE tool <> 'format_code' OR regexp_matches(lower(path), '\\.[ch]$')",
        "tree_files",
    )
)
def tools_available(spark: SparkSession, d: str) -> DataFrame:
    return tl.tools_available(fx.tree_files(spark, d))


# -- trees and resolution -----------------------------------------------------

_URLS = "SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"
_NODES = """SELECT path, min(type) AS type FROM (
SELECT array_to_string(list_slice(parts, 1, n), '/') AS path, CASE WHEN n = len(parts) THEN 'file' ELSE 'dir' END AS type
FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT string_split(path, '/') AS parts FROM {source} WHERE path <> '')))
GROUP BY path"""


@query(
    fx.with_views(
        f"SELECT path, {PARENT} AS parent, {FILENAME} AS name, type FROM nodes",
        urls=_URLS, nodes=_NODES.format(source="urls"),
    )
)
def path_tree(spark: SparkSession, d: str) -> DataFrame:
    urls = fx.table(spark, d, "pages").select(
        F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")
    )
    return po.path_tree(urls)


@query(
    fx.with_views(
        f"SELECT {PARENT} AS parent, {FILENAME} AS name, path, type FROM nodes",
        "tree_files", nodes=_NODES.format(source="tree_files"),
    )
)
def dir_listing(spark: SparkSession, d: str) -> DataFrame:
    return po.dir_listing(po.path_tree(fx.tree_files(spark, d)))


_ASKED = r"""SELECT file_id AS request_id, CASE file_id % 5 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '^[^/]*/', '')
WHEN 2 THEN replace(regexp_replace(path, '^[^/]*/', ''), '/', '\') WHEN 3 THEN 'x' || path ELSE split_part(path, '/', -1) END AS request
FROM src_files"""
_RESOLVED = r"""SELECT request_id, request, file_id, path FROM (
SELECT a.request_id, a.request, f.file_id, f.path,
       row_number() OVER (PARTITION BY a.request_id ORDER BY (f.path = a.request) DESC, f.file_id) AS n
FROM (SELECT *, replace(request, '\', '/') AS ending FROM asked) a
LEFT JOIN (SELECT *, split_part(path, '/', -1) AS filename FROM tree_files) f
  ON f.filename = split_part(a.ending, '/', -1) AND (f.path = a.request OR {match})) WHERE n = 1"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("file_id") % 5
    below = F.regexp_replace("path", "^[^/]*/", "")
    return fx.src_files(spark, d).select(
        F.col("file_id").alias("request_id"),
        F.when(n == 0, F.col("path"))
        .when(n == 1, below)
        .when(n == 2, F.replace(below, F.lit("/"), F.lit("\\")))
        .when(n == 3, F.concat(F.lit("x"), "path"))
        .otherwise(px.basename(F.col("path")))
        .alias("request"),
    )


@query(
    fx.with_views(
        _RESOLVED.replace("{match}", "f.path = a.ending OR ends_with(f.path, '/' || a.ending)"), "tree_files", asked=_ASKED
    )
)
def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    return po.resolve_path(_asked(spark, d), fx.tree_files(spark, d))


@query(
    fx.with_views(
        _RESOLVED.replace("{match}", "ends_with(f.path, a.ending)"),
        "tree_files",
        asked="SELECT file_id AS request_id, CASE WHEN file_id % 2 = 0 THEN substring(path, 3) ELSE substring(path, 8) END AS request FROM src_files",
    )
)
def resolve_path_unanchored(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.src_files(spark, d).select(
        F.col("file_id").alias("request_id"),
        F.when(F.col("file_id") % 2 == 0, F.expr("substring(path, 3)")).otherwise(F.expr("substring(path, 8)")).alias("request"),
    )
    return po.resolve_path(asked, fx.tree_files(spark, d), anchored=False)


@query(
    fx.with_views(
        """SELECT r.file_id AS request_id, r.path AS request, coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.path, b.path) AS path
FROM src_files r LEFT JOIN stored a ON a.path = r.path LEFT JOIN stored b ON b.path = 'source-code/' || r.path""",
        "src_files",
        stored="SELECT file_id, CASE file_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'source-code/' ELSE 'other/' END || path AS path FROM src_files",
    )
)
def resolve_prefix(spark: SparkSession, d: str) -> DataFrame:
    files = fx.src_files(spark, d)
    n = F.col("file_id") % 3
    stored = files.select(
        "file_id", F.concat(F.when(n == 0, "").when(n == 1, "source-code/").otherwise("other/"), "path").alias("path")
    )
    requests = files.select(F.col("file_id").alias("request_id"), F.col("path").alias("request"))
    return po.resolve_prefix(requests, stored)
