"""Triage, conversion, reports and the modernisation plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import charset as cs
from scriptorium.operators import encoding as en, modernize as md, reports as rp
from scriptorium.plans import fixtures as fx
from scriptorium.plans.dialect import EXTENSION, FILENAME, re2
from scriptorium.plans.fixtures import quoted
from scriptorium.plans.register import Register
from scriptorium.session import working_dir
from scriptorium.sources import catalog as ct

query = Register()

_NUL = "contains({raw}, chr(0))"
_HEADER_NUL = "contains(substring({raw}, 1, 1024), chr(0))"
_ASCII = r"NOT regexp_matches({raw}, '[\x{{80}}-\x{{ff}}]')"
_UTF8 = (
    r"regexp_full_match({raw}, '(?s)(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]"
    r"|[\xe1-\xec\xee\xef][\x80-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf][\x80-\xbf]"
    r"|[\xf1-\xf3][\x80-\xbf][\x80-\xbf][\x80-\xbf]|\xf4[\x80-\x8f][\x80-\xbf][\x80-\xbf])*')"
)


def _full(pattern: str) -> str:
    return "regexp_full_match({raw}, " + quoted(re2(pattern)).replace("{", "{{").replace("}", "}}") + ")"


_TESTS = {
    "ASCII": _ASCII,
    "UTF-8": _UTF8,
    "Shift-JIS": _full(cs.SJIS_STRICT_TEXT),
    "EUC-JP": _full(cs.EUC_STRICT_TEXT),
    "Windows-31J": _full(cs.WINDOWS_STRICT_TEXT),
    "ISO-8859-1": _full(cs.LATIN1_TEXT),
}


def _label(order: str, raw: str = "raw") -> str:
    """By byte tables: for the legacy orders only, whose labels do not follow from the kind of file."""
    return "CASE " + " ".join(f"WHEN {_TESTS[n].format(raw=raw)} THEN '{n}'" for n in cs.ORDERS[order]) + f" ELSE '{cs.UNKNOWN}' END"


_MAGIC = "CASE " + " ".join(
    f"WHEN starts_with(raw, {quoted(bytes.fromhex(sig).decode('latin-1'))}) THEN '{name}'"
    for sig, name in sorted(cs.SIGNATURES, key=lambda s: -len(s[0]))
) + f" ELSE '{cs.UNKNOWN_TYPE}' END"

_TRIAGE = f"""SELECT file_id, path, path LIKE '%,v' AS is_archive, {_NUL.format(raw="raw")} AS is_binary,
       CASE WHEN {_NUL.format(raw="raw")} THEN {_MAGIC} ELSE 'Text' END AS file_type,
       CASE WHEN {_NUL.format(raw="raw")} THEN 'Binary' ELSE label END AS encoding,
       {EXTENSION} AS extension
FROM legacy_files"""


def _triage(spark: SparkSession, d: str) -> DataFrame:
    return en.classify(fx.legacy_files(spark, d))


@query(
    fx.with_views(
        f"SELECT file_id, {_NUL.format(raw='raw')} AS nul_anywhere, {_HEADER_NUL.format(raw='raw')} AS nul_in_header FROM legacy_files",
        "legacy_files",
    )
)
def is_binary(spark: SparkSession, d: str) -> DataFrame:
    return en.is_binary(fx.legacy_files(spark, d))


@query(fx.with_views("SELECT file_id, label AS encoding FROM legacy_files", "legacy_files"))
def encoding_strict(spark: SparkSession, d: str) -> DataFrame:
    return en.encoding_strict(fx.legacy_files(spark, d))


@query(
    fx.with_views(
        f"SELECT file_id, {_label('legacy')} AS shift_jis_first, {_label('legacy_euc')} AS then_euc_jp FROM legacy_files",
        "legacy_files",
    )
)
def encoding_strict_legacy(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("content")
    return fx.legacy_files(spark, d).select(
        "file_id",
        cs.detect(content, "legacy").alias("shift_jis_first"),
        cs.detect(content, "legacy_euc").alias("then_euc_jp"),
    )


@query(
    fx.with_views(
        f"""SELECT file_id, {_ASCII.format(raw='raw')} AS ascii, {_UTF8.format(raw='raw')} AS utf8,
       {_full(cs.SJIS_SHAPED_TEXT).format(raw='raw')} AS shift_jis, {_full(cs.EUC_SHAPED_TEXT).format(raw='raw')} AS euc_jp
FROM legacy_files""",
        "legacy_files",
    )
)
def encoding_structural(spark: SparkSession, d: str) -> DataFrame:
    return en.encoding_structural(fx.legacy_files(spark, d))


@query(fx.with_views(f"SELECT file_id, {_MAGIC} AS file_type FROM legacy_files", "legacy_files"))
def magic_type(spark: SparkSession, d: str) -> DataFrame:
    return fx.legacy_files(spark, d).select("file_id", cs.magic_type(F.col("content")).alias("file_type"))


@query(fx.with_views("SELECT * FROM triage", "legacy_files", triage=_TRIAGE))
def classify_report_row(spark: SparkSession, d: str) -> DataFrame:
    return _triage(spark, d)


@query(
    fx.with_views(
        f"""SELECT file_id, path, CASE WHEN NOT ({_TESTS["Shift-JIS"].format(raw="raw")}) THEN 'not Shift-JIS' END AS error
FROM legacy_files""",
        "legacy_files",
    )
)
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return en.strict_errors(fx.legacy_files(spark, d))


# Half-width kana: what the bytes A1 to DF say in Shift-JIS.
_KANA_BYTES = "".join(map(chr, range(0xA1, 0xE0)))
_HALF_WIDTH = "".join(map(chr, range(0xFF61, 0xFFA0)))


@query(
    fx.with_views(
        f"""SELECT file_id, path, CASE WHEN has_nul THEN 'Binary' ELSE label END AS encoding,
       NOT has_nul AND label NOT IN ('ASCII', 'UTF-8', 'unknown') AS converted,
       CASE WHEN has_nul OR label = 'unknown' THEN NULL WHEN label = 'ISO-8859-1' THEN raw WHEN label = 'Windows-31J' THEN ascii_text || '①㈱' ELSE CASE kind
            WHEN 3 THEN text WHEN 2 THEN translate(raw, {quoted(_KANA_BYTES)}, {quoted(_HALF_WIDTH)}) WHEN 1 THEN kana ELSE raw END END AS text,
       CASE WHEN NOT has_nul AND label = 'unknown' THEN 'no known encoding' END AS error
FROM (SELECT *, {_NUL.format(raw="raw")} AS has_nul FROM legacy_files)""",
        "legacy_files",
    )
)
def to_utf8(spark: SparkSession, d: str) -> DataFrame:
    return en.to_utf8(fx.legacy_files(spark, d))


_RUN = re2(cs.SJIS_RUN)


@query(
    fx.with_views(
        f"""SELECT file_id, (n - 1)::INTEGER AS seq, run FROM (
SELECT file_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS n
FROM (SELECT file_id, regexp_extract_all(raw, {quoted(_RUN)}) AS runs FROM legacy_files))
WHERE length(run) > 3 AND {_TESTS["Shift-JIS"].format(raw="run")}""",
        "legacy_files",
    )
)
def sjis_runs(spark: SparkSession, d: str) -> DataFrame:
    return en.sjis_runs(fx.legacy_files(spark, d))


# Decoders for the check queries.  The operators ask the codecs; here a pair of bytes is turned into row and cell of the
# character set by arithmetic, and the set itself is read through another encoding of it.


def _character_set() -> str:
    cells = (bytes([0xA1 + row, 0xA1 + cell]) for row in range(94) for cell in range(94))
    return "".join(c.decode("euc_jp", "replace")[0] for c in cells)


def _sjis_text(chars: str) -> str:
    """Text of valid Shift-JIS bytes, given as one character each."""
    lead, trail = "unicode(u[1])", "unicode(u[2])"
    row = f"(({lead} - CASE WHEN {lead} >= 224 THEN 193 ELSE 129 END) * 2 + CASE WHEN {trail} >= 159 THEN 1 ELSE 0 END)"
    cell = f"(CASE WHEN {trail} >= 159 THEN {trail} - 159 WHEN {trail} >= 128 THEN {trail} - 65 ELSE {trail} - 64 END)"
    units = rf"regexp_extract_all({chars}, '(?s)[\x{{81}}-\x{{9f}}\x{{e0}}-\x{{ea}}].|[^\x{{81}}-\x{{9f}}\x{{e0}}-\x{{ea}}]+')"
    pair = f"unicode(u[1]) BETWEEN 129 AND 159 OR unicode(u[1]) BETWEEN 224 AND 234"
    return (
        f"array_to_string(list_transform({units}, lambda u: CASE WHEN {pair} THEN substring({quoted(_character_set())}, {row} * 94 + {cell} + 1, 1) "
        f"ELSE translate(u, {quoted(_KANA_BYTES)}, {quoted(_HALF_WIDTH)}) END), '')"
    )


@query(
    fx.with_views(
        f"""SELECT file_id, seq, CASE WHEN regexp_matches(run, '[^\\x00-\\x7f]') THEN {_sjis_text("run")} ELSE run END AS text FROM (
SELECT file_id, (n - 1)::INTEGER AS seq, run FROM (
SELECT file_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS n
FROM (SELECT file_id, regexp_extract_all(raw, {quoted(_RUN)}) AS runs FROM legacy_files))
WHERE length(run) > 3 AND {_TESTS["Shift-JIS"].format(raw="run")})""",
        "legacy_files",
    )
)
def sjis_strings(spark: SparkSession, d: str) -> DataFrame:
    return en.sjis_strings(fx.legacy_files(spark, d))


# Beside the pairs, this codec takes some single bytes that no text holds.
_CP932_TEXT = r"(?:[\x00-\x80\xa0-\xdf\xfd-\xff]|" + "|".join(f"[{lead}][{trail}]" for lead, trail in cs.WINDOWS_STRICT) + ")*"
_TRIAL_TESTS = {
    "shift_jis": _TESTS["Shift-JIS"],
    "cp932": _full(_CP932_TEXT),
    "euc_jp": _TESTS["EUC-JP"],
    "utf-8": _UTF8,
    "mac_roman": "true",
}


_CHUNKS = f"SELECT file_id, substring(raw, strpos(raw, 'TEXT') + 8, {cs.TRIAL_BYTES}) AS chunk FROM legacy_files WHERE contains(raw, 'TEXT')"
_CODECS = "(VALUES " + ", ".join(f"('{name}')" for name in _TRIAL_TESTS) + ") codecs(codec)"
# What the bytes from 0x80 say in Mac Roman.
MAC_ROMAN = (
    "ÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü†°¢£§•¶ß®©™´¨≠ÆØ∞±≤≥¥µ∂∑∏π∫ªºΩæø"
    "¿¡¬√ƒ≈∆«»…\xa0ÀÃÕŒœ–—“”‘’÷◊ÿŸ⁄€‹›ﬁﬂ‡·‚„‰ÂÊÁËÈÍÎÏÌÓÔ\uf8ffÒÚÛÙıˆ˜¯˘˙˚¸˝˛ˇ"
)
_HIGH_BYTES = "".join(map(chr, range(0x80, 0x100)))
_SAMPLES = {
    "shift_jis": _sjis_text("chunk"), "cp932": _sjis_text("chunk"), "mac_roman": f"translate(chunk, {quoted(_HIGH_BYTES)}, {quoted(MAC_ROMAN)})",
}
# A chunk that ends inside a pair is cut short; any other that is not valid is wrong.
_CUT_SHORT = {
    "shift_jis": re2(rf"(?:[\x00-\x7f\xa1-\xdf]|{cs._pairs(cs.SJIS_STRICT)})*[{cs.SJIS_LEAD}]"),
    "cp932": re2(rf"(?:[\x00-\x80\xa0-\xdf\xfd-\xff]|{cs._pairs(cs.WINDOWS_STRICT)})*[\x81-\x9f\xe0-\xfc]"),
    "euc_jp": re2(rf"(?:[\x00-\x7f]|{cs._pairs(cs.EUC_STRICT)})*[\x8e\x8f\xa1-\xfe]"),
}


def _trial_errors() -> str:
    """The chunks hold ASCII, half-width kana and pairs that begin with 0x82, which UTF-8 never begins with."""
    cases = " ".join(
        f"WHEN '{name}' THEN '{name}: ' || CASE WHEN regexp_full_match(chunk, {quoted(pattern)}) THEN 'incomplete' ELSE 'illegal' END || ' multibyte sequence'"
        for name, pattern in _CUT_SHORT.items()
    )
    return f"CASE codec {cases} WHEN 'utf-8' THEN 'utf-8: invalid start byte' END"


_OK = "CASE codec " + " ".join(f"WHEN '{name}' THEN {test.format(raw='chunk')}" for name, test in _TRIAL_TESTS.items()) + " END"


@query(
    fx.with_views(
        f"""SELECT file_id, codec, ok, CASE WHEN ok THEN substring(CASE codec {" ".join(f"WHEN '{n}' THEN {t}" for n, t in _SAMPLES.items())}
       ELSE chunk END, 1, {cs.TRIAL_SAMPLE}) END AS sample, CASE WHEN NOT ok THEN {_trial_errors()} END AS error
FROM (SELECT *, {_OK} AS ok FROM ({_CHUNKS}), {_CODECS})""",
        "legacy_files",
    )
)
def trial_decode_matrix(spark: SparkSession, d: str) -> DataFrame:
    return en.trial_decode_matrix(fx.legacy_files(spark, d))


@query(
    fx.with_views(f"SELECT file_id, codec, {_OK} AS ok, length(chunk)::INTEGER AS size FROM ({_CHUNKS}), {_CODECS}", "legacy_files")
)
def trial_decode_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which codec takes each chunk, and how long it is."""
    files = fx.legacy_files(spark, d)
    chunks = en.text_chunks(files).select("file_id", F.octet_length("chunk").alias("size"))
    return en.trial_decode_matrix(files).join(chunks, "file_id").select("file_id", "codec", "ok", "size")


def _uint(order: tuple[int, ...]) -> str:
    return " + ".join(f"unicode(substring(raw, tag + {4 + i}, 1))::BIGINT * {256**p}" for p, i in enumerate(order))


@query(
    fx.with_views(
        f"""SELECT file_id, CASE WHEN tag > 0 THEN (tag - 1)::INTEGER END AS "offset",
       CASE WHEN whole THEN {_uint((3, 2, 1, 0))} END AS big_endian, CASE WHEN whole THEN {_uint((0, 1, 2, 3))} END AS little_endian,
       CASE WHEN tag = 0 THEN 'no chunk' WHEN NOT whole THEN 'short chunk' END AS error
FROM (SELECT *, tag > 0 AND length(raw) >= tag + 7 AS whole FROM (SELECT *, strpos(raw, 'TEXT') AS tag FROM legacy_files))""",
        "legacy_files",
    )
)
def chunk_probe(spark: SparkSession, d: str) -> DataFrame:
    return en.chunk_probe(fx.legacy_files(spark, d))


# -- reports ------------------------------------------------------------------


@query(
    fx.with_views(
        """SELECT count(*)::BIGINT AS files, count(*) FILTER (is_archive)::BIGINT AS archives,
       count(*) FILTER (encoding = 'Shift-JIS')::BIGINT AS shift_jis, count(*) FILTER (is_binary)::BIGINT AS binary FROM triage""",
        "legacy_files", triage=_TRIAGE,
    )
)
def triage_summary(spark: SparkSession, d: str) -> DataFrame:
    return rp.triage_summary(_triage(spark, d))


def _count_sql(key: str) -> str:
    return f"SELECT {key}, count(*)::BIGINT AS files FROM triage WHERE is_binary GROUP BY {key}"


@query(fx.with_views(_count_sql("extension"), "legacy_files", triage=_TRIAGE))
def top_binary_extensions(spark: SparkSession, d: str) -> DataFrame:
    return rp.binary_extensions(_triage(spark, d))


@query(fx.with_views(_count_sql("file_type"), "legacy_files", triage=_TRIAGE))
def top_file_types(spark: SparkSession, d: str) -> DataFrame:
    return rp.binary_types(_triage(spark, d))


@query(
    fx.with_views(
        "SELECT extension, count(*)::BIGINT AS files FROM triage WHERE is_binary GROUP BY extension ORDER BY files DESC, extension LIMIT 20",
        "legacy_files", triage=_TRIAGE,
    )
)
def top_extensions(spark: SparkSession, d: str) -> DataFrame:
    return rp.top_k(rp.binary_extensions(_triage(spark, d)), "extension")


@query(
    fx.with_views(
        """SELECT lang || '|' || source AS k, count(*)::BIGINT AS files FROM documents GROUP BY ALL ORDER BY files DESC, k LIMIT 20"""
    )
)
def top_k(spark: SparkSession, d: str) -> DataFrame:
    groups = fx.table(spark, d, "documents").groupBy(F.concat("lang", F.lit("|"), "source").alias("k"))
    return rp.top_k(groups.agg(F.count("*").alias("files")), "k")


_ROWS_SQL = r"""SELECT 0 AS section, i AS rank, '' AS key, line FROM (SELECT unnest(['# Source Code Analysis Report', '', 'Total files analyzed: ' || files, '',
       '- RCS Files: ' || archives, '- Shift-JIS Files: ' || shift_jis, '- Binary Files: ' || binaries, '', '## File Details',
       '| File Path | RCS | Encoding | File Type | Error |', '| --- | --- | --- | --- | --- |']) AS line, unnest(range(11)) AS i
   FROM (SELECT (SELECT count(*) FROM legacy_files) AS files, count(*) FILTER (is_archive) AS archives, count(*) FILTER (encoding = 'Shift-JIS') AS shift_jis,
                count(*) FILTER (is_binary) AS binaries FROM seen))
UNION ALL SELECT 1, 0, path, '| ' || path || ' | ' || CASE WHEN is_archive THEN 'True' ELSE 'False' END || ' | ' || encoding || ' | ' || file_type || ' |  |' FROM seen
UNION ALL SELECT 1, 0, path, '| ' || path || ' | False | N/A | N/A | cannot be read |' FROM legacy_files WHERE file_id % 97 = 5
UNION ALL SELECT 2, i, '', line FROM (SELECT unnest(['', '# Binary File Analysis Report', '', 'Total Binary Files Found: ' || binaries, '', '## Top Binary Extensions',
       '| Extension | Count |', '| :--- | :--- |']) AS line, unnest(range(8)) AS i FROM (SELECT count(*) FILTER (is_binary) AS binaries FROM seen))
UNION ALL SELECT 3, -files, extension, '| ' || extension || ' | ' || files || ' |' FROM (SELECT extension, count(*) AS files FROM seen WHERE is_binary GROUP BY extension ORDER BY files DESC, extension LIMIT 20)
UNION ALL SELECT 4, i, '', line FROM (SELECT unnest(['', '## Top File Types', '| File Type Description | Count |', '| :--- | :--- |']) AS line, unnest(range(4)) AS i)
UNION ALL SELECT 5, -files, file_type, '| ' || replace(file_type, '|', '\|') || ' | ' || files || ' |' FROM (SELECT file_type, count(*) AS files FROM seen WHERE is_binary GROUP BY file_type ORDER BY files DESC, file_type LIMIT 20)"""


@query(
    fx.with_views(
        "SELECT row_number() OVER (ORDER BY section, rank, encode(key)) - 1 AS place, line FROM lines",
        "legacy_files", triage=_TRIAGE, seen="SELECT * FROM triage WHERE file_id % 97 <> 5", lines=_ROWS_SQL,
    )
)
def report_sink(spark: SparkSession, d: str) -> DataFrame:
    """The whole report, written and read back.  Some files cannot be read: they have an error and are not triaged."""
    files = fx.legacy_files(spark, d)
    read = files.filter("file_id % 97 <> 5")
    location = working_dir(spark, "report")
    rp.write_report(rp.compose(en.classify(read), ct.unreadable(files, read)), location)
    return rp.read_report(spark, location)


# -- modernisation ------------------------------------------------------------

_TARGETS = """SELECT a.file_id, a.path, a.path[:-3] AS target FROM tree_files a
WHERE a.path LIKE '%,v' AND {negate} EXISTS (SELECT 1 FROM tree_files t WHERE t.path = a.path[:-3])"""


@query(fx.with_views(_TARGETS.format(negate=""), "tree_files"))
def version_target_exists(spark: SparkSession, d: str) -> DataFrame:
    return md.with_target(fx.tree_files(spark, d)).select("file_id", "path", "target")


@query(fx.with_views(_TARGETS.format(negate="NOT"), "tree_files"))
def version_target_missing(spark: SparkSession, d: str) -> DataFrame:
    return md.without_target(fx.tree_files(spark, d)).select("file_id", "path", "target")


@query("SELECT doc_id AS file_id, '1.2' AS head, text AS head_text FROM documents")
def archive_head_text(spark: SparkSession, d: str) -> DataFrame:
    return md.head_text(fx.archive_files(spark, d)).select("file_id", "head", "head_text")


# Archives inside the source set are no real ones; those made for it are.
_PLAN = f"""SELECT file_id, path, 0 AS step, 'Converted' AS action, name || ' (' || label || ' -> UTF-8)' AS detail
FROM judged WHERE NOT archive AND NOT has_nul AND label NOT IN ('ASCII', 'UTF-8', 'unknown')
UNION ALL
SELECT file_id, path, 0, CASE WHEN present THEN 'Cleaned' WHEN made THEN 'Extracted' ELSE 'Failed' END,
       CASE WHEN made AND NOT present THEN name || ' -> ' || name[:-3] ELSE name END FROM judged WHERE archive
UNION ALL
SELECT file_id, path, 1, 'Deleted', name FROM judged WHERE archive AND made AND NOT present
UNION ALL
SELECT file_id, path, 2, 'Converted', name[:-3] || ' (' || label || ' -> UTF-8)'
FROM judged WHERE archive AND made AND NOT present AND label NOT IN ('ASCII', 'UTF-8', 'unknown')"""
_JUDGED = f"""SELECT p.*, p.path LIKE '%,v' AS archive, {FILENAME} AS name, {_NUL.format(raw="raw")} AS has_nul, p.path[:-3] IN (SELECT path FROM project) AS present
FROM project p"""
_PROJECT = f"""SELECT file_id, path, raw, label, false AS made FROM legacy_files UNION ALL
SELECT file_id + {fx.ARCHIVE_ID_BASE}, CASE WHEN file_id % 2 = 0 THEN '' ELSE 'old/' END || path || ',v', raw, label, true FROM legacy_files"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return md.modernize_plan(fx.project_files(spark, d))


@query(fx.with_views(_PLAN, "legacy_files", project=_PROJECT, judged=_JUDGED))
def modernize_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(
    fx.with_views(
        "SELECT action, count(*)::BIGINT AS entries FROM actions GROUP BY action",
        "legacy_files", project=_PROJECT, judged=_JUDGED, actions=_PLAN,
    )
)
def action_summary(spark: SparkSession, d: str) -> DataFrame:
    return rp.action_summary(_plan(spark, d))
