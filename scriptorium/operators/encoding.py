"""Triage of raw bytes and conversion to UTF-8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import charset as cs, paths as px

BINARY, TEXT = "Binary", "Text"


def bounded_prefix(files: DataFrame, sizes: tuple[int, ...] = (cs.HEADER_BYTES, *cs.DETECTOR_BYTES, cs.READ_CAP_BYTES)) -> DataFrame:
    """The first bytes of each content at several caps: ``file_id, cap, kept, digest``.

    A binary file is always read whole; filter on ``length`` beforehand to skip huge ones.
    """
    caps = F.array(*[F.lit(s) for s in sizes])
    return (
        files.select("file_id", "content", F.explode(caps).alias("cap"))
        .withColumn("head", F.substring(F.col("content"), F.lit(1), F.col("cap")))
        .select("file_id", "cap", F.octet_length("head").alias("kept"), F.md5("head").alias("digest"))
    )


def is_binary(files: DataFrame) -> DataFrame:
    return files.select(
        "file_id",
        cs.has_nul(F.col("content")).alias("nul_anywhere"),
        cs.has_nul(cs.header(F.col("content"))).alias("nul_in_header"),
    )


def encoding_strict(files: DataFrame, order: str = "utf8_first") -> DataFrame:
    return files.select("file_id", cs.detect(F.col("content"), order).alias("encoding"))


def encoding_structural(files: DataFrame) -> DataFrame:
    """Which encodings the byte structure allows."""
    chars = cs.latin1(F.col("content"))
    return files.select(
        "file_id",
        cs.is_ascii(F.col("content")).alias("ascii"),
        cs.is_utf8(F.col("content")).alias("utf8"),
        cs.is_shift_jis_shaped(chars).alias("shift_jis"),
        cs.is_euc_jp_shaped(chars).alias("euc_jp"),
    )


def classify(files: DataFrame, order: str = "utf8_first") -> DataFrame:
    """One triage row per file: ``file_id, path, is_archive, is_binary, file_type, encoding, extension``."""
    binary = cs.has_nul(F.col("content"))
    return files.select(
        "file_id",
        "path",
        px.is_archive(F.col("path")).alias("is_archive"),
        binary.alias("is_binary"),
        F.when(binary, cs.magic_type(F.col("content"))).otherwise(TEXT).alias("file_type"),
        F.when(binary, BINARY).otherwise(cs.detect(F.col("content"), order)).alias("encoding"),
        px.extension(F.col("path")).alias("extension"),
    )


def decode_with(files: DataFrame, label: Column) -> DataFrame:
    """Adds ``encoding, text, error``; only double-byte content goes through Python.  Unknown content has no text and an error."""
    labelled = files.withColumn("encoding", label)
    needs = cs.needs_codec(F.col("encoding"))
    decoded = labelled.withColumn(
        "decoded", cs.decode_bytes(F.when(needs, F.col("content")), F.when(needs, cs.codec_of(F.col("encoding"))))
    )
    return decoded.withColumn(
        "text", F.when(needs, F.col("decoded.text")).otherwise(cs.plain_text(F.col("content"), F.col("encoding")))
    ).withColumn("error", F.when(F.col("encoding") == cs.UNKNOWN, "no known encoding").otherwise(F.col("decoded.error"))).drop("decoded")


def to_utf8(files: DataFrame, order: str = "utf8_first") -> DataFrame:
    """``file_id, path, encoding, converted, text, error``.  Valid UTF-8 is never touched.

    A NUL anywhere means hands off, and so does content that no encoding takes; the latter has an error.  A legacy order only changes the label reported:
    valid UTF-8 keeps its text even where that order calls it Shift-JIS.
    """
    content = F.col("content")
    binary = cs.has_nul(content)
    label = F.when(binary, BINARY).otherwise(cs.detect(content, order))
    acted = label if order == "utf8_first" else F.when(~binary & cs.is_utf8(content), "UTF-8").otherwise(label)
    done = decode_with(files.withColumn("label", label), acted)
    return done.select(
        "file_id",
        "path",
        F.col("label").alias("encoding"),
        (~F.col("encoding").isin("ASCII", "UTF-8", BINARY, cs.UNKNOWN)).alias("converted"),
        "text",
        "error",
    )


def strict_errors(files: DataFrame, label: str = "Shift-JIS") -> DataFrame:
    """Every file read as ``label``; those that cannot be get an error row and the rest go on."""
    chars = cs.latin1(F.col("content"))
    valid = {
        "ASCII": cs.is_ascii(F.col("content")),
        "UTF-8": cs.is_utf8(F.col("content")),
        "Shift-JIS": cs.is_shift_jis(chars),
        "EUC-JP": cs.is_euc_jp(chars),
        "Windows-31J": cs.is_windows_31j(chars),
    }[label]
    return files.select(
        "file_id", "path", F.when(~valid, F.lit(f"not {label}")).alias("error")
    )


def sjis_runs(files: DataFrame, longer_than: int = 3) -> DataFrame:
    """Runs of Shift-JIS bytes that the strict codec takes: ``file_id, seq, run`` (Latin-1 view)."""
    runs = F.regexp_extract_all(cs.latin1(F.col("content")), F.lit(cs.SJIS_RUN), F.lit(0))
    return (
        files.select("file_id", F.posexplode(runs).alias("seq", "run"))
        .filter((F.length("run") > longer_than) & cs.is_shift_jis(F.col("run")))
    )


def sjis_strings(files: DataFrame, longer_than: int = 3) -> DataFrame:
    """Text of the runs.  ASCII runs are text already; the codec sees the others only."""
    runs = sjis_runs(files, longer_than)
    foreign = F.col("run").rlike(r"[^\x00-\x7f]")
    decoded = runs.withColumn(
        "d", cs.decode_bytes(F.when(foreign, cs.bytes_of_latin1(F.col("run"))), F.when(foreign, F.lit("shift_jis")))
    )
    return decoded.select("file_id", "seq", F.coalesce("d.text", "run").alias("text"))


# Fixed value: tag of the text chunk.
CHUNK_TAG = b"TEXT"


def chunk_probe(files: DataFrame) -> DataFrame:
    """First text chunk: ``file_id, offset, big_endian, little_endian, error``."""
    at = F.instr(cs.latin1(F.col("content")), CHUNK_TAG.decode())
    size = F.hex(F.substring(F.col("content"), F.col("at") + len(CHUNK_TAG), F.lit(4)))
    backwards = F.concat(*[F.substring(F.col("size"), i, 2) for i in (7, 5, 3, 1)])
    whole = F.length("size") == 8
    return (
        files.select("file_id", "content", at.alias("at"))
        .withColumn("size", size)
        .select(
            "file_id",
            F.when(F.col("at") > 0, F.col("at") - 1).alias("offset"),
            F.when((F.col("at") > 0) & whole, F.conv("size", 16, 10).cast("long")).alias("big_endian"),
            F.when((F.col("at") > 0) & whole, F.conv(backwards, 16, 10).cast("long")).alias("little_endian"),
            F.when(F.col("at") == 0, "no chunk").when(~whole, "short chunk").alias("error"),
        )
    )


def text_chunks(files: DataFrame) -> DataFrame:
    """``file_id, chunk``: the bytes behind the header of the first text chunk."""
    at = F.instr(cs.latin1(F.col("content")), CHUNK_TAG.decode())
    return files.select("file_id", "content", at.alias("at")).filter("at > 0").select(
        "file_id",
        F.substring(F.col("content"), F.col("at") + len(CHUNK_TAG) + 4, F.lit(cs.TRIAL_BYTES)).alias("chunk"),
    )


def trial_decode_matrix(files: DataFrame) -> DataFrame:
    """The chunk of each file under each codec: ``file_id, codec, ok, sample, error``."""
    tries = text_chunks(files).withColumn("codec", F.explode(F.array(*[F.lit(c) for c in cs.TRIAL_CODECS])))
    return tries.withColumn("d", cs.decode_bytes(F.col("chunk"), F.col("codec"))).select(
        "file_id",
        "codec",
        F.col("d.error").isNull().alias("ok"),
        F.substring("d.text", 1, cs.TRIAL_SAMPLE).alias("sample"),
        "d.error",
    )
