"""Byte tests against the codecs themselves."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import charset as cs, text as tx
from scriptorium.operators import encoding as en, modernize as md


def decodes(value, codec):
    try:
        value.decode(codec)
        return True
    except UnicodeDecodeError:
        return False


def fits(value, label):
    """Whether content is taken for ``label``: what its codec takes, without signs that no text holds."""
    if not decodes(value, cs.CODECS[label]):
        return False
    if label == "Windows-31J":
        return not set(value.decode("cp932")) & set("\x80\xa0\uf8f0\uf8f1\uf8f2\uf8f3")
    return label != "ISO-8859-1" or all(b >= 0xA0 or 0x20 <= b < 0x7F or b in b"\t\n\f\r" for b in value)


@pytest.fixture(scope="module")
def every_pair(spark):
    """All byte strings of two bytes, and all of three that EUC-JP has."""
    values = [bytes([a, b]) for a in range(256) for b in range(256)]
    values += [bytes([0x8F, a, b]) for a in range(0xA0, 256) for b in range(0xA0, 256)]
    return spark.createDataFrame([(v,) for v in values], "content binary").repartition(8)


@pytest.mark.parametrize("codec, test", [("shift_jis", cs.is_shift_jis), ("euc_jp", cs.is_euc_jp)])
def test_strict_double_byte(every_pair, codec, test):
    rows = every_pair.select("content", test(cs.latin1(F.col("content"))).alias("ok")).collect()
    assert [bytes(r.content) for r in rows if r.ok != decodes(bytes(r.content), codec)] == []


def test_windows_pairs(every_pair):
    rows = every_pair.select("content", cs.is_windows_31j(cs.latin1(F.col("content"))).alias("ok")).collect()
    assert [bytes(r.content) for r in rows if r.ok != fits(bytes(r.content), "Windows-31J")] == []


def test_noise_stays_as_it_is(spark):
    """Signs of Windows-31J are read; what fits nothing, or has a NUL anywhere, is left alone."""
    values = ["①㈱".encode("cp932"), b"a\x81\xad\xfd\x80", "é !".encode("latin-1"), b"x" * 1024 + b"\x00", b"\x82", b"", None]
    files = spark.createDataFrame([(n, f"f{n}", v) for n, v in enumerate(values)], "file_id long, path string, content binary")
    rows = {r.file_id: (r.encoding, r.converted, r.text, r.error) for r in en.to_utf8(files).collect()}
    assert rows == {
        0: ("Windows-31J", True, "①㈱", None), 1: ("unknown", False, None, "no known encoding"), 2: ("ISO-8859-1", True, "é !", None),
        3: ("Binary", False, None, None), 4: ("unknown", False, None, "no known encoding"), 5: ("ASCII", False, "", None), 6: (None, None, None, None),
    }
    plan = md.modernize_plan(files)
    assert sorted((r.file_id, r.detail) for r in plan.collect()) == [(0, "f0 (Windows-31J -> UTF-8)"), (2, "f2 (ISO-8859-1 -> UTF-8)")]


def random_bytes(count, seed=5):
    rng = random.Random(seed)
    kinds = [b"a", b"TEXT", b"\x82\xa0", b"\xa4\xa2", "é".encode(), "漢".encode(), b"\x82", b"\xe3\x81", b"\x00", b"\n", b"\r\n", b"\r", b"\xf0\x9f", b"\xed\xa0\x80"]
    return [b"".join(rng.choice(kinds) for _ in range(rng.randrange(12))) for _ in range(count)]


@pytest.fixture(scope="module")
def noise(spark):
    values = random_bytes(2000)
    rows = [(n, f"f{n}", v) for n, v in enumerate(values)]
    return values, spark.createDataFrame(rows, "file_id long, path string, content binary").repartition(8)


@pytest.mark.parametrize("order", list(cs.ORDERS))
def test_detection(noise, order):
    values, files = noise
    for row in en.encoding_strict(files, order).collect():
        tried = cs.ORDERS[order]
        assert row.encoding == next((label for label in tried if fits(values[row.file_id], label)), cs.UNKNOWN)


def test_replacing_reader(noise):
    values, files = noise
    for row in files.select("file_id", tx.text_from_bytes(F.col("content")).alias("text")).collect():
        expected = values[row.file_id].decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        assert row.text == expected


def test_conversion_is_idempotent(spark, noise):
    values, files = noise
    once = en.to_utf8(files).filter("text IS NOT NULL")
    for row in once.collect():
        assert row.text == values[row.file_id].decode(cs.CODECS[row.encoding])
        assert row.error is None
    again = en.to_utf8(once.select("file_id", "path", F.encode("text", "UTF-8").alias("content")))
    assert again.filter("converted").count() == 0
    assert again.join(once.select("file_id", F.col("text").alias("was")), "file_id").filter("text <> was").count() == 0


def test_legacy_order_keeps_valid_utf8(noise):
    values, files = noise
    for row in en.to_utf8(files, "legacy").filter("text IS NOT NULL").collect():
        if decodes(values[row.file_id], "utf-8"):
            assert row.text == values[row.file_id].decode() and not row.converted


def strings_of(data):
    """Runs of Shift-JIS bytes, one byte at a time."""
    runs, run, at = [], b"", 0
    while at < len(data):
        one, pair = data[at], data[at : at + 2]
        lead = 0x81 <= one <= 0x9F or 0xE0 <= one <= 0xEA
        if lead and len(pair) == 2 and (0x40 <= pair[1] <= 0x7E or 0x80 <= pair[1] <= 0xFC):
            run, at = run + pair, at + 2
        elif 0x20 <= one <= 0x7E or 0xA1 <= one <= 0xDF:
            run, at = run + data[at : at + 1], at + 1
        else:
            runs, run, at = runs + [run], b"", at + 1
    return [r.decode("shift_jis") for r in runs + [run] if len(r) > 3 and decodes(r, "shift_jis")]


def test_strings_in_binaries(noise):
    values, files = noise
    found = {}
    for row in en.sjis_strings(files).collect():
        found.setdefault(row.file_id, []).append((row.seq, row.text))
    for number, value in enumerate(values):
        assert [text for _, text in sorted(found.get(number, []))] == strings_of(value)


def test_chunks_and_trials(noise):
    values, files = noise
    probed = {r.file_id: r for r in en.chunk_probe(files).collect()}
    tried = {(r.file_id, r.codec): r for r in en.trial_decode_matrix(files).collect()}
    for number, value in enumerate(values):
        at = value.find(b"TEXT")
        row = probed[number]
        if at < 0:
            assert row.error == "no chunk" and (number, "utf-8") not in tried
            continue
        size = value[at + 4 : at + 8]
        assert row.offset == at
        if len(size) < 4:
            assert row.error == "short chunk"
        else:
            assert (row.big_endian, row.little_endian) == (struct.unpack(">I", size)[0], struct.unpack("<I", size)[0])
        chunk = value[at + 8 : at + 8 + cs.TRIAL_BYTES]
        for codec in cs.TRIAL_CODECS:
            row = tried[number, codec]
            assert row.ok == decodes(chunk, codec)
            assert row.sample == (chunk.decode(codec)[: cs.TRIAL_SAMPLE] if row.ok else None)


def test_longest_signature(spark):
    values = [b"GIF89a..", b"GIF87a", b"\x7fELF", b"PK\x03\x04", b"", b"\x1f\x8b\x08"]
    rows = spark.createDataFrame([(v,) for v in values], "content binary").select(cs.magic_type(F.col("content"))).collect()
    assert [r[0] for r in rows] == [
        "GIF image data, version 89a", "GIF image data", "ELF", "Zip archive data", "data", "gzip compressed data",
    ]
