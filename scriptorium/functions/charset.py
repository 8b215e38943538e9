"""Byte-level encoding tests and conversion.

Tests run in the JVM on the Latin-1 view of the bytes (one character per byte).
Only text that really has to be converted goes to Python, through one pandas UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Byte ranges, written for use inside a regex class.
SJIS_LEAD = r"\x81-\x9f\xe0-\xea"
SJIS_TRAIL = r"\x40-\x7e\x80-\xfc"
SJIS_RUN_SINGLE = r"\x20-\x7e\xa1-\xdf"

# The double-byte positions that the strict Shift-JIS codec knows (lead class, trail class).
SJIS_STRICT = (
    (r"\x81", r"\x40-\x7e\x80-\xac\xb8-\xbf\xc8-\xce\xda-\xe8\xf0-\xf7\xfc"),
    (r"\x82", r"\x4f-\x58\x60-\x79\x81-\x9a\x9f-\xf1"),
    (r"\x83", r"\x40-\x7e\x80-\x96\x9f-\xb6\xbf-\xd6"),
    (r"\x84", r"\x40-\x60\x70-\x7e\x80-\x91\x9f-\xbe"),
    (r"\x88", r"\x9f-\xfc"),
    (r"\x89-\x97\x99-\x9f\xe0-\xe9", r"\x40-\x7e\x80-\xfc"),
    (r"\x98", r"\x40-\x72\x9f-\xfc"),
    (r"\xea", r"\x40-\x7e\x80-\xa4"),
)

# The same for strict EUC-JP, and for its three-byte plane behind 0x8F.
EUC_STRICT = (
    (r"\x8e", r"\xa1-\xdf"),
    (r"\xa1\xb0-\xce\xd0-\xf3", r"\xa1-\xfe"),
    (r"\xa2", r"\xa1-\xae\xba-\xc1\xca-\xd0\xdc-\xea\xf2-\xf9\xfe"),
    (r"\xa3", r"\xb0-\xb9\xc1-\xda\xe1-\xfa"),
    (r"\xa4", r"\xa1-\xf3"),
    (r"\xa5", r"\xa1-\xf6"),
    (r"\xa6", r"\xa1-\xb8\xc1-\xd8"),
    (r"\xa7", r"\xa1-\xc1\xd1-\xf1"),
    (r"\xa8", r"\xa1-\xc0"),
    (r"\xcf", r"\xa1-\xd3"),
    (r"\xf4", r"\xa1-\xa6"),
)
EUC_PLANE2 = (
    (r"\xa2", r"\xaf-\xb9\xc2-\xc4\xeb-\xf1"),
    (r"\xa6", r"\xe1-\xe5\xe7\xe9-\xea\xec\xf1-\xfc"),
    (r"\xa7", r"\xc2-\xce\xf2-\xfe"),
    (r"\xa9", r"\xa1-\xa2\xa4\xa6\xa8-\xa9\xab-\xad\xaf-\xb0\xc1-\xd0"),
    (r"\xaa", r"\xa1-\xb8\xba-\xf7"),
    (r"\xab", r"\xa1-\xbb\xbd-\xc3\xc5-\xf7"),
    (r"\xb0-\xec", r"\xa1-\xfe"),
    (r"\xed", r"\xa1-\xe3"),
)

# The double-byte positions that the Windows-31J codec knows.
WINDOWS_STRICT = (
    (r"\x81", r"\x40-\x7e\x80-\xac\xb8-\xbf\xc8-\xce\xda-\xe8\xf0-\xf7\xfc"),
    (r"\x82", r"\x4f-\x58\x60-\x79\x81-\x9a\x9f-\xf1"),
    (r"\x83", r"\x40-\x7e\x80-\x96\x9f-\xb6\xbf-\xd6"),
    (r"\x84", r"\x40-\x60\x70-\x7e\x80-\x91\x9f-\xbe"),
    (r"\x87", r"\x40-\x5d\x5f-\x75\x7e\x80-\x9c"),
    (r"\x88", r"\x9f-\xfc"),
    (r"\x89-\x97\x99-\x9f\xe0-\xe9\xed\xf0-\xfb", r"\x40-\x7e\x80-\xfc"),
    (r"\x98", r"\x40-\x72\x9f-\xfc"),
    (r"\xea", r"\x40-\x7e\x80-\xa4"),
    (r"\xee", r"\x40-\x7e\x80-\xec\xef-\xfc"),
    (r"\xfc", r"\x40-\x4b"),
)

#: Label of what no encoding takes; such content is left as it is.
UNKNOWN = "unknown"

# Label of each encoding and the Python codec behind it.
CODECS = {
    "ASCII": "ascii",
    "UTF-8": "utf-8",
    "Shift-JIS": "shift_jis",
    "EUC-JP": "euc_jp",
    "Windows-31J": "cp932",
    "ISO-8859-1": "iso-8859-1",
}

# Codecs of the trial matrix, its chunk size and its sample size.
TRIAL_CODECS = ("shift_jis", "cp932", "euc_jp", "utf-8", "mac_roman")
TRIAL_BYTES = 2000
TRIAL_SAMPLE = 200

# How much the reading rules look at.
HEADER_BYTES = 1024
READ_CAP_BYTES = 1_000_000
DETECTOR_BYTES = (10_000, 20_000)

#: Orders in which encodings are tried.  "legacy" and "legacy_euc" give the labels of
#: the older tools, which take accented UTF-8 for half-width kana.
_LAST = ("Windows-31J", "ISO-8859-1")
ORDERS = {
    "utf8_first": ("ASCII", "UTF-8", "Shift-JIS", "EUC-JP", *_LAST),
    "legacy": ("ASCII", "Shift-JIS", "UTF-8", "EUC-JP", *_LAST),
    "legacy_euc": ("ASCII", "Shift-JIS", "EUC-JP", "UTF-8", *_LAST),
}


def _pairs(table: tuple[tuple[str, str], ...]) -> str:
    return "|".join(f"[{lead}][{trail}]" for lead, trail in table)


SJIS_STRICT_TEXT = rf"(?:[\x00-\x7f\xa1-\xdf]++|{_pairs(SJIS_STRICT)})*+"
EUC_STRICT_TEXT = rf"(?:[\x00-\x7f]++|{_pairs(EUC_STRICT)}|\x8f(?:{_pairs(EUC_PLANE2)}))*+"
WINDOWS_STRICT_TEXT = rf"(?:[\x00-\x7f\xa1-\xdf]++|{_pairs(WINDOWS_STRICT)})*+"
#: Western text: letters and signs, but none of the control characters that noise is full of.
LATIN1_TEXT = r"[\t\n\f\r\x20-\x7e\xa0-\xff]*+"
SJIS_SHAPED_TEXT = rf"(?:[\x00-\x7f\xa1-\xdf]++|[{SJIS_LEAD}][{SJIS_TRAIL}])*+"
EUC_SHAPED_TEXT = r"(?:[\x00-\x7f]++|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe][\xa1-\xfe]|[\xa1-\xfe][\xa1-\xfe])*+"
SJIS_RUN = rf"(?:[{SJIS_LEAD}][{SJIS_TRAIL}]|[{SJIS_RUN_SINGLE}])++"


def latin1(content: Column) -> Column:
    """The bytes as a string of one character each."""
    return F.decode(content, "ISO-8859-1")


def bytes_of_latin1(chars: Column) -> Column:
    return F.encode(chars, "ISO-8859-1")


def _whole(chars: Column, pattern: str) -> Column:
    return chars.rlike(rf"\A{pattern}\z")


def is_ascii(content: Column) -> Column:
    """No byte above 0x7F: only then has valid UTF-8 as many characters as bytes."""
    as_text = content.cast("string")
    return F.is_valid_utf8(as_text) & (F.char_length(as_text) == F.octet_length(content))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def is_shift_jis(chars: Column) -> Column:
    """Whether the strict codec would take these bytes, given as :func:`latin1`."""
    return _whole(chars, SJIS_STRICT_TEXT)


def is_euc_jp(chars: Column) -> Column:
    return _whole(chars, EUC_STRICT_TEXT)


def is_windows_31j(chars: Column) -> Column:
    return _whole(chars, WINDOWS_STRICT_TEXT)


def is_latin1_text(chars: Column) -> Column:
    return _whole(chars, LATIN1_TEXT)


def is_shift_jis_shaped(chars: Column) -> Column:
    """Lead and trail bytes pair up, whether or not each pair is assigned."""
    return _whole(chars, SJIS_SHAPED_TEXT)


def is_euc_jp_shaped(chars: Column) -> Column:
    return _whole(chars, EUC_SHAPED_TEXT)


def has_nul(content: Column) -> Column:
    return F.contains(content, F.lit(b"\x00"))


def header(content: Column, size: int = HEADER_BYTES) -> Column:
    return F.substring(content, 1, size)


def detect(content: Column, order: str = "utf8_first") -> Column:
    """Label of the first encoding of ``order`` that takes every byte, ``unknown`` if none does.

    The tests stand in one ``CASE``, so a text stops at its first hit and ASCII and
    UTF-8, the common case, never reach the byte-pair patterns.
    """
    chars = latin1(content)
    tests = {
        "ASCII": is_ascii(content),
        "UTF-8": is_utf8(content),
        "Shift-JIS": is_shift_jis(chars),
        "EUC-JP": is_euc_jp(chars),
        "Windows-31J": is_windows_31j(chars),
        "ISO-8859-1": is_latin1_text(chars),
    }
    first, *others = ORDERS[order]
    label = F.when(tests[first], first)
    for name in others:
        label = label.when(tests[name], name)
    return label.when(content.isNotNull(), UNKNOWN)


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_DECODED)
def decode_bytes(content: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """Text of each value by its codec, or why it cannot be read; nulls pass through."""
    texts, errors = [], []
    for value, name in zip(content, codec):
        text = error = None
        if value is not None and name is not None:
            try:
                text = bytes(value).decode(name)
            except UnicodeDecodeError as failure:
                error = f"{failure.encoding}: {failure.reason}"
        texts.append(text)
        errors.append(error)
    return pd.DataFrame({"text": texts, "error": errors}, dtype=object)


def codec_of(label: Column) -> Column:
    pairs = [F.lit(part) for pair in CODECS.items() for part in pair]
    return F.create_map(*pairs)[label]


def needs_codec(label: Column) -> Column:
    return label.isin("Shift-JIS", "EUC-JP", "Windows-31J")


def plain_text(content: Column, label: Column) -> Column:
    """Text of ASCII, UTF-8 and Latin-1 content without leaving the JVM; null for the others."""
    return F.when(label == "ISO-8859-1", latin1(content)).when(
        label.isin("ASCII", "UTF-8"), F.try_validate_utf8(content.cast("string"))
    )


# -- file signatures ----------------------------------------------------------

# Fixed values: (first bytes in hex, description).
SIGNATURES = (
    ("7F454C46", "ELF"),
    ("89504E470D0A1A0A", "PNG image data"),
    ("47494638", "GIF image data"),
    ("474946383961", "GIF image data, version 89a"),
    ("FFD8FF", "JPEG image data"),
    ("504B0304", "Zip archive data"),
    ("1F8B", "gzip compressed data"),
    ("25504446", "PDF document"),
    ("4D5A", "MS-DOS executable"),
    ("0000000E54455854", "word processor text"),
)
UNKNOWN_TYPE = "data"


def magic_type(content: Column) -> Column:
    """Description behind the longest signature that the content starts with."""
    head = F.hex(F.substring(content, 1, max(len(sig) for sig, _ in SIGNATURES) // 2))
    found = F.when(F.lit(False), F.lit(""))
    for sig, description in sorted(SIGNATURES, key=lambda item: -len(item[0])):
        found = found.when(head.startswith(sig), description)
    return found.otherwise(UNKNOWN_TYPE)
