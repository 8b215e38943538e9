"""Text column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters that Python's ``str.strip`` removes.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)

# Character ranges, written for use inside a regex class.
JAPANESE = "\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff"
ACCENTED_LATIN = "\u00c0-\u00ff"

# Characters that end a sentence (ideographic and full-width forms too).
SENTENCE_END = "\u3002\uff0e.!?\uff01\uff1f"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Trim Unicode whitespace (the ideographic space too) from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


# What ends a line, in every text that is read.
LINE_BREAK = "\r\n|\r|\n"


def normalise_newlines(col: Column) -> Column:
    """Lines as every operator counts them: ``\\r\\n`` and a lone ``\\r`` become ``\\n``.  Most texts hold no ``\\r`` and stay untouched."""
    return F.when(F.contains(col, F.lit("\r")), F.regexp_replace(col, "\r\n?", "\n")).otherwise(col)


def line_break(col: Column) -> Column:
    """The first line break of a text, which is the style it is written back in; ``\\n`` if it has none."""
    first = F.regexp_extract(col, f"({LINE_BREAK})", 1)
    return F.when(F.contains(col, F.lit("\r")) & (first != ""), first).otherwise(F.lit("\n"))


def in_style(col: Column, style: Column) -> Column:
    """A text of ``\\n`` lines with the line breaks of ``style``."""
    return F.when(style == "\n", col).otherwise(F.replace(col, F.lit("\n"), style))


def text_from_bytes(content: Column) -> Column:
    """UTF-8 text of ``content``; malformed bytes become U+FFFD, newlines become ``\\n``."""
    return normalise_newlines(F.make_valid_utf8(content.cast("string")))


def contains_script(col: Column, ranges: str = JAPANESE) -> Column:
    return col.rlike(f"[{ranges}]")


def newline_count(col: Column) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n"), F.lit("")))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line holding the 0-based character ``offset`` of a text as it is stored.

    A break belongs to the line it ends; the two characters of ``\\r\\n`` are one break.
    """
    before = F.substring(text, F.lit(1), offset)
    plain = newline_count(before)
    breaks = F.regexp_count(before, F.lit(f"(?:{LINE_BREAK})"))
    inside = before.endswith("\r") & (F.substring(text, offset + 1, F.lit(1)) == "\n")
    return F.when(F.contains(before, F.lit("\r")), breaks - F.when(inside, 1).otherwise(0)).otherwise(plain) + 1


def split_lines(col: Column) -> Column:
    """Lines of ``col``; a final newline ends the last line and opens no new one."""
    return F.split(F.regexp_replace(col, "\n\\z", ""), "\n")


def number_lines(col: Column, prepare: Callable[[Column], Column] = lambda line: line) -> Column:
    """Put ``<line>:`` in front of each line, so that a later regex match knows where it is.

    Exactly one mark follows every newline and it holds digits only, so it can be
    taken out again whatever the text is (:func:`unnumber_lines`).
    """
    return F.array_join(
        F.transform(F.split(col, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(":"), prepare(line))),
        "\n",
    )


def unnumber_lines(col: Column) -> Column:
    return F.regexp_replace(col, "\n[0-9]++:", "\n")
