"""The annotation blob: file-level text, ``@lines``, then ``# <line>`` blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scriptorium.functions import text as tx

# Fixed values of the blob format.
LINES_MARK = "@lines"
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A number of more digits is no line number; such a line stays text of the note it is in.
LINE_DIGITS = 18
_HEADING = rf"(?md)^#{_SPACE}*+([0-9]{{1,{LINE_DIGITS}}}+)(?![0-9]){_SPACE}*+"
NOTES = "array<struct<line:bigint,note:string>>"


def file_note(blob: Column) -> Column:
    """The part before ``@lines``; a blob without that mark is one file note."""
    mark = F.instr(blob, LINES_MARK)
    return F.when(F.coalesce(blob, F.lit("")) == "", F.lit("")).otherwise(
        F.when(mark > 0, tx.strip(F.substring(blob, F.lit(1), mark - 1))).otherwise(blob)
    )


def line_notes(blob: Column) -> Column:
    """``array<struct<line, note>>`` by line; of several notes on one line the last counts."""

    def parsed(part: Column) -> Column:
        numbers = F.regexp_extract_all(part, F.lit(_HEADING), F.lit(1))
        pieces = F.split(part, _HEADING)
        return F.transform(
            F.arrays_zip(numbers.alias("n"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("t")),
            lambda item, i: F.struct(item["n"].cast("bigint").alias("line"), i.alias("rank"), tx.strip(item["t"]).alias("note")),
        )

    def lines(text: Column) -> Column:
        mark = F.instr(text, LINES_MARK)
        part = F.when(mark > 0, tx.strip(F.substring(text, mark + len(LINES_MARK), F.length(text)))).otherwise("")
        return last_of_lines(F.filter(tx.bound(part, parsed), lambda n: n["note"] != ""))

    return tx.bound(blob, lines)


def ranked(notes: Column, rank: int) -> Column:
    """``notes`` with the rank that ``last_of_lines`` goes by."""
    return F.transform(
        F.coalesce(notes, F.array().cast(NOTES)),
        lambda n: F.struct(n["line"].alias("line"), F.lit(rank).alias("rank"), n["note"].alias("note")),
    )


def last_of_lines(notes: Column) -> Column:
    """Of ``array<struct<line, rank, note>>`` the note of the highest rank of each line, by line."""

    def last(by_line: Column) -> Column:
        kept = F.filter(by_line, lambda n, i: ~F.get(by_line, i + 1)["line"].eqNullSafe(n["line"]))
        return F.transform(kept, lambda n: F.struct(n["line"].alias("line"), n["note"].alias("note")))

    return tx.bound(F.array_sort(notes), last)


def rebuild(global_note: Column, notes: Column) -> Column:
    """Blob of a file note and ``array<struct<line, note>>``."""

    def lines(of: Column) -> Column:
        shown = F.transform(F.array_sort(of), lambda n: F.struct(n["line"].alias("line"), tx.strip(n["note"]).alias("note")))
        blocks = F.transform(
            F.filter(shown, lambda n: n["note"] != ""),
            lambda n: F.concat(F.lit("# "), n["line"].cast("string"), F.lit("\n"), n["note"], F.lit("\n")),
        )
        return F.when(F.size(of) > 0, F.concat(F.lit(LINES_MARK + "\n"), F.array_join(blocks, ""))).otherwise("")

    return tx.strip(
        F.concat(
            tx.strip(F.coalesce(global_note, F.lit(""))),
            F.lit("\n\n"),
            tx.bound(F.coalesce(notes, F.array().cast(NOTES)), lines),
        )
    )


def merge_note(old: Column, new: Column) -> Column:
    """Append ``new`` below ``old`` unless it already says so."""
    return F.when(old.isNull(), new).when(new.isNull() | F.contains(old, new), old).otherwise(
        F.concat(old, F.lit("\n\n"), new)
    )


def merge_notes(old: Column, new: Column) -> Column:
    """``old`` notes with ``new`` (``array<struct<line, notes>>``, each line once) appended line by line.

    Both are put into one list by line, in which what is new stands behind what was there: one pass joins neighbours.
    """
    none = F.array().cast("array<string>")
    was = F.transform(old, lambda n: F.struct(
        n["line"].alias("line"), F.lit(0).alias("rank"), n["note"].alias("note"), none.alias("more")
    ))
    more = F.transform(new, lambda n: F.struct(
        n["line"].alias("line"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("note"), n["notes"].alias("more")
    ))
    same = lambda a, b: a["line"].eqNullSafe(b["line"])

    def joined(by_line: Column) -> Column:
        kept = F.transform(by_line, lambda n, i: F.struct(
            n["line"].alias("line"),
            F.aggregate(n["more"], F.when(same(F.get(by_line, i - 1), n), F.get(by_line, i - 1)["note"]).otherwise(n["note"]), merge_note).alias("note"),
            (~same(F.get(by_line, i + 1), n)).alias("last"),
        ))
        return F.transform(F.filter(kept, lambda n: n["last"]), lambda n: F.struct(n["line"].alias("line"), n["note"].alias("note")))

    return tx.bound(F.array_sort(F.concat(was, more)), joined)
