"""Segments of file texts.  All of it is narrow: one scan, no shuffle.

Every operator reads a text by the same lines, ended by ``\\n``, ``\\r\\n`` or a lone ``\\r``; pieces show each break as ``\\n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import lexer as lx, paths as px, text as tx
from scriptorium.session import stored

_ITEMS = "array<struct<line:int,text:string>>"


def _read() -> Column:
    return tx.normalise_newlines(F.col("text"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``file_id, line, text`` of every line, blank ones too."""
    return files.select("file_id", F.posexplode(tx.split_lines(_read())).alias("pos", "text")).select("file_id", (F.col("pos") + 1).alias("line"), "text")


def line_segments(files: DataFrame, ranges: str | None = tx.JAPANESE) -> DataFrame:
    """Stripped non-blank lines, by default those in the script."""
    return _exploded(files, lx.stripped_lines(_read()), ranges)


def sentence_segments(files: DataFrame, ranges: str | None = tx.JAPANESE) -> DataFrame:
    """Lines joined to sentences, with the line each one starts on."""
    return _exploded(files, lx.sentences(_read()), ranges)


def _exploded(files: DataFrame, items, ranges: str | None) -> DataFrame:
    """``file_id, seq, line, text``, where ``seq`` is the place among all items of the file."""
    found = files.select("file_id", F.posexplode(items).alias("seq", "item")).select(
        "file_id", "seq", "item.line", "item.text"
    )
    return found if ranges is None else found.filter(tx.contains_script(F.col("text"), ranges))


def code_tokens(files: DataFrame) -> DataFrame:
    """``file_id, seq, type, raw``: code, literals and comments; joined in order they are the text as read."""
    return files.select("file_id", F.posexplode(lx.tokens(_read())).alias("seq", "raw")).select(
        "file_id", "seq", lx.token_type(F.col("raw")).alias("type"), "raw"
    )


def segments_by_type(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("type").agg(
        F.count("*").alias("segments"), F.sum(F.length("raw").cast("long")).alias("characters")
    )


def _with_pieces(files: DataFrame, char_literals: bool = True) -> DataFrame:
    text = _read()
    return files.select(
        "file_id", lx.tokens(text, char_literals).alias("pieces"), lx.line_groups(text, char_literals).alias("groups")
    )


def pieces_of(files: DataFrame, ranges: str = tx.JAPANESE) -> DataFrame:
    """``file_id, pieces, style``: the pieces of each file, null without any character of the script, and its first line break.

    Stored below the shared folder, so that whoever needs the pieces again need not cut the texts again.
    """
    worth = tx.contains_script(F.col("text"), ranges)
    return stored(files.select("file_id", F.when(worth, lx.tokens(_read())).alias("pieces"), tx.line_break(F.col("text")).alias("style")), "pieces")


def _placed(pieces, groups, char_literals: bool = True):
    """``array<struct<seq, type, raw, line, indentation>>`` of literals and comments.

    Both cuts give the same literals and comments in the same order, so the place
    among all pieces and the place among the lines are put side by side.
    """
    numbered = F.filter(
        F.transform(
            pieces,
            lambda piece, i: F.struct(i.alias("seq"), lx.token_type(piece).alias("type"), piece.alias("raw")),
        ),
        lambda n: n["type"] != lx.CODE,
    )
    return F.transform(
        F.arrays_zip(numbered.alias("n"), lx.segments(groups, char_literals, indent=True).alias("s")),
        lambda z: F.struct(
            z["n"]["seq"].alias("seq"),
            z["n"]["type"].alias("type"),
            z["n"]["raw"].alias("raw"),
            z["s"]["line"].alias("line"),
            z["s"]["indentation"].alias("indentation"),
        ),
    )


def placed_segments(files: DataFrame, char_literals: bool = True) -> DataFrame:
    """Literals and comments as ``file_id, seq, type, raw, line, indentation``."""
    placed = _placed(F.col("pieces"), F.col("groups"), char_literals)
    return (
        _with_pieces(files, char_literals)
        .select("file_id", F.explode(placed).alias("s"))
        .select("file_id", "s.*")
    )


def _indented(pieces: Column) -> Column:
    """``array<struct<type, raw, indentation>>`` of stored ``pieces``; the indentation of a comment is its line up to it, with all but tabs as spaces.

    Pieces are taken in runs up to each that holds a line break: what a run starts with stands behind the last break of the one before.
    """

    def of_run(run: Column) -> Column:
        def up_to(j: Column) -> Column:
            return F.concat(run["before"], F.array_join(F.slice(run["pieces"], F.lit(1), j), ""))

        return F.transform(run["pieces"], lambda piece, j: F.struct(
            lx.token_type(piece).alias("type"), piece.alias("raw"),
            F.when(lx.is_comment(piece), F.regexp_replace(up_to(j), "[^\t]", " ")).alias("indentation"),
        ))

    def of_runs(ends: Column) -> Column:
        def run(end: Column, k: Column) -> Column:
            def since(start: Column) -> Column:
                before = F.coalesce(F.substring_index(F.get(pieces, start - 1), "\n", -1), F.lit(""))
                return F.struct(before.alias("before"), F.slice(pieces, start + 1, end - start).alias("pieces"))

            return tx.bound(tx.bound(F.coalesce(F.get(ends, k - 1), F.lit(0)), since), of_run)

        return F.flatten(F.transform(ends, run))

    last = F.size(pieces)
    ends = F.filter(F.transform(pieces, lambda piece, i: F.when(piece.contains("\n") | (i + 1 == last), i + 1)), lambda end: end.isNotNull())
    return tx.bound(ends, of_runs)


def spliced(cut: DataFrame, found: DataFrame, render: Callable[[Column], Column]) -> DataFrame:
    """``file_id`` and ``text``, what ``render`` makes of the pieces of each file that ``found`` has something for.

    ``cut``: see ``pieces_of``.  ``found``: ``file_id, found`` with ``array<struct<seq, translated>>``, one row for each file.  ``render`` gets
    ``array<struct<type, raw, indentation, translated>>`` of all pieces of the file, in order, and everything happens in its row.
    Breaks are written as the file's first one.
    """
    nothing = F.lit(None).cast("string")

    def item(seq, kind: int, type_, raw, indentation, translated):
        return F.struct(
            seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), type_.alias("type"), raw.alias("raw"),
            indentation.alias("indentation"), translated.alias("translated"),
        )

    cut = cut.join(found, "file_id")
    own = F.transform(_indented(F.col("pieces")), lambda s, i: item(i, 0, s["type"], s["raw"], s["indentation"], nothing))
    given = F.transform(F.col("found"), lambda f: item(f["seq"], 1, nothing, nothing, nothing, f["translated"]))

    def paired(items: Column) -> Column:
        """A translation stands right behind its piece."""
        with_next = F.transform(items, lambda x, i: F.struct(x.alias("x"), F.get(items, i + 1).alias("y")))
        return F.transform(
            F.filter(with_next, lambda p: p["x"]["kind"] == 0),
            lambda p: F.struct(
                p["x"]["type"].alias("type"), p["x"]["raw"].alias("raw"), p["x"]["indentation"].alias("indentation"),
                F.when(p["y"]["kind"] == 1, p["y"]["translated"]).alias("translated"),
            ),
        )

    pieces = tx.bound(F.array_sort(F.concat(own, given)), paired)
    return cut.select("file_id", tx.in_style(tx.bound(pieces, render), F.col("style")).alias("text"))


def _code_items(groups, strategy: str, char_literals: bool):
    """``array<struct<line, text>>`` of literals and comments."""
    found = lx.segments(groups, char_literals)
    if strategy == "sentence":
        return F.transform(
            found, lambda s: F.struct(s["line"].alias("line"), lx.inner(s["raw"]).alias("text"))
        )

    def by_line(s):
        body = F.when(s["type"] == lx.BLOCK, lx.block_body(s["raw"]))
        return F.when(
            body.isNotNull(),
            F.transform(
                F.split(body, "\n"),
                lambda part, i: F.struct((s["line"] + i).alias("line"), tx.strip(part).alias("text")),
            ),
        ).otherwise(F.array(F.struct(s["line"].alias("line"), lx.inner(s["raw"]).alias("text"))))

    return F.flatten(F.transform(found, by_line))


def code_segments(
    files: DataFrame, strategy: str = "sentence", ranges: str | None = tx.JAPANESE, char_literals: bool = False
) -> DataFrame:
    """Texts inside literals and comments, with their line.

    ``strategy="line"`` gives every line of a block comment by itself.  Without
    ``char_literals`` a quote between apostrophes opens a literal.
    """
    grouped = files.select("file_id", lx.line_groups(_read(), char_literals).alias("groups"))
    return _exploded(grouped, _code_items(F.col("groups"), strategy, char_literals), ranges)


def detected_items(
    files: DataFrame, strategy: str = "sentence", ranges: str = tx.JAPANESE
) -> DataFrame:
    """What there is to translate: from code its comments and literals, from text its sentences or lines.

    One pass over the files whatever their kind.  Files without any character of the
    script are not cut.
    """
    plain = lx.sentences if strategy == "sentence" else lx.stripped_lines
    is_code = px.is_code_file(F.col("path"))
    text = _read()
    # The test stands inside the expressions: as a filter it would sink into whatever
    # computes the text and have it computed twice.
    worth = tx.contains_script(F.col("text"), ranges)
    prepared = files.select(
        "file_id",
        F.when(worth & is_code, lx.line_groups(text, False)).alias("groups"),
        F.when(worth & ~is_code, plain(text)).cast(_ITEMS).alias("items"),
    )
    items = F.when(F.col("groups").isNull(), F.col("items")).otherwise(
        _code_items(F.col("groups"), strategy, False).cast(_ITEMS)
    )
    return _exploded(prepared, items, ranges)


def translation_candidates(files: DataFrame, ranges: str = tx.JAPANESE) -> DataFrame:
    """Comments and literals in the script that no translation comment follows: ``file_id, seq, type, text``.

    ``files``: ``file_id, text``, or what ``pieces_of`` has made of them.
    """
    cut = F.col("pieces") if "pieces" in files.columns else F.when(tx.contains_script(F.col("text"), ranges), lx.tokens(_read()))
    pieces = files.select("file_id", cut.alias("pieces"))
    marked = F.transform(
        F.col("pieces"),
        lambda piece, i: F.struct(
            i.alias("seq"),
            lx.token_type(piece).alias("type"),
            F.when(
                tx.contains_script(piece, ranges) & (lx.token_type(piece) != lx.CODE), lx.inner(piece)
            ).alias("text"),
        ),
    )
    wanted = F.filter(
        marked,
        lambda c: c["text"].isNotNull()
        & tx.contains_script(c["text"], ranges)
        & ~lx.already_translated(F.col("pieces"), c["seq"]),
    )
    return pieces.select("file_id", F.explode(wanted).alias("c")).select("file_id", "c.*")


def translated_flags(files: DataFrame) -> DataFrame:
    """Whether a translation comment follows, for every literal and comment."""
    pieces = files.select("file_id", lx.tokens(_read()).alias("pieces"))
    flags = F.transform(
        F.col("pieces"),
        lambda piece, i: F.struct(
            i.alias("seq"),
            lx.token_type(piece).alias("type"),
            lx.already_translated(F.col("pieces"), i).alias("already_translated"),
        ),
    )
    return pieces.select(
        "file_id", F.explode(F.filter(flags, lambda f: f["type"] != lx.CODE)).alias("f")
    ).select("file_id", "f.*")
