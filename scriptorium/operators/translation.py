"""The translation loop: distinct texts, cache, user translator, write-back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import lexer as lx, text as tx
from scriptorium.operators import ranges as rg, segments as sg
from scriptorium.sources.cache import COMMENT_FAILURE, NOTE_FAILURE

# Note prefix and texts per call.
NOTE_PREFIX = "Translated: "
CHUNK = 20


def distinct_texts(items: DataFrame) -> DataFrame:
    return items.select("text").distinct()


def _translated(items: DataFrame, cache: DataFrame, how: str) -> DataFrame:
    """Items joined with one row per cached text, whatever was appended twice.

    The hash as a second key gives the join exchanges of its own.  Were the grouping to
    share its exchange, AQE could not split the partition of a text that fills a third of the items.
    """
    known = cache.groupBy(F.col("original").alias("text")).agg(F.max("translated").alias("translated"))
    key = F.xxhash64("text")
    return items.withColumn("text_key", key).join(known.withColumn("text_key", key), ["text_key", "text"], how).drop("text_key")


def cache_lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with their cached translation, null where there is none."""
    return _translated(items, cache, "left")


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    return distinct_texts(items).join(cache.select(F.col("original").alias("text")), "text", "left_anti")


def translation_batches(misses: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Number distinct texts in batches of ``chunk`` in the order of their text: ``batch, position, text``.

    Texts are sorted over range partitions and the partitions' totals added, so the numbering never runs through one
    task and all batches but the last are full.
    """
    placed = rg.numbered(misses.select("text"), ["text"])
    return placed.select(
        F.floor(F.col("place") / chunk).alias("batch"), (F.col("place") % chunk).cast("int").alias("position"), "text"
    )


def translate(
    misses: DataFrame, translator: Callable[[list[str]], list[str | None]], chunk: int = CHUNK
) -> DataFrame:
    """Call a user translator on lists of at most ``chunk`` texts, task by task.

    A list whose call fails, or whose answer has another length, is tried text by text; what still
    fails has no translation and an ``error``.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            answer = translator([text])
            if len(answer) != 1:
                raise ValueError(f"{len(answer)} answers to 1 text")
            return answer[0], None
        except Exception as failure:  # the translator is the user's
            return None, f"{type(failure).__name__}: {failure}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for start in range(0, len(texts), chunk):
                part = texts[start : start + chunk]
                try:
                    answers = [(answer, None) for answer in translator(part)]
                except Exception:
                    answers = []
                if len(answers) != len(part):
                    answers = [one(text) for text in part]
                yield pd.DataFrame(
                    {"original": part, "translated": [a for a, _ in answers], "error": [e for _, e in answers]}
                )

    return misses.select("text").mapInPandas(run, "original string, translated string, error string")


def keeps_note(text: Column, translated: Column) -> Column:
    """Rule for notes: compared as they are."""
    return (translated != "") & (translated != text) & ~translated.contains(NOTE_FAILURE)


def keeps_comment(text: Column, translated: Column) -> Column:
    """Rule for comments in the source: compared without surrounding space."""
    return (
        (translated != "") & (tx.strip(translated) != tx.strip(text)) & ~translated.contains(COMMENT_FAILURE)
    )


def translation_writeback(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Every place of every text that has a usable translation."""
    return (
        _translated(items, cache, "inner")
        .filter(keeps_note(F.col("text"), F.col("translated")))
        .select("file_id", "seq", "line", "text", "translated")
    )


def format_note(translated: Column) -> Column:
    return F.concat(F.lit(NOTE_PREFIX), translated)


def notes_per_line(translated: DataFrame) -> DataFrame:
    """Notes of one line below each other in file order: ``file_id, line, note``.

    A group is what one line of one file holds.
    """
    return (
        translated.groupBy("file_id", "line")
        .agg(F.array_sort(F.collect_list(F.struct("seq", format_note(F.col("translated")).alias("note")))).alias("n"))
        .select("file_id", "line", F.array_join(F.col("n.note"), "\n").alias("note"))
    )


def inject_translations(files: DataFrame, cache: DataFrame, ranges: str = tx.JAPANESE) -> DataFrame:
    """Texts with their translations written in as comments: ``file_id, text``, changed files only.

    ``files``: ``file_id, text``, or what ``segments.pieces_of`` has made of them; each text is cut once.  A comment is followed by its
    translation.  Those of literals wait for the end of their line, or for the next line comment, or for the end of the file.  Translations
    are gathered for each file (no more than its comments and literals), and each file that has any is put together in its own row.
    Breaks are written as the file's first one.
    """
    cut = files if "pieces" in files.columns else sg.pieces_of(files, ranges)
    found = (
        _translated(sg.translation_candidates(cut, ranges), cache, "inner")
        .filter(keeps_comment(F.col("text"), F.col("translated")))
        .groupBy("file_id")
        .agg(F.collect_list(F.struct("seq", "translated")).alias("found"))
    )
    return sg.spliced(cut, found, _with_comments)


def _with_comments(pieces: Column) -> Column:
    """The text of ``array<struct<type, raw, indentation, translated>>``.

    Literals wait from one line comment or line end to the next, so the pieces are taken in runs up to each of those places.
    """
    ends_run = lambda p: (p["type"] == lx.SINGLE) | ((p["type"] == lx.CODE) & p["raw"].contains("\n"))
    own = lambda p: F.concat(
        p["raw"],
        F.when(p["translated"].isNotNull() & (p["type"] != lx.STRING), F.concat(F.lit("\n"), p["indentation"], F.lit("//Translated: "), p["translated"])).otherwise(""),
    )

    def waiting(run: Column, before: Column, behind: Column) -> Column:
        literals = F.filter(run, lambda p: (p["type"] == lx.STRING) & p["translated"].isNotNull())
        return F.array_join(F.transform(literals, lambda p: F.concat(before, F.lit('//Translated: "'), p["translated"], F.lit('"'), behind)), "")

    def of_run(run: Column) -> Column:
        def closed(last: Column) -> Column:
            first_break = F.instr(last["raw"], "\n")
            return F.when(
                last["type"] == lx.SINGLE, F.concat(own(last), waiting(run, F.concat(F.lit("\n"), last["indentation"]), F.lit("")))
            ).otherwise(F.concat(
                F.substring(last["raw"], F.lit(1), first_break), waiting(run, F.lit("\t"), F.lit("\n")),
                F.substring(last["raw"], first_break + 1, F.length(last["raw"])),
            ))

        return F.concat(F.array_join(F.transform(F.slice(run, F.lit(1), F.size(run) - 1), own), ""), tx.bound(F.element_at(run, -1), closed))

    def of_tail(run: Column) -> Column:
        left = waiting(run, F.lit(""), F.lit("\n"))
        return F.concat(F.array_join(F.transform(run, own), ""), tx.bound(left, lambda text: F.when(text != "", F.concat(F.lit("\n"), text)).otherwise("")))

    def of_runs(ends: Column) -> Column:
        runs = F.transform(ends, lambda end, k: F.slice(pieces, F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1, end - F.coalesce(F.get(ends, k - 1), F.lit(0))))
        tail = F.slice(pieces, F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) + 1, F.size(pieces))
        return F.concat(F.array_join(F.transform(runs, of_run), ""), tx.bound(tail, of_tail))

    places = F.filter(F.transform(pieces, lambda p, i: F.when(ends_run(p), i + 1)), lambda place: place.isNotNull())
    return tx.bound(places, of_runs)
