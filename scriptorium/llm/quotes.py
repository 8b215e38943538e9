"""Quotation linking: nested quotes are parsed, matched with the messages they come from, and replies put in order.

A quoted passage is a sentence of a quoted block, compared by its words alone, so re-wrapped lines still match.  Its source
is the latest message of the thread before the quoting one that has the sentence outside quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut_lineage

#: Quote marks before a line, at any depth.
MARKS = r"^\s*(?:>\s*)+"
#: What a line that introduces a quote consists of.
INTRODUCTION = r"(?:On|Am|Le|El)\b[^\n]*\b(?:wrote|schrieb|a écrit|escribió)[^\S\n]*:[^\S\n]*"
#: Orders of a thread that are searched for a source together.
SPAN = 4096


def lines_of(text: Column) -> Column:
    """``level, line`` of every line; introductions have level -1 if the next line that says something is quoted deeper."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")

    def marked(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.concat(F.repeat(F.lit(">"), level), F.regexp_replace(line, MARKS, ""))

    def parse(line: Column) -> Column:
        level = F.length(F.regexp_extract(line, "^>*", 0))
        return F.struct(F.when(line.startswith(" >"), -1).otherwise(level).alias("level"), F.regexp_replace(line, "^ ?>+", "").alias("line"))

    # Marks without white space between them, so that no line but an introduction begins with " >".
    even = F.array_join(F.transform(lines, marked), "\n")
    introduced = F.regexp_replace(even, rf"(?md)^(>*)({INTRODUCTION})$(?=\n(?:>*[^\S\n]*\n)*\1>)", " >$1$2")
    return F.transform(F.split(introduced, "\n"), parse)


def own_text(lines: Column) -> Column:
    """What a message says itself: lines outside quotes, without the introductions of quotes."""
    return F.trim(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit("\n"))


def passages(lines: Column) -> Column:
    """Distinct ``level, digest`` of the sentences of every level: 128 bits of the SHA-256 of their words, which stay behind."""

    def at(level: Column) -> Column:
        text = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["line"]), " ")
        sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
        return F.transform(F.filter(sentences, lambda s: s != ""), lambda s: F.struct(level.alias("level"), F.unhex(F.substring(F.sha2(s, 256), 1, 32)).alias("digest")))

    levels = F.array_distinct(F.transform(F.filter(lines, lambda x: x["level"] >= 0), lambda x: x["level"]))
    return F.array_distinct(F.flatten(F.transform(levels, at)))


def link(messages: DataFrame, thread: str, order: str, text: str) -> DataFrame:
    """One row per message: ``thread, order, parent, root, depth, n_quoted, n_linked, own``.

    A message is known by thread and order (longs); rows that repeat both count as one message, the one with the
    smallest text, and rows without either are messages of their own that link to nothing.  ``parent``: the earlier message that most of
    the first-level passages come from, the latest of equals; if none is found, that of the next level, and so on.  ``root`` and ``depth`` follow the
    parents; (root, depth, order) is a reply order.  ``n_quoted``: distinct passages in quotes, ``n_linked``: those with a source.
    ``own``: the text without quotes.  Null and empty texts have no passages; an empty table gives no rows.
    """
    rows = messages.select(F.col(thread).alias("thread"), F.col(order).alias("order"), F.col(text).alias("text"))
    whole = rows.where("thread IS NOT NULL AND order IS NOT NULL").groupBy("thread", "order").agg(F.min("text").alias("text"))
    parsed = whole.unionByName(rows.where("thread IS NULL OR order IS NULL")).withColumn("lines", lines_of(F.col("text")))
    base = cut_lineage(parsed.select("thread", "order", own_text(F.col("lines")).alias("own"), passages(F.col("lines")).alias("passages")))
    said = base.select("thread", "order", F.explode("passages").alias("p")).select("thread", "order", "p.*")
    found = _sources(said).groupBy("thread", "order", "level", "source").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), "n", "source")))
    votes = found.groupBy("thread", "order").agg(
        best["source"].alias("parent"), F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked")
    )
    placed = _roots(cut_lineage(votes))
    linked = base.select("thread", "order", "own").join(placed, ["thread", "order"], "left")
    return linked.select(
        "thread", "order", "parent", F.coalesce("root", "order").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "own",
    )


def _sources(said: DataFrame) -> DataFrame:
    """``thread, order, level, source`` of every quoted passage: the latest earlier message of the thread that says it, or null.

    Sources are looked for among ``SPAN`` orders, and by way of the last source of each span before; so a sentence that all messages of a
    long thread share forms no pairs and is not gathered.
    """
    known = said.where("thread IS NOT NULL AND order IS NOT NULL").withColumn("span", F.floor(F.col("order") / SPAN))
    key = ["thread", "digest"]
    says = F.when(F.col("level") == 0, F.col("order"))
    before = Window.partitionBy(*key, "span").orderBy("order").rangeBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("source", F.max(says).over(before)).where("level > 0")
    long = cut_lineage(known.groupBy("thread").agg((F.min("span") < F.max("span")).alias("long")).where("long").select("thread"))
    if not long.isEmpty():
        above = Window.partitionBy(*key).orderBy("span").rangeBetween(Window.unboundedPreceding, -1)
        spans = known.join(long, "thread", "left_semi").groupBy(*key, "span").agg(F.max(says).alias("last"))
        far = spans.withColumn("far", F.max("last").over(above)).where("far IS NOT NULL").drop("last")
        near = near.join(far, [*key, "span"], "left").withColumn("source", F.coalesce("source", "far"))
    linked = near.select("thread", "order", "level", "source")
    alone = said.where("level > 0 AND (thread IS NULL OR order IS NULL)")
    return linked.unionByName(alone.select("thread", "order", "level", F.lit(None).cast("long").alias("source")))


def _roots(votes: DataFrame) -> DataFrame:
    """Follow parents to the root by doubling: after k rounds every message knows its ancestor 2^k steps up.

    A message that has reached its root leaves the rounds, so a long thread costs rounds for itself alone.
    """
    reach = {"root": F.coalesce("parent", "order"), "depth": F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")}
    known = votes.withColumns(reach)
    done, open_ = [known.where("parent IS NULL")], known.where("parent IS NOT NULL")
    while True:
        up = open_
        for part in done[1:]:
            up = up.unionByName(part)
        up = up.select(F.col("thread"), F.col("order").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        joined = open_.join(up, ["thread", "root"], "left")
        stepped = cut_lineage(joined.select(
            "thread", "order", "parent", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            "n_quoted", "n_linked", F.col("above").isNotNull().alias("moved"),
        ))
        done.append(stepped.where("NOT moved").drop("moved"))
        open_ = stepped.where("moved").drop("moved")
        if open_.isEmpty():
            break
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return placed


def with_quotes(conversations: DataFrame) -> DataFrame:
    """``conversations`` as a mail thread: each turn quotes the turn before it, which quotes the one before that.

    Rows that repeat conversation and turn count as one turn, the one with the smallest text; rows without either quote nothing
    and stay rows of their own.  A null text is empty.
    """
    rows = conversations.select("conv_id", "turn", "text")
    turns = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def before(steps: int) -> DataFrame:
        return turns.select("conv_id", (F.col("turn") + steps).alias("turn"), F.col("text").alias(f"text{steps}"))

    def quote(column: str, marks: str) -> Column:
        return F.concat(F.lit("\n\nOn that day someone wrote:\n" if marks == "> " else "\n"), F.regexp_replace(F.concat(F.lit("\n"), F.col(column)), "\n", f"\n{marks}"))

    joined = turns.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    text = F.concat(F.coalesce("text", F.lit("")), F.coalesce(quote("text1", "> "), F.lit("")), F.coalesce(quote("text2", "> > "), F.lit("")))
    alone = rows.where("conv_id IS NULL OR turn IS NULL").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return joined.select("conv_id", "turn", text.alias("text")).unionByName(alone)
