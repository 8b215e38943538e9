"""Exact deduplication by content-defined chunk recipes.

Every text is cut where its content says so, each chunk gets an identifier, and texts are compared as
ordered lists of identifiers.  A chunk moves once, to verify that no other chunk bears its
identifier; after that only identifiers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut_lineage, one_of_each

#: A chunk ends behind a space whose two letters before it come from these classes (about one character in 300
#: of prose), not before its 512th and at latest behind its 4096th character.
CHUNK = r"(?s).{512,4096}?(?<=[bdlprtuy][aegikmnos] )|.{1,4096}"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty.  A single space is not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _identifier(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def shared_identifiers(chunks: DataFrame, bits: int) -> DataFrame:
    """``h`` of the identifiers that different chunks share; none is expected with 64 bits."""
    named = chunks.select(_identifier(F.col("chunk"), bits).alias("h"), "chunk")
    return named.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Texts are equal when identical after white-space runs became one space (null: empty).  ``keep_id`` is
    the smallest id among equal texts, ``group_size`` their rows, ``kept`` whether the row bears ``keep_id``; repeated rows
    of one id stay or go together.  A null id stays only among equal texts that all lack an id (``keep_id`` null).
    An empty text has no chunk, and all of them are equal.  Other columns are not read; an empty table gives no rows.

    ``bits``: length of an identifier.  Texts that hold a shared identifier are compared chunk by chunk
    besides, so the result does not depend on it.
    """
    norm = normalised(F.col(text))
    pieces = F.regexp_extract_all(F.col("norm"), F.lit(CHUNK), F.lit(0))
    chunks = docs.select(norm.alias("norm")).select(F.explode(pieces).alias("chunk"))
    shared = cut_lineage(shared_identifiers(chunks, bits))
    recipe = F.transform(F.col("pieces"), lambda c: _identifier(c, bits))
    listed = (
        docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
        .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), pieces.alias("pieces"))
    )
    if shared.isEmpty():
        recipes = cut_lineage(listed.select("doc_id", "text_sha256", recipe.alias("recipe"), F.lit(None).cast("array<string>").alias("told")))
    else:
        recipes = cut_lineage(_told_apart(listed.withColumn("recipe", recipe), shared))
    return _groups(recipes)


def _told_apart(listed: DataFrame, shared: DataFrame) -> DataFrame:
    """Keep the chunks of the recipes that hold a shared identifier, as a second key."""
    unsure = (
        listed.select("recipe").distinct().select("recipe", F.explode("recipe").alias("h"))
        .join(shared, "h", "left_semi").select("recipe", F.lit(True).alias("unsure")).distinct()
    )
    return listed.join(unsure, "recipe", "left").select(
        "doc_id", "text_sha256", "recipe", F.when(F.col("unsure"), F.col("pieces")).alias("told")
    )


def _groups(recipes: DataFrame) -> DataFrame:
    # The hash as a further key gives the join exchanges of its own on both sides, so that a
    # recipe in a third of all rows can be split.
    key = F.xxhash64("recipe", "told")
    repeated = (
        recipes.groupBy("recipe", "told").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").withColumn("key", key)
        .withColumnsRenamed({"recipe": "g_recipe", "told": "g_told", "key": "g_key"})
    )
    same = (F.col("key") == F.col("g_key")) & (F.col("recipe") == F.col("g_recipe")) & F.col("told").eqNullSafe(F.col("g_told"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return recipes.withColumn("key", key).join(repeated, same, "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, one that ``exact_groups`` keeps; the columns stay as they are."""
    groups = cut_lineage(exact_groups(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept"))
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_sha")).distinct()
    sha = F.sha2(normalised(docs["text"]), 256)
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti")
    return one_of_each(left, groups.where("kept"), F.sha2(normalised(left["text"]), 256))
