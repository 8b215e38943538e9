"""Benchmark decontamination with a broadcast set of n-grams, in DataFrame functions throughout.

Scan: a window of k words holds one of the (k + 1) / 2-word grams that start at multiples of their own length, so
only those grams of the corpus are looked up, by hash, in the set of all such grams of the benchmark.
Verify: only texts with a hit are read again, and all their windows are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.arrays import merged
from scriptorium.llm.common import ascii_lower, cut_lineage

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a table that may be broadcast; a larger one is joined by a shuffle.
MAX_SET = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words: Column, k: int | Column, step: int = 1) -> Column:
    """The k-word grams at every ``step``-th word, empty if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - k, F.lit(step))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, k), " "))
    return F.when(F.size(words) >= k, grams).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``item_id, k, gram``: every window of every item; an item of fewer words is one window."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(window))
    return items.select("item_id", k.alias("k"), F.explode(_grams(F.col("w"), k)).alias("gram")).distinct()


def _sized(rows: DataFrame, max_set: int) -> DataFrame:
    """``rows`` to be broadcast if what they hold, and 64 bytes for each row, is no more than ``max_set`` bytes."""
    held = [F.octet_length(F.col(c).cast("string")) if t == "string" else F.lit(8) for c, t in rows.dtypes]
    width = sum((F.coalesce(h, F.lit(0)) for h in held), F.lit(64))
    return F.broadcast(rows) if (rows.agg(F.sum(width.cast("long"))).first()[0] or 0) <= max_set else rows


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, max_set: int = MAX_SET,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_key``.

    A word is hit if it lies inside any occurrence of a window of any item.  ``spans``: the hit runs as word
    positions, end exclusive, touching runs merged.  Empty and null texts have no words; an item without words has no window; an item without
    an id hits words but is in no item list.  Repeated rows have equal results; empty tables
    give no rows or no hits; other columns are not read.
    """
    windows = cut_lineage(benchmark_windows(benchmark, item_id, item_text, window))
    sizes = sorted(row.k for row in windows.select("k").distinct().collect())  # at most ``window`` numbers
    scanned = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_key"), words(F.col(text)).alias("w"))
    # A window of k words is looked for by its anchor grams of g words.
    anchor = {k: (k + 1) // 2 for k in sizes}
    aligned = [F.transform(_grams(F.col("w"), g, g), lambda x: F.xxhash64(x)) for g in sorted(set(anchor.values()))]
    hashes = F.concat(*aligned) if aligned else F.array().cast("array<bigint>")
    base = cut_lineage(scanned.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), hashes.alias("hashes")))
    anchors = _sized(cut_lineage(_anchors(windows, anchor)), max_set)
    # Of copies of a text one row, the one of the smallest id, is read again.
    suspects = (
        base.select("doc_id", "text_key", F.explode("hashes").alias("hash")).join(anchors, "hash", "left_semi")
        .groupBy("text_key").agg(F.min("doc_id").alias("one_id"))
    )
    found = cut_lineage(_verified(docs, doc_id, text, cut_lineage(suspects), windows, sizes, max_set))
    hits = found.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    item_rows = found.select("text_key", "gram").join(_sized(windows.select("gram", "item_id"), max_set), "gram")
    items = item_rows.where("item_id IS NOT NULL").select("text_key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("text_key").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.count("*").alias("n_items"))
    told = cut_lineage(hits.join(items, "text_key", "left").select("text_key", merged(F.col("runs")).alias("spans"), "items", "n_items"))
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    n_hit = F.coalesce(hit, F.lit(0)).cast("long")
    return base.join(_sized(told, max_set), "text_key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        "text_key",
    )


def _anchors(windows: DataFrame, anchor: dict[int, int]) -> DataFrame:
    parts = [
        windows.where(F.col("k") == k).select(F.explode(_grams(F.split("gram", " "), g)).alias("gram"))
        for k, g in anchor.items()
    ]
    grams = windows.select("gram").limit(0)
    for part in parts:
        grams = grams.unionByName(part)
    return grams.select(F.xxhash64("gram").alias("hash")).distinct()


def _verified(docs: DataFrame, doc_id: str, text: str, suspects: DataFrame, windows: DataFrame, sizes: list[int], max_set: int) -> DataFrame:
    """``text_key, gram, start, end`` of every occurrence of a window, once per distinct text."""
    # By id first: only rows that bear the id of a suspect are hashed again.
    rows = docs.select(F.col(doc_id).alias("read_id"), F.col(text).alias("text"))
    same = F.col("read_id").eqNullSafe(F.col("one_id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("text_key"))
    read = rows.join(_sized(suspects, max_set), same).select("text_key", words(F.col("text")).alias("w"))
    grams = _sized(windows.select("gram").distinct(), max_set)
    runs = [
        read.select("text_key", F.posexplode(_grams(F.col("w"), k)).alias("start", "gram")).withColumn("end", F.col("start") + k)
        for k in sizes
    ]
    if not runs:
        return read.select("text_key", F.lit("").alias("gram"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    rows = runs[0]
    for more in runs[1:]:
        rows = rows.unionByName(more)
    return rows.join(grams, "gram", "left_semi").select("text_key", "gram", "start", "end").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the texts in which a window of the benchmark occurs; their columns stay as they are."""
    gone = contamination(docs, benchmark).where("contaminated").select(F.col("text_key").alias("gone_key")).distinct()
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(_sized(cut_lineage(gone), MAX_SET), key == F.col("gone_key"), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit words, and what separates each from the next word, cut out of ``text``."""
    hits = contamination(docs, benchmark).where("contaminated").groupBy("text_key").agg(F.first("spans").alias("hit_spans"))
    hits = hits.withColumnRenamed("text_key", "hit_key")
    key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    found, gaps = F.regexp_extract_all(docs["text"], F.lit(RAW_WORD), F.lit(0)), F.split(docs["text"], RAW_WORD, -1)
    left = F.transform(
        F.arrays_zip(found.alias("w"), F.slice(gaps, 2, F.size(found)).alias("g")),
        lambda x, i: F.when(F.exists(hits["hit_spans"], lambda s: (s["start"] <= i) & (i < s["end"])), "").otherwise(F.concat(x["w"], x["g"])),
    )
    cut = F.when(hits["hit_spans"].isNull(), docs["text"]).otherwise(F.concat(gaps[0], F.array_join(left, "")))
    joined = docs.join(hits, key == hits["hit_key"], "left")
    return joined.select(*[cut.alias(c) if c == "text" else docs[c] for c in docs.columns])
