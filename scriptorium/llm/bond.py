"""Hard-negative mining by BOND: vectors stored by dimension and scanned in each anchor's own order.

Blocks of rows are kept as columns, one for each dimension, with every column's least and greatest value.  An anchor reads the columns
in the descending magnitude of its own components; what the unread ones can still add lies between two sums
of those extremes, and candidates that can no longer count leave the bitmap.  Survivors end up with exact scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut_lineage, numbered

POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of its positive's.
WINDOW = (50, 95)
#: Rows of a block: at least, at most.  Between them there are a few blocks for each core.
BLOCK_ROWS = (4096, 65536)
#: Columns read between two looks at the bounds.
STEP = 8
_NO_ID = np.iinfo(np.int64).min
_EXACT = 2**53

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Block:
    """Rows by dimension: whole numbers ``floor(scale * x)`` as doubles, shorter vectors filled up with zeros."""

    def __init__(self, rows: pd.DataFrame, scale: float) -> None:
        self.ids = rows["id"].to_numpy(np.int64)
        self.labels = rows["label"].to_numpy(np.int64)
        self.places = rows["pos"].to_numpy(np.int64)
        vectors = [whole(v, scale) for v in rows["vector"]]
        self.columns = np.zeros((max(map(len, vectors)), len(vectors)))
        for i, v in enumerate(vectors):
            self.columns[: len(v), i] = v
        none = not self.columns.size
        self.least = np.zeros(len(self.columns)) if none else self.columns.min(axis=1)
        self.most = np.zeros(len(self.columns)) if none else self.columns.max(axis=1)
        self.reach = 0.0 if none else float(np.abs(self.columns).max())

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block, among those ``alive``, that ``keep`` never ruled out by their bounds, and their exact scores."""
        size = min(len(anchor), len(self.columns))
        q, at = anchor[:size], np.flatnonzero(alive)
        if size and float(np.abs(q).max()) * self.reach * size >= _EXACT:  # beyond what doubles add up exactly
            big = [int(x) for x in q]
            return at, np.array([sum(a * int(b) for a, b in zip(big, self.columns[:size, i])) for i in at], object)
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.sort([q * self.least[:size], q * self.most[:size]], axis=0)[:, order]
        # What the columns not read yet add at least and at most.
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1))], axis=1)
        scores = np.zeros(len(at))
        for start in range(0, size, STEP):
            if not len(at):
                break
            read = order[start : start + STEP]
            values = self.columns[read] if len(at) == len(alive) else self.columns[np.ix_(read, at)]
            scores += q[read] @ values
            low, high = rest[:, min(start + STEP, size)]
            stays = keep(scores + low, scores + high)
            if not stays.all():
                at, scores = at[stays], scores[stays]
        return at, scores


def whole(vector: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(np.asarray(vector, np.float64) * scale)


def _at_least(scores: np.ndarray, n: int) -> float:
    """The ``n``-th largest, or minus infinity if there are fewer."""
    return np.partition(scores, -n)[-n] if len(scores) >= n else -np.inf


def _first(block: Block, at: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Which of ``at`` come first: higher scores, then smaller ids."""
    if len(at) > n:
        rank = np.sort(scores)[-n]
        near = np.flatnonzero(scores >= rank)
    else:
        near = np.arange(len(at))
    return near[np.lexsort((block.ids[at[near]], -scores[near]))][:n]


def best(block: Block, anchor: np.ndarray, alive: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` of the rows ``alive``."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= _at_least(low, n)

    at, scores = block.scan(anchor, alive, keep)
    first = _first(block, at, scores, n)
    return at[first], scores[first]


def best_inside(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest and highest score) the first ``n`` of the rows ``alive`` that lie in it."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            stays |= (high >= max(least, _at_least(sure, n))) & (low <= most)
        return stays

    at, scores = block.scan(anchor, alive, keep)
    found = []
    for least, most in windows:
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        chosen = inside[_first(block, at[inside], scores[inside], n)]
        found.append((at[chosen], scores[chosen]))
    return found


# -- tasks ----------------------------------------------------------------------------------------

def _blocks(batches: Iterator[pd.DataFrame], scale: float) -> Iterator[tuple[Block, pd.DataFrame]]:
    """A task's rows, sorted by block and kind: each block is built once, then its anchors pass batch by batch."""
    held: list[pd.DataFrame] = []
    block, number = None, None
    for batch in batches:
        for (at, is_anchor), rows in batch.groupby(["block", "is_anchor"], sort=True):
            if at != number:
                held, block, number = [], None, at
            if not is_anchor:
                held.append(rows)
                continue
            if block is None and held:
                block, held = Block(pd.concat(held, ignore_index=True), scale), []
            if block is not None:
                yield block, rows


def _positives(batches: Iterator[pd.DataFrame], scale: float, n: int) -> Iterator[pd.DataFrame]:
    for block, anchors in _blocks(batches, scale):
        found = []
        for pos, label, vector in zip(anchors["pos"], anchors["label"], anchors["vector"]):
            alive = (block.labels == label) & (block.places != pos)
            at, scores = best(block, whole(vector, scale), alive, n)
            found += [(pos, int(block.ids[i]), int(s)) for i, s in zip(at, scores)]
        yield pd.DataFrame(found, columns=["pos", "id", "score"])


def _negatives(batches: Iterator[pd.DataFrame], scale: float, n: int, window: tuple[int, int]) -> Iterator[pd.DataFrame]:
    for block, anchors in _blocks(batches, scale):
        found = []
        for pos, label, vector, scores in zip(anchors["pos"], anchors["label"], anchors["vector"], anchors["scores"]):
            # Whole scores s with window[0] * p <= 100 * s <= window[1] * p.
            windows = [(-(-window[0] * int(p) // 100), window[1] * int(p) // 100) for p in scores]
            results = best_inside(block, whole(vector, scale), block.labels != label, windows, n)
            for place, (at, got) in enumerate(results, 1):
                found += [(pos, place, int(block.ids[i]), int(s)) for i, s in zip(at, got)]
        yield pd.DataFrame(found, columns=["pos", "place", "id", "score"])


# -- tables ---------------------------------------------------------------------------------------

def _meet(rows: DataFrame, anchors: DataFrame, task, schema: str) -> DataFrame:
    """Let ``anchors`` (with the array ``blocks`` of the blocks they pass) meet the rows of those blocks."""
    seen = anchors.withColumn("block", F.explode("blocks")).drop("blocks").withColumn("is_anchor", F.lit(True))
    both = rows.withColumn("is_anchor", F.lit(False)).unionByName(seen, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "is_anchor").mapInPandas(task, schema)


def _ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of each group; tasks drop what cannot be among them before the exchange."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0,
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block_rows: int | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchor`` holds for.

    Components become ``floor(scale * x)``; a score is the inner product with the anchor, higher first, ties by smaller id.
    The positives of an anchor are the first ``positives`` other rows of its label, the negatives of a positive the first ``negatives`` rows of
    another label whose score lies within ``window`` hundredths of the positive's.  ``label`` replaces the column of that name.

    Rows with a null label, a null vector, or a null or non-finite component take no part.  A shorter vector counts as filled up with
    zeros, an empty one scores 0.  A null id is smaller than any other and no anchor by its id; rows that repeat an id are rows of
    their own, each the other's positive at equal labels, and each an anchor.  An empty table gives no rows; other columns are not
    read.  Scores must fit a long; larger ones raise an error.
    """
    x = F.col(embedding)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    named = vectors.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(int(_NO_ID))).alias("id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.when(sound, x).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"),
    ).where("label IS NOT NULL AND vector IS NOT NULL")
    placed = cut_lineage(numbered(named, ["label", "id"]))
    labels = placed.groupBy("label").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    n = (labels.agg(F.max("last")).first()[0] or 0) + 1
    size = block_rows or min(max(n // (4 * vectors.sparkSession.sparkContext.defaultParallelism), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    block = lambda pos: F.floor(pos / F.lit(size)).cast("long")
    rows = placed.select("id", "label", "vector", "pos", block(F.col("pos")).alias("block"))
    ranges = labels.select(F.col("label").alias("of_label"), "first", "last")
    anchors = placed.where("asks").select("id", "label", "vector", "pos").join(ranges, F.col("label") == F.col("of_label"))

    # Rows are in the order of their labels: the blocks of a label are neighbours.
    own = F.sequence(block(F.col("first")), block(F.col("last")))
    near = _meet(
        rows, anchors.select("id", "label", "vector", "pos", own.alias("blocks")),
        lambda batches: _positives(batches, scale, positives), "pos long, id long, score long",
    )
    kept = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    found = cut_lineage(_ranked(near, ["pos"], positives).groupBy(F.col("pos").alias("of")).agg(kept.alias("positives")))

    whole_block = lambda b: (b * size >= F.col("first")) & ((b + 1) * size - 1 <= F.col("last"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // size).cast("long")), lambda b: ~whole_block(b))
    asking = anchors.join(found, F.col("pos") == F.col("of")).select(
        "id", "label", "vector", "pos", F.col("positives.score").alias("scores"), others.alias("blocks")
    )
    far = _meet(rows, asking, lambda batches: _negatives(batches, scale, negatives, window), "pos long, place int, id long, score long")
    real = lambda c: F.when(c != int(_NO_ID), c)
    by_place = found.select("of", F.posexplode("positives").alias("at", "p")).select("of", (F.col("at") + 1).alias("of_place"), "p")
    return (
        _ranked(far, ["pos", "place"], negatives)
        .join(by_place, (F.col("pos") == F.col("of")) & (F.col("place") == F.col("of_place")))
        .join(anchors.select(F.col("pos").alias("anchor_pos"), F.col("id").alias("anchor_id")), F.col("pos") == F.col("anchor_pos"))
        .select(
            real(F.col("anchor_id")).alias("anchor_id"), real(F.col("p.id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            real(F.col("id")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
        )
    )
