"""A Merkle manifest of a dataset, and octopus multiproofs over it.

Rows are leaves, one binary tree for each group (language), and a tree over the trees' roots.  Leaves are proved partition by
partition: a partition computes the smallest set of node coordinates that its leaves need and cannot derive themselves,
fetches each once, derives the interiors its leaves share, and expands the proof of every leaf from them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut_lineage, numbered, runs

#: A leaf partition, and a subtree that one task builds at a time, has 2 to this power leaves.
BLOCK_LEVELS = 10
#: The tree over the roots of all trees.
TOP = -1
#: Levels with fewer nodes than this in all trees together are joined by broadcast (about 100 bytes a node).
BROADCAST_NODES = 20_000
NODES = "tree long, size long, level int, idx long, digest string"


def hashed(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return max(size - 1, 0).bit_length()


def _height(size: Column) -> Column:
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value with its length in bytes before it, a null as ``-``."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown]), 256)


@dataclass
class Manifest:
    """``leaves``: ``tree, size, pos, id, leaf`` and the columns carried along; ``nodes``: ``tree, size, level, idx, digest`` of every
    node; ``trees``: ``tree, name, size``; ``root`` and the number of trees."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    n_trees: int


# -- the trees ------------------------------------------------------------------------------------

def manifest(rows: DataFrame) -> Manifest:
    """The manifest of ``rows`` (``name, id, leaf`` and what else there is): one tree for each name, null first and by bytes, its leaves
    by id (null first; rows that repeat an id by their digest)."""
    rows = cut_lineage(rows)
    sizes = rows.groupBy("name").agg(F.count("*").alias("size"))
    trees = numbered(sizes, ["name"], name="tree")
    placed = numbered(rows, ["id", "leaf"], ["name"])
    of = trees.select("tree", "size", F.col("name").alias("tree_name"))
    leaves = placed.join(of, F.col("name").eqNullSafe(F.col("tree_name"))).drop("name", "tree_name")
    nodes = _grown(leaves.select("tree", "size", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest")))
    n_trees = trees.count()
    top = nodes.where((F.col("idx") == 0) & (F.col("level") == _height(F.col("size")))).select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest"
    )
    above = _grown(cut_lineage(top))
    root = above.where((F.col("idx") == 0) & (F.col("level") == height(n_trees))).select("digest").first()
    return Manifest(leaves, nodes.unionByName(above), trees, root and root[0], n_trees)


def _grown(bottom: DataFrame) -> DataFrame:
    """All nodes over the level-0 nodes ``bottom``; a job builds ``BLOCK_LEVELS`` levels, from blocks of that many levels' leaves."""
    largest = bottom.agg(F.max("size")).first()[0] or 0
    levels, at = [bottom], 0
    while at < height(largest):
        under = levels[-1].where((F.col("level") == at) & (F.col("size") > 1 << at))
        block = F.shiftright("idx", BLOCK_LEVELS)
        blocks = under.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        levels.append(cut_lineage(blocks.mapInPandas(functools.partial(_grow, up=BLOCK_LEVELS), NODES)))
        at += BLOCK_LEVELS
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _grow(batches: Iterator[pd.DataFrame], up: int) -> Iterator[pd.DataFrame]:
    for block in runs(batches, ["tree", "block"]):
        tree, size, at, first = (int(block[c].iloc[0]) for c in ("tree", "size", "level", "idx"))
        row, made = block["digest"].tolist(), []
        for level in range(at + 1, min(at + up, height(size)) + 1):
            row = [hashed(*row[i : i + 2]) for i in range(0, len(row), 2)]
            first >>= 1
            made.append(pd.DataFrame({"tree": tree, "size": size, "level": level, "idx": range(first, first + len(row)), "digest": row}))
        yield pd.concat(made, ignore_index=True)


# -- multiproofs ----------------------------------------------------------------------------------

def missing(wanted: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """The coordinates, level by level, that a proof of the leaves ``wanted`` (sorted, distinct) of a tree needs from outside."""
    found, known = [], wanted
    for level in range(height(size)):
        beside = known ^ 1
        width = -(-size >> level)
        outside = beside[(beside < width) & ~np.isin(beside, known, assume_unique=True)]
        if len(outside):
            found.append((level, outside))
        known = np.unique(known >> 1)
    return found


def _requests(batches: Iterator[pd.DataFrame], n_trees: int) -> Iterator[pd.DataFrame]:
    for block in runs(batches, ["tree", "block"]):
        tree, number = int(block["tree"].iloc[0]), int(block["block"].iloc[0])
        asked = [(tree, *m) for m in missing(np.unique(block["pos"].to_numpy()), int(block["size"].iloc[0]))]
        asked += [(TOP, *m) for m in missing(np.array([tree]), n_trees)]
        yield from (
            pd.DataFrame({"tree": tree, "block": number, "of": of, "level": level, "idx": idx}) for of, level, idx in asked
        )


def _levels(size: int, known: dict[int, str], fetched: list[tuple[int, int, str]]) -> list[dict[int, str]]:
    """The digests of a tree by level and index: what is given and what follows from it."""
    by_level: list[dict[int, str]] = [{} for _ in range(height(size) + 1)]
    for level, idx, digest in fetched:
        by_level[level][idx] = digest
    own = known
    for level, above in enumerate(by_level[1:]):
        here = by_level[level]
        here.update(own)
        last = (-(-size >> level)) - 1
        own = {p: hashed(here[2 * p], here[2 * p + 1]) if 2 * p < last else hashed(here[2 * p]) for p in {i >> 1 for i in own}}
    by_level[-1].update(own)
    return by_level


def _path(levels: list[dict[int, str]], pos: int) -> list[tuple[str, str]]:
    """Per level what stands left and right of the path; one of the two is empty, or both."""
    path = []
    for level in levels[:-1]:
        beside = level.get(pos ^ 1, "")
        path.append((beside, "") if pos & 1 else ("", beside))
        pos >>= 1
    return path


def _expand(batches: Iterator[pd.DataFrame], n_trees: int, root: str) -> Iterator[pd.DataFrame]:
    for block in runs(batches, ["tree", "block"]):
        tree = int(block["tree"].iloc[0])
        is_leaf = block["kind"].to_numpy() == 1
        rows, nodes = block[is_leaf], block[~is_leaf]
        size = int(rows["size"].iloc[0])
        fetched: dict[bool, list] = {True: [], False: []}
        for of, level, idx, digest in zip(nodes["of"], nodes["level"], nodes["idx"], nodes["digest"]):
            fetched[of == TOP].append((int(level), int(idx), digest))
        places = [int(p) for p in rows["idx"]]
        levels = _levels(size, dict(zip(places, rows["digest"])), fetched[False])
        subroot = levels[-1][0]
        above = _levels(n_trees, {tree: subroot}, fetched[True])
        if above[-1][0] != root:
            raise ValueError(f"the leaves of tree {tree} do not lead to the root of the manifest")
        over = _path(above, tree)
        folded, proofs = [], []
        for pos, leaf_digest, claimed in zip(places, rows["digest"], rows["claimed"]):
            path = _path(levels, pos) + over
            node = leaf_digest if claimed is None else claimed
            for left, right in path:
                node = hashed(left, node, right)
            folded.append(node)
            proofs.append(hashed(*[left + right for left, right in path]))
        yield pd.DataFrame(
            {"id": rows["id"].tolist(), "leaf": rows["digest"].tolist(), "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded}
        )


def multiproofs(of: Manifest, wanted: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per row of ``wanted`` (of the manifest's ``leaves``; ``claimed``: the digest to be checked, null for the leaf's own):
    ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256`` hashes the siblings from the leaf up to the root, ``folded_root`` is what the claimed digest and those siblings
    lead to.  A leaf partition is a run of 2 ** ``BLOCK_LEVELS`` places of a tree.  A node that many partitions fetch lies high
    up: levels of few nodes are broadcast, and one of the others is asked for by a bounded number of partitions.
    """
    block = F.shiftright("pos", BLOCK_LEVELS).alias("block")
    placed = wanted.select("tree", block, "size", "pos", F.col("id").cast("string").alias("id"), "leaf", "claimed")
    n_trees, root = of.n_trees, of.root
    asked = placed.select("tree", "block", "size", "pos").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInPandas(
        lambda batches: _requests(batches, n_trees), "tree long, block long, of long, level int, idx long"
    )
    fetched = _fetched(cut_lineage(asked), of.nodes)
    none = F.lit(None)
    rows = placed.select(
        "tree", "block", F.lit(1).alias("kind"), "size", none.cast("long").alias("of"), none.cast("int").alias("level"),
        F.col("pos").alias("idx"), F.col("leaf").alias("digest"), "id", "claimed",
    )
    nodes = fetched.select(
        "tree", "block", F.lit(0).alias("kind"), none.cast("long").alias("size"), "of", "level", "idx", "digest",
        none.cast("string").alias("id"), none.cast("string").alias("claimed"),
    )
    done = nodes.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block").mapInPandas(
        lambda batches: _expand(batches, n_trees, root),
        "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    )
    return done.withColumn("id", F.col("id").cast(id_type)).withColumn("verified", F.col("folded_root") == F.col("root"))


def _fetched(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``asked`` with the digest of each coordinate."""
    counts = nodes.groupBy("level").agg(F.count("*").alias("n")).collect()  # a row for each level
    cut, seen = max((r["level"] for r in counts), default=0) + 1, 0
    for n in (r["n"] for r in sorted(counts, key=lambda r: -r["level"])):
        if (seen := seen + n) > BROADCAST_NODES:
            break
        cut -= 1
    named = nodes.select(F.col("tree").alias("of"), "level", "idx", "digest")
    key = ["of", "level", "idx"]
    low = asked.where(F.col("level") < cut).join(named.where(F.col("level") < cut), key)
    high = asked.where(F.col("level") >= cut).join(F.broadcast(named.where(F.col("level") >= cut)), key)
    return low.unionByName(high)


# -- documents ------------------------------------------------------------------------------------

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf covers ``doc_id, source, lang, n_chars, text``; there is a tree for each language.  Where ``tampered`` holds, the claimed
    leaf has one more in ``n_chars`` (a null stays, so its leaf still verifies).  Null ids come first, rows that repeat an id are
    ordered by their digests and each has its own leaf; empty texts are leaves like others; an empty table gives no rows;
    other columns are not read.
    """
    # Renamed by position first: the columns may hold names that are used below.
    given = {c: F.col(c) for c in COLUMNS}
    forged = leaf([F.try_add(given[c], F.lit(1)) if c == "n_chars" else given[c] for c in COLUMNS])
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(
        given["lang"].cast("string").alias("name"), given["doc_id"].alias("id"), leaf(list(given.values())).alias("leaf"),
        F.when(hit, forged).alias("claimed"),
    )
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    whole = manifest(rows)
    return multiproofs(whole, whole.leaves, id_type).withColumnRenamed("id", "doc_id")
