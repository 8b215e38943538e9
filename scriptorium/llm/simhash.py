"""Near duplicates by SimHash: fingerprints of word shingles and a self-join of binary tries.

Two fingerprints within d bits agree in at least one of d + 1 blocks, so the trie is kept in d + 1 rotations, each led
by another block whose bits must agree.  What lies below one block value is a subtrie; a task walks
pairs of its nodes together, adds up differing bits and prunes pairs beyond the budget.
A subtrie that is too large for a task is cut into pairs of its nodes some levels below first,
by the same rule, as often as needed: fingerprints are distinct, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import components, cut_lineage, hex64, one_of_each

SHINGLE = 3
MAX_BITS = 2
#: Fingerprints of a subtrie that one task may hold; larger ones are cut by their next ``STEP`` bits.
SPLIT_OVER = 4096
STEP = 7
_BLOCK = 1 << 14
NODE_PAIR = ["turn", "a", "b", "depth", "used"]


# -- fingerprints ---------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as a signed long: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    n, last = max(1, len(words) - shingle + 1), min(shingle, len(words)) - 1
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[last : last + n].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = [digest(line[i:j], 42) for i, j in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp``; ``text_key`` tells the texts of one id apart."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), of(F.col(text)).alias("fp"))


# -- the trie -------------------------------------------------------------------------------------

def _rotated(fp, k: int):
    return fp if k == 0 else F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [(i, j - i) for i, j in zip(edges, edges[1:])]


def _roots(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Every fingerprint once below each rotation's leading block."""
    turned = [
        F.struct(F.lit(k).alias("turn"), _rotated(F.col("fp"), k).alias("fp"), F.lit(width).alias("depth"))
        for k, width in _blocks(max_bits)
    ]
    node = F.expr("shiftrightunsigned(t.fp, 64 - t.depth)")
    return distinct.select(F.explode(F.array(*turned)).alias("t")).select(
        "t.turn", node.alias("a"), node.alias("b"), "t.depth", F.lit(0).alias("used"), "t.fp", F.lit(0).alias("side")
    )


def _alive(rows: DataFrame) -> DataFrame:
    """Node pairs in which there is something to compare, with their size."""
    sized = rows.groupBy(*NODE_PAIR).agg(F.count("*").alias("n"), F.sum("side").alias("right"))
    return sized.where(F.when(F.col("a") == F.col("b"), F.col("n") > 1).otherwise((F.col("right") > 0) & (F.col("right") < F.col("n"))))


def _cut(rows: DataFrame, max_bits: int) -> DataFrame:
    """Replace each node pair by the pairs of its nodes' children ``STEP`` levels below that the budget allows."""
    masks = [m for m in range(1 << STEP) if m.bit_count() <= max_bits]
    step = F.least(F.lit(STEP), F.lit(64) - F.col("depth"))
    child = F.expr(f"shiftrightunsigned(shiftleft(fp, depth), 64 - least({STEP}, 64 - depth))")
    grown = rows.withColumn("step", step).withColumn("child", child).withColumn("mask", F.explode(F.lit(masks)))
    grown = grown.where("mask < shiftleft(1, step)").withColumn("used", F.expr("used + bit_count(mask)")).where(F.col("used") <= max_bits)
    other = F.col("child").bitwiseXOR(F.col("mask"))
    own = F.col("a") == F.col("b")
    grown = grown.select(
        "turn", "a", "b", F.expr("depth + step").alias("depth"), "used", "fp", "side", "child", other.alias("other"), "step", own.alias("own")
    )
    mine = F.when(F.col("own"), F.least("child", "other")).when(F.col("side") == 0, F.col("child")).otherwise(F.col("other"))
    theirs = F.when(F.col("own"), F.greatest("child", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("child"))
    side = F.when(F.col("own"), F.when(F.col("child") > F.col("other"), 1).otherwise(0)).otherwise(F.col("side"))
    return grown.select(
        "turn", F.expr("shiftleft(a, step)").bitwiseOR(mine).alias("a"), F.expr("shiftleft(b, step)").bitwiseOR(theirs).alias("b"),
        "depth", "used", "fp", side.alias("side"),
    )


def links(distinct: DataFrame, max_bits: int = MAX_BITS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect all that lie within ``max_bits``.

    Each task returns a spanning forest of the links it finds, so the edges do not outgrow the fingerprints.
    """
    done, rows = [], _roots(distinct, max_bits)
    while True:
        alive = cut_lineage(_alive(rows))
        done.append(rows.join(alive.where(F.col("n") <= split_over).select(*NODE_PAIR), NODE_PAIR))
        large = alive.where(F.col("n") > split_over).select(*NODE_PAIR)
        if large.isEmpty():
            break
        rows = cut_lineage(_cut(rows.join(large, NODE_PAIR), max_bits))
    found = [
        part.groupBy(*NODE_PAIR).agg(
            F.collect_list(F.when(F.col("side") == 0, F.col("fp"))).alias("left"),
            F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("right"),
        ).select("turn", "left", "right").mapInPandas(lambda parts: _walk_all(parts, max_bits), "a long, b long")
        for part in done
    ]
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def _walk_all(parts: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield _forest(part["turn"].to_numpy(), part["left"], part["right"], max_bits)


def _forest(turns, lefts, rights, max_bits: int) -> pd.DataFrame:
    runs, owners = [], []
    for turn, left, right in zip(turns, lefts, rights):
        for values in (left, right):
            runs.append(np.sort(np.asarray(values, np.int64).view(np.uint64)))
            owners.append(np.full(len(runs[-1]), turn, np.uint64))
    values, turned = np.concatenate(runs), np.concatenate(owners)
    ends = np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    u, v = node_pairs(values, starts[0::2], ends[0::2], starts[1::2], ends[1::2], max_bits)
    back = np.where(turned > 0, (values >> turned) | (values << ((np.uint64(64) - turned) % np.uint64(64))), values)
    names, at = np.unique(back.view(np.int64), return_inverse=True)
    label = _labels(len(names), at[u], at[v])
    moved = label != np.arange(len(names))
    return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})


def node_pairs(values, alo, ahi, blo, bhi, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within ``max_bits``; an empty right range asks for the pairs within the left one.

    ``values``: runs of unsigned longs, each sorted and distinct; a trie node is a range of a run.  The frontier of node pairs
    goes down bit by bit: equal branches keep the budget, opposite ones take a bit, and pairs beyond it are pruned.
    """
    own = bhi == blo
    blo, bhi = np.where(own, alo, blo), np.where(own, ahi, bhi)
    used = np.zeros(len(alo), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -2, -1):
        own = alo == blo
        alone = (ahi - alo == 1) & (bhi - blo == 1)
        if alone.any():  # two leaves: the remaining bits at once
            i, j = alo[alone & ~own], blo[alone & ~own]
            near = np.bitwise_count(values[i] ^ values[j]) <= max_bits
            found.append((i[near], j[near]))
            alo, ahi, blo, bhi, used, own = (x[~alone] for x in (alo, ahi, blo, bhi, used, own))
        if not len(alo) or bit < 0:
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        cross = ~own
        frontier = [
            (alo, amid, blo, bmid, used),
            (amid, ahi, bmid, bhi, used),
            (alo, amid, bmid, bhi, used + 1),
            tuple(x[cross] for x in (amid, ahi, blo, bmid, used + 1)),
        ]
        alo, ahi, blo, bhi, used = (np.concatenate(x) for x in zip(*frontier))
        live = (used <= max_bits) & (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, used = (x[live] for x in (alo, ahi, blo, bhi, used))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        while (jumped := label[label]).tolist() != label.tolist():
            label = jumped
        if (label == before).all():
            return label


# -- documents ------------------------------------------------------------------------------------

def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int, split_over: int) -> DataFrame:
    """``doc_id, fp, text_key, component_id, root``; ``root`` is the smallest fingerprint of the component."""
    prints = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), max_bits, split_over)).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id", "root"))
    return prints.join(named, "fp")


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, split_over: int = SPLIT_OVER
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, text_key``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle, and
    one without words (empty, null) has fingerprint zero, linked like any other.  ``component_id`` is the smallest id that can be
    reached over links of at most ``max_bits`` differing bits, null if no row of the component has an id.  Repeated rows have
    equal results; an empty table gives no rows; other columns are not read.
    """
    return _grouped(docs, doc_id, text, shingle, max_bits, split_over).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", "text_key")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id that it has, and of texts of that id the one of the smallest hash.

    The columns stay as they are; a null id comes last.
    """
    rows = cut_lineage(_grouped(docs, "doc_id", "text", SHINGLE, MAX_BITS, SPLIT_OVER).select("doc_id", F.coalesce("text_key", F.lit(0)).alias("key"), "root"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    chosen = rows.groupBy("root").agg(F.min(first).alias("stays"))
    marked = rows.join(chosen, "root").withColumn("stays", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key").eqNullSafe(F.col("stays")))
    marked = cut_lineage(marked.select("doc_id", "key", "stays"))
    gone = marked.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    of = lambda frame: F.coalesce(F.xxhash64(frame["text"]), F.lit(0))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (of(docs) == gone["gone_key"]), "left_anti")
    return one_of_each(left, marked.where("stays").select("doc_id", "key"), of(left))
