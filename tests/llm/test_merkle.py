"""Proofs against a plain tree built in memory."""

import random
import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import merkle
from tests.llm.conftest import DOCS, ODD

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, add=0):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if values[3] is not None:
        values[3] += add
    shown = [None if v is None else str(v) for v in values]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def plain_tree(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def plain_steps(levels, pos):
    steps = []
    for row in levels[:-1]:
        run = [i for i in range(pos // 2 * 2, min(pos // 2 * 2 + 2, len(row)))]
        steps.append(([row[i] for i in run if i < pos], [row[i] for i in run if i > pos]))
        pos //= 2
    return steps


def plain_proofs(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        built[name] = plain_tree([plain_leaf(r) for r in trees[name]])
    top = plain_tree([built[n][-1][0] for n in names])
    found = []
    for t, name in enumerate(names):
        for pos, row in enumerate(trees[name]):
            steps = plain_steps(built[name], pos) + plain_steps(top, t)
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = plain_leaf(row, int(hit))
            for left, right in steps:
                node = H(*left, node, *right)
            root = top[-1][0]
            proof = H(*(d for left, right in steps for d in left + right))
            found.append((row["doc_id"], plain_leaf(row), built[name][-1][0], root, proof, node, node == root))
    return sorted(found, key=repr)


def check(spark, rows, monkeypatch=None):
    frame = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCS)
    frame = frame.selectExpr("*", "'x' AS name", "'y' AS id", "1 AS leaf", "2 AS pos", "3 AS tree", "4 AS claimed", "5 AS size")
    got = merkle.proofs(frame, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_proofs(rows)


def rows_of(n, langs, rng):
    return [
        {"doc_id": rng.choice([i, i, i, i, 3]), "text": rng.choice(["a", "b é", f"text {i}"]), "lang": rng.choice(langs), "source": f"s{i % 3}", "n_chars": rng.choice([None, i])}
        for i in range(n)
    ]


def test_odd_rows(spark):
    rows = [{"doc_id": i, "text": t, "lang": rng, "source": None, "n_chars": i} for i, (t, rng) in enumerate(zip(ODD, [None, "", "en", "é", "en", "en", "z", "en", None, "en"]))]
    rows += [rows[4], rows[4], {"doc_id": None, "text": None, "lang": None, "source": "x", "n_chars": None}, {"doc_id": 2**62 + 1, "text": "x", "lang": "en", "source": "x", "n_chars": 2**62}]
    check(spark, rows)


def test_random_trees(spark, monkeypatch):
    """Blocks of four leaves, and next to no level small enough for a broadcast."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 3)
    rng = random.Random(5)
    for n, langs in ((1, ["en"]), (2, ["en"]), (37, ["en", None, "de"]), (150, ["en"] * 8 + [f"l{i}" for i in range(6)])):
        check(spark, rows_of(n, langs, rng))


def test_empty(spark, documents):
    assert merkle.proofs(documents([])).count() == 0


def test_some_leaves_only(spark, documents):
    """A subset of the leaves: interiors of its own partition are fetched too."""
    whole = merkle.manifest(documents([f"t{i}" for i in range(90)]).select(
        F.col("lang").alias("name"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("leaf"), F.lit(None).cast("string").alias("claimed")
    ))
    got = merkle.multiproofs(whole, whole.leaves.where("id % 9 = 0")).collect()
    assert sorted(r["id"] for r in got) == list(range(9, 91, 9))
    assert all(r["verified"] and r["root"] == whole.root for r in got)


def test_missing_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.randrange(1, 40)
        wanted = sorted(rng.sample(range(size), rng.randrange(1, size + 1)))
        asked = {(level, int(i)) for level, idx in merkle.missing(np.array(wanted), size) for i in idx}
        known, expected = set(wanted), set()
        for level in range(merkle.height(size)):
            width = -(-size // 2**level)
            expected |= {(level, k ^ 1) for k in known if k ^ 1 < width and k ^ 1 not in known}
            known = {k // 2 for k in known}
        assert asked == expected
