import random

import numpy as np
import pytest
import xxhash

from scriptorium.llm import common, simhash
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs_of):
    seen = {}
    for start in sorted(pairs_of):
        if start not in seen:
            todo = [start]
            while todo:
                node = todo.pop()
                if node not in seen:
                    seen[node] = start
                    todo += pairs_of[node]
    return seen


def test_fingerprint():
    for text in [*ODD[:6], ODD[8], "One two", "A B C d e F", "repeat " * 9, "x\ty\x0bz\x0c q\r\nz " * 5000]:
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def near(seed, n, hubs):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63, 1}
    for _ in range(hubs):
        hub = rng.getrandbits(64)
        while len(out) < n * (_ + 1) // hubs:
            value = hub
            for _ in range(rng.randrange(4)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize(("n", "hubs", "split_over"), [(300, 20, 4096), (300, 1, 40), (250, 3, 2), (200, 200, 4096)])
def test_links_lose_nothing(spark, n, hubs, split_over):
    values = near(n + hubs, n, hubs)
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
    edges = {u: [s for v, s in zip(values, signed) if (v ^ value).bit_count() <= 2] for value, u in zip(values, signed)}
    expected = plain_components(edges)
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in common.components(simhash.links(frame, 2, split_over)).collect()}
    assert {s: found.get(s, s) for s in signed} == expected


@pytest.mark.parametrize("max_bits", [0, 1, 3])
def test_node_pairs_at_other_distances(max_bits):
    values = np.array(near(5, 120, 2), np.uint64)
    empty = np.array([len(values)])
    u, v = simhash.node_pairs(values, np.array([0]), empty, empty, empty, max_bits)
    expected = {(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= max_bits}
    assert {(max(a, b), min(a, b)) for a, b in zip(u.tolist(), v.tolist())} == expected
    assert len(u) == len(expected)


def test_long_chain_of_components(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 300), (300, 200)], "a long, b long")
    found = {r.node: r.root for r in common.components(frame).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {300: 200}


def test_groups(spark, documents):
    base = " ".join(f"w{i}" for i in range(400))
    texts = ODD + [base, base + " tail", base.upper(), "nothing alike at all here", base.replace("w5 ", "v5 ")]
    ids = [5, 6, None, 8, 9, 10, 11, 4, 12, 13, 30, 20, 40, 50, None]
    frame = documents(texts, ids, extra=True)
    prints = [plain_fingerprint(t) if len(t or "") < 50_000 else simhash.fingerprint(t) % (1 << 64) for t in texts]
    linked = {u: [v for v in range(len(prints)) if (prints[u] ^ prints[v]).bit_count() <= 2] for u in range(len(prints))}
    part = plain_components(linked)
    least = {p: min((i for u, i in enumerate(ids) if part[u] == p and i is not None), default=None) for p in part.values()}
    expected = sorted(((i, f"{prints[u]:016x}", least[part[u]]) for u, i in enumerate(ids)), key=repr)
    got = simhash.near_groups(frame).drop("text_key")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    assert simhash.near_groups(documents([])).count() == 0
    left = simhash.drop_near_copies(frame)
    assert left.columns == frame.columns
    kept = [i for u, i in enumerate(ids) if i == least[part[u]]]
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted(kept, key=repr)
