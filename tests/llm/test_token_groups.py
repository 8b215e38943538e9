"""Components of the Jaccard join against a plain comparison of all pairs."""

import random

import numpy as np
import pytest

from scriptorium.llm import token_groups
from tests.llm.conftest import ODD


def plain_set(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain(texts, ids, percent=90):
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(zip(ids, sets))), key=repr)


def got(frame):
    return sorted((tuple(r) for r in token_groups.similar_groups(frame).collect()), key=repr)


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(token_groups, "GROUP", 3)
    monkeypatch.setattr(token_groups, "SHARE", 5)


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(6):  # families around a base, and chains that drift away from it
        texts += family(rng, [word() for _ in range(rng.randrange(20, 150))], 12, 4)
    for _ in range(2):
        words = [word() for _ in range(90)]
        for _ in range(10):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = word()
    texts += [" ".join([word() for _ in range(rng.randrange(8))] + passage + [word() for _ in range(rng.randrange(8))]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(40)]
    texts += texts[3:20]
    rng.shuffle(texts)
    return texts


def test_equals_all_pairs(spark, documents, small):
    texts = corpus()
    ids = random.Random(1).sample(range(10**6), len(texts))
    assert got(documents(texts, ids)) == plain(texts, ids)


def test_large_families_in_the_shipped_sizes(spark, documents):
    rng = random.Random(4)
    texts = list(family(rng, [f"w{i}" for i in range(70)], 300, 7)) + [f"alone {i} here {i * 7}" for i in range(50)]
    ids = list(range(5, 5 + len(texts)))
    assert got(documents(texts, ids)) == plain(texts, ids)


def test_a_part_of_a_family_costs_a_row_for_each_set(spark, documents, small, monkeypatch):
    """Near copies that mostly do not link: what is looked up grows with the family, not with its groups times its sets."""
    rng, whole, made = random.Random(9), token_groups._met, []

    def counted(rows, percent):
        made.append((rows.count(), whole(rows, percent).count()))
        return whole(rows, percent)

    monkeypatch.setattr(token_groups, "_met", counted)
    for n in (60, 240):
        texts = list(family(rng, [f"w{i}" for i in range(70)], n, 9)) + list(family(rng, [f"v{i}" for i in range(30)], n // 3, 3))
        ids = list(range(3, 3 + len(texts)))
        assert got(documents(texts, ids)) == plain(texts, ids)
    assert len(made) == 2 and made[1][0] > 3 * made[0][0]
    assert all(met <= 1.5 * rows for rows, met in made)


def test_odd_rows(spark, documents):
    texts = [*ODD, "A  b", "one", "ONE", "one two", "x y z", "x Y z", None]
    ids = [*range(3, 3 + len(texts) - 3), None, 4, 4]
    assert got(documents(texts, ids, extra=True)) == plain(texts, ids)
    assert got(documents([])) == []
    assert got(documents([None, ""])) == [(1, 0, 1), (2, 0, 2)]
    assert got(documents(["a b c"] * 3, [None] * 3)) == [(None, 1, None)] * 3


def test_shingles_are_those_of_the_words():
    for text in [*ODD, "a b c d", "a b a b a b", "A\x1cb c", " b  c\vd\fe "]:
        assert len(token_groups.shingles(text)) == len(plain_set(text))
    assert (token_groups.shingles("a b") == token_groups.shingles("A \t B")).all()
    assert not np.intersect1d(token_groups.shingles("a b c"), token_groups.shingles("b c")).size


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_sets_that_link_have_a_part_in_common(percent):
    """Sets of all sizes with as many changes as a link allows."""
    rng = random.Random(6)
    linked = 0
    common = np.array([rng.random() < 0.3 for _ in range(1 << token_groups.COUNTER_BITS)])
    for turn in range(3000):
        told = common if turn % 2 else None
        size = rng.choice([rng.randrange(1, 30), rng.randrange(1, 300)])
        a = np.unique(np.array([rng.randrange(2**64) for _ in range(size)], np.uint64))
        keep = [t for t in a.tolist() if rng.random() > (100 - percent) / 200 * rng.random() * 2]
        b = np.unique(np.array(keep + [rng.randrange(2**64) for _ in range(rng.randrange(2 + size * (100 - percent) // 100))], np.uint64))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            met = [(x, y) for x in token_groups.parts_of(a, percent, told) for y in token_groups.parts_of(b, percent, told) if x["size"] == y["size"]]
            enough = []
            for x, y in met:
                differing = token_groups._differing(2 * x["size"], percent)
                goal = token_groups._dealt(differing) - token_groups._differing(len(a) + len(b), percent)
                shared = len(set(x["parts"].tolist()) & set(y["parts"].tolist()))
                both = x["hidden"] < 0 and y["hidden"] < 0
                enough.append(shared > 0 and shared + (0 if both else min(abs(x["hidden"]), abs(y["hidden"]))) >= goal)
            assert met and all(enough)
    assert linked > 300


def test_other_sets_have_none_in_common():
    rng = random.Random(7)
    sets = [np.unique(np.array([rng.randrange(2**64) for _ in range(rng.randrange(20, 400))], np.uint64)) for _ in range(300)]
    seen = [{h for d in token_groups.parts_of(s, 90) for h in d["parts"].tolist()} for s in sets]
    assert sum(bool(a & b) for i, a in enumerate(seen) for b in seen[:i]) <= 3
