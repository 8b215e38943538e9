import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from scriptorium.llm import langid
from scriptorium.llm.common import table
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    table = {"▁": (0.1, 0.2), "▁a": (0.2, 0.1), "a": (0.3, 0.1), "ab": (0.1, 0.3), "b": (0.2, 0.2), "▁ab": (0.05, 0.01), "ba": (0.1, 0.05)}
    for word in ("a", "ab", "abab", "bazab", "aabbab"):
        s = "▁" + word
        for k in (0, 1):
            total = 0.0
            for cuts in itertools.product([0, 1], repeat=len(s) - 1):
                edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
                total += math.prod(table.get(s[i:j], (langid.UNKNOWN if j - i == 1 else 0.0,) * 2)[k] for i, j in zip(edges, edges[1:]))
            assert langid.forward(word, table, 3, 2)[k] == pytest.approx(math.log(total))
    assert langid.forward("ab" * 20_000, table, 3, 2)[0] < -20_000


def test_expected_counts():
    prob = {"▁": 0.1, "▁a": 0.2, "a": 0.3, "b": 0.2, "ab": 0.1}
    counts = langid.expected("ab", prob, 2)
    ways = {("▁", "a", "b"): 0.1 * 0.3 * 0.2, ("▁a", "b"): 0.2 * 0.2, ("▁", "ab"): 0.1 * 0.1}
    for piece in prob:
        assert counts.get(piece, 0) == pytest.approx(sum(p * way.count(piece) for way, p in ways.items()) / sum(ways.values()))


def test_arrays_agree_with_one_word_at_a_time():
    vocab, longest = langid.pieces(PATH)
    table = {piece: (1 / (k + 2) ** 1.1, 1 / (len(vocab) - k) ** 1.2) for k, piece in enumerate(vocab)}
    words = ["a", "the", "straße", "niño", "été", "zzz", "日本語", "a" * 24, "b" * 25, "q" * 400, "xñß", "don", "жук"]
    scores = langid.Model(["x", "y"], table, longest, PATH).scores(words)
    assert scores == pytest.approx(np.array([langid.forward(w, table, longest, 2) for w in words]))
    prob = {piece: p[0] for piece, p in table.items()}
    trie, times = langid._trie(PATH), np.arange(1.0, len(words) + 1)
    uses, left = trie.expected(words, times, trie.weights({piece: (p,) for piece, p in prob.items()}, 1)[:, 0])
    assert {words[at] for at in left} >= {"日本語", "b" * 25, "q" * 400} and len(left) <= 4
    want = Counter()
    for at in set(range(len(words))) - set(left):
        want.update({piece: c * times[at] for piece, c in langid.expected(words[at], prob, longest).items()})
    assert {piece: uses[node] for piece, node in trie.nodes.items() if uses[node]} == pytest.approx(dict(want))


def test_slices_and_full_cache_change_nothing(monkeypatch):
    vocab, longest = langid.pieces(PATH)
    table = {piece: (1 / (k + 2), 1 / (len(vocab) - k)) for k, piece in enumerate(vocab)}
    texts = ["the cat sat", None, "", "12", "el gato come " * 30, "the CAT, the dog"] * 3
    whole = langid.Model(["x", "y"], table, longest, PATH).predict(texts)
    monkeypatch.setattr(langid, "CACHED_WORDS", 2)
    monkeypatch.setattr(langid, "SLICE_LETTERS", 1)
    cut = langid.Model(["x", "y"], table, longest, PATH).predict(texts)
    assert cut == whole and len(whole) == len(texts)


def test_held_out_accuracy(spark, sample):
    docs = table(spark, sample, "documents")
    rows = langid.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_odd_rows(spark, documents):
    frame = documents([*ODD, "123 !?", "the cat sat on the mat"], extra=True)
    rows = {r.doc_id: r for r in langid.identify(frame, PATH).collect()}
    assert len(rows) == len(ODD) + 2
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 8, 11))
    assert all(rows[i].lang_pred == "en" and 0 <= rows[i].score <= 1 for i in (4, 7, 9, 10, 12))
    unlearned = langid.identify(documents(["words"]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"), PATH).first()
    assert (unlearned.lang_pred, unlearned.score) == ("und", 0.0)
    assert langid.identify(documents([]), PATH).count() == 0
