"""Language identification by unigram pieces, summed over all segmentations.

Every language gives the pieces of a fixed public vocabulary its own probabilities, fitted by expectation maximisation.  A word is
scored by the forward algorithm: the sum over all ways to cut it into pieces.  Pieces do not cross words, so a text is the
product of its words, and a task keeps the scores of words it has seen.  Words of equal length go through the sum together, as
arrays; ``forward`` and ``expected`` state it for one word, and serve the words that the arrays do not cover.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut_lineage

#: Documents per language that a fit may read, chosen by a hash of the id.
FIT_DOCS = 1_500
EM_STEPS = 2
#: Weight, in pieces, of the probabilities pooled over the languages.
POOLED = 200.0
#: Probability of a letter that no piece covers, in every language.
UNKNOWN = 1e-8
UNDETERMINED = "und"
#: Words whose scores a task keeps; when full, it starts over.
CACHED_WORDS = 300_000
#: Letters of texts that a task cuts into words at a time (one text at least).
SLICE_LETTERS = 2_000_000
#: The letters most used by pieces go through arrays, for words up to a length whose probability a double can hold.
TRIE_LETTERS, TRIE_LENGTH, TRIE_ROWS = 120, 24, 2_048
_START = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_TINY, _GREAT = 1e-200, 1e200


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """The vocabulary's pieces in lower case without control and byte pieces, and the length of the longest."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and _LETTERS.fullmatch(piece.removeprefix(_START) or "a"):
            found.setdefault(piece, len(found))
    return found, max(map(len, found), default=1)


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def forward(word: str, table: dict[str, tuple[float, ...]], longest: int, langs: int) -> list[float]:
    """Log-probability of a word in every language, over all segmentations."""
    s = _START + word
    alphas: list[list[float]] = [[1.0] * langs]
    scale = [0.0] * langs
    for j in range(1, len(s) + 1):
        now = [0.0] * langs
        for i in range(max(0, j - longest), j):
            p = table.get(s[i:j])
            if p is None:
                if j - i > 1:
                    continue
                p = (UNKNOWN,) * langs
            a = alphas[i - j]
            for k in range(langs):
                now[k] += a[k] * p[k]
        alphas.append(now)
        if len(alphas) > longest:
            del alphas[0]
        for k in range(langs):
            if now[k] < _TINY:
                for a in alphas:
                    a[k] *= _GREAT
                scale[k] -= math.log(_GREAT)
    return [math.log(a) + c for a, c in zip(alphas[-1], scale)]


def expected(word: str, prob: dict[str, float], longest: int) -> dict[str, float]:
    """Expected number of uses of each piece in a word of one language (forward and backward)."""
    s = _START + word
    n = len(s)
    ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    spans = [(i, j, prob.get(s[i:j], UNKNOWN if j - i == 1 else 0.0)) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
    spans = [x for x in spans if x[2] > 0]
    for i, j, p in spans:
        ahead[j] += ahead[i] * p
    for i, j, p in reversed(spans):
        back[i] += back[j] * p
    out: dict[str, float] = {}
    if ahead[n] > 0:
        for i, j, p in spans:
            if s[i:j] in prob:
                out[s[i:j]] = out.get(s[i:j], 0.0) + ahead[i] * p * back[j] / ahead[n]
    return out


class Trie:
    """The pieces made of the most used letters; ``step`` leads from a node and a letter to a node, 0 stands for none."""

    def __init__(self, vocab: Iterable[str]) -> None:
        vocab = list(vocab)
        letters = [c for c, _ in Counter(c for piece in vocab for c in piece).most_common(TRIE_LETTERS) if c < "\uffff"]
        code = {c: k for k, c in enumerate({_START: 0} | dict.fromkeys(letters), 1)}
        self.width = len(code) + 1
        self.code = np.zeros(0x10000, np.int64)
        self.code[[ord(c) for c in code]] = list(code.values())
        steps, self.nodes = {(1, k): k + 1 for k in code.values()}, {}
        for piece in vocab:
            if all(c in code for c in piece):
                node = 1
                for c in piece:
                    node = steps.setdefault((node, code[c]), len(steps) + 2)
                self.nodes[piece] = node
        self.size = len(steps) + 2
        self.step = np.zeros(self.size * self.width, np.int32)
        self.step[[node * self.width + k for node, k in steps]] = list(steps.values())

    def weights(self, rows: dict[str, tuple[float, ...]], langs: int) -> np.ndarray:
        """Probabilities by node; a single letter that is no piece is unknown."""
        out = np.zeros((self.size, langs))
        out[2 : self.width + 1] = UNKNOWN
        out[list(self.nodes.values())] = [rows[piece] for piece in self.nodes]
        return out

    def groups(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Places of words of one length, and their letters' codes; words with other letters or too long are left out."""
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) <= TRIE_LENGTH:
                by_length.setdefault(len(word), []).append(at)
        for size, places in by_length.items():
            for start in range(0, len(places), TRIE_ROWS):
                part = places[start : start + TRIE_ROWS]
                raw = np.frombuffer("".join([_START + words[at] for at in part]).encode("utf-32-le"), np.uint32)
                codes = self.code[np.minimum(raw, 0xFFFF)].reshape(len(part), size + 1)
                known = codes.all(axis=1)
                yield [at for at, k in zip(part, known) if k], np.ascontiguousarray(codes[known].T)

    def spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, end and node of every span that is a piece's beginning in some word, by ascending start."""
        for i in range(len(codes)):
            node = self.step[self.width + codes[i]]
            yield i, i + 1, node
            for j in range(i + 1, len(codes)):
                node = self.step[node * self.width + codes[j]]
                if not node.any():
                    break
                yield i, j + 1, node

    def forward(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Log-probabilities of words in every language; NaN where the arrays do not reach."""
        out = np.full((len(words), weights.shape[1]), np.nan)
        for places, codes in self.groups(words):
            ahead = np.zeros((len(codes) + 1, len(places), weights.shape[1]))
            ahead[0] = 1.0
            for i, j, node in self.spans(codes):
                ahead[j] += ahead[i] * weights[node]
            out[places] = np.log(np.where(ahead[-1] > _TINY, ahead[-1], np.nan))
        return out

    def expected(self, words: list[str], times: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Expected uses of each node in ``times`` of each word of one language, and the places of the words not counted."""
        total, left = np.zeros(self.size), set(range(len(words)))
        for places, codes in self.groups(words):
            spans = [(i, j, node, weights[node]) for i, j, node in self.spans(codes)]
            ahead = np.zeros((len(codes) + 1, len(places)))
            back = np.zeros_like(ahead)
            ahead[0] = back[-1] = 1.0
            for i, j, _, p in spans:
                ahead[j] += ahead[i] * p
            for i, j, _, p in reversed(spans):
                back[i] += p * back[j]
            sure = ahead[-1] > _TINY
            share = np.where(sure, times[places] / np.where(sure, ahead[-1], 1.0), 0.0)
            for i, j, node, p in spans:
                total += np.bincount(node, ahead[i] * p * back[j] * share, self.size)
            left.difference_update(at for at, s in zip(places, sure) if s)
        return total, sorted(left)


@functools.lru_cache(maxsize=2)
def _trie(path: str) -> Trie:
    return Trie(pieces(path)[0])


@dataclass
class Model:
    """``table``: the probability of each piece of the vocabulary at ``path`` in every language."""

    langs: list[str]
    table: dict[str, tuple[float, ...]]
    longest: int
    path: str
    seen: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    weights: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "rows": None, "weights": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in every language."""
        if self.weights is None:
            self.weights = _trie(self.path).weights(self.table, len(self.langs))
        out = _trie(self.path).forward(words, self.weights)
        for at in np.flatnonzero(np.isnan(out).any(axis=1)):
            out[at] = forward(words[at], self.table, self.longest, len(self.langs))
        return out

    def _learn(self, found: set[str]) -> None:
        """Have all ``found`` words in ``rows``."""
        new = [w for w in found if w not in self.seen]
        if self.rows is None or len(self.seen) + len(new) > len(self.rows):
            self.seen.clear()
            new = list(found)
            self.rows = np.zeros((max(CACHED_WORDS, len(new)), len(self.langs)))
        at = len(self.seen)
        self.rows[at : at + len(new)] = self.scores(new)
        self.seen.update(zip(new, range(at, at + len(new))))

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Language of each text and its probability with equal priors; a text without letters is undetermined."""
        out: list[tuple[str, float]] = []
        waiting: list[list[str]] = []
        letters = 0
        for text in texts:
            waiting.append(words_of(text) if text and self.langs else [])
            letters += len(text or "")
            if letters >= SLICE_LETTERS:
                out += self._judge(waiting)
                waiting, letters = [], 0
        return [*out, *self._judge(waiting)]

    def _judge(self, texts: list[list[str]]) -> Iterator[tuple[str, float]]:
        found = set().union(*texts)
        if found:
            self._learn(found)
        for words in texts:
            if not words:
                yield UNDETERMINED, 0.0
                continue
            total = self.rows[np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(np.argmax(total))
            yield self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS, steps: int = EM_STEPS) -> Model:
    """Fit on at most about ``fit_docs`` whole documents of each language.

    ``docs``: ``doc_id, text, lang``; rows with a null are not used.  A word of more than 64 letters counts as runs of 64.  What reaches the driver is a row per language
    and piece of the vocabulary.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    share = {r.lang: min(1.0, fit_docs / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], {}, 1, path)
    limits = F.create_map(*[F.lit(v) for g in langs for v in (g, int(share[g] * 1_000_000))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < limits[F.col("lang")])
    tokens = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,64}"), F.lit(0))).alias("word"))
    counts = tokens.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # Few bytes but much work per word: spread over the cores instead of merged into few partitions.
    words = cut_lineage(counts.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "word"))
    vocab, longest = pieces(path)
    prob = {g: dict.fromkeys(vocab, 1.0 / len(vocab)) for g in langs}
    for _ in range(steps):
        counts = _expected(words, prob, longest, path).toPandas()
        prob = _smoothed(counts, list(vocab), langs)
    table = {piece: tuple(prob[g][piece] for g in langs) for piece in vocab}
    return Model(langs, table, longest, path)


def _expected(words: DataFrame, prob: dict[str, dict[str, float]], longest: int, path: str) -> DataFrame:
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, total = _trie(path), Counter()
        weights = {lang: trie.weights({piece: (x,) for piece, x in p.items()}, 1)[:, 0] for lang, p in prob.items()}
        for part in parts:
            for lang, rows in part.groupby("lang"):
                own, times = rows["word"].tolist(), rows["n"].to_numpy(float)
                uses, left = trie.expected(own, times, weights[lang])
                for piece, node in trie.nodes.items():
                    total[lang, piece] += uses[node]
                for at in left:
                    for piece, c in expected(own[at], prob[lang], longest).items():
                        total[lang, piece] += c * times[at]
        yield pd.DataFrame([(g, p, float(c)) for (g, p), c in total.items() if c], columns=["lang", "piece", "c"])

    return words.mapInPandas(count, "lang string, piece string, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c"))


def _smoothed(counts: pd.DataFrame, vocab: list[str], langs: list[str]) -> dict[str, dict[str, float]]:
    pooled = counts.groupby("piece")["c"].sum().reindex(vocab, fill_value=0.0) + 0.01
    pooled /= pooled.sum()
    out = {}
    for lang in langs:
        own = counts[counts["lang"] == lang].groupby("piece")["c"].sum().reindex(vocab, fill_value=0.0)
        out[lang] = ((own + POOLED * pooled) / (own.sum() + POOLED)).to_dict()
    return out


def identify(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    The model learns from rows that are not held out and have id, text and language; a prediction reads the whole text and nothing else.
    ``path``: a sentencepiece model that every executor can open.  A null text or one without letters is ``und`` with score 0, as is
    every text if nothing can be learned.  Repeated rows have equal results; an empty table gives no rows.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = named.sparkSession.sparkContext.broadcast(fit(named.where(~held_out(F.col("doc_id"))), path, fit_docs))

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(model.value.predict(batch), columns=["lang_pred", "score"])

    scored = named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run("text").alias("r"))
    return scored.select("doc_id", "held_out", "r.lang_pred", "r.score")
