"""Quality classifier by co-training: one view is what the text says and how, the other what the page's metadata says.

Each view adds up weights: of hashed words and word pairs and of a linear discriminant over shares of characters, or of hashed
metadata values.  In each round both views judge all unlabelled documents and hand what they are sure of to the other, which learns its
weights anew from sums over all of these and the labelled ones.  Each view is calibrated on labelled rows that it has not learnt from, and the
calibrated views are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit may read, chosen by a hash of the id.
FIT_ROWS = 12_000
ROUNDS = 2
#: A pseudo-label is given at this probability or more.
SURE = 0.98
KEEP_AT = 0.5
#: Slots of the hashed words and pairs, and of the hashed metadata values.
WORD_SLOTS = 1 << 16
META_SLOTS = 1 << 14
#: Share of the lowest word weights of a text that are averaged on their own: a few bad words in a long text.
LOW_SHARE = 0.05

_MARKS = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_U64 = np.uint64
#: Documents whose words are held at a time.
_CHUNK = 256


# -- views ----------------------------------------------------------------------------------------

def style(text: str | None) -> np.ndarray:
    """Shares of characters and words: case, digits, marks, repetition."""
    data = (text or "").encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words = data.split()
    m = max(1, len(words))
    upper, lower = count[65:91].sum(), count[97:123].sum()
    same = sum(map(bytes.__eq__, words, words[1:])) / m
    kinds = len(set(words))
    extra = [
        upper, lower, count[48:58].sum(), count[[9, 10, 11, 12, 13, 32]].sum(), count[128:].sum(), count[10], upper / max(1e-9, upper + lower),
        np.sqrt(count[_MARKS].sum()), same, kinds / m, np.log1p(kinds) / np.log1p(m), np.log1p(m), min(n / m, 50.0), float(not words),
    ]
    return np.concatenate([np.sqrt(count[_MARKS]), extra])


STYLE_WIDTH = len(style(None))


def word_slots(text: str | None) -> np.ndarray:
    """Slots of all words, A-Z lower-cased, and of all pairs of neighbours, as often as they occur."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), _U64, len(words))
    pairs = (hashes[:-1] * _U64(0x9E3779B97F4A7C15) + hashes[1:]) * _U64(0xC4CEB9FE1A85EC53)
    shift = _U64(64 - WORD_SLOTS.bit_length() + 1)
    return np.concatenate([hashes >> shift, pairs >> shift]).astype(np.int64)


def meta_slots(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Slots of source and language (null is a value of its own), of both together, and of the stated length by powers of two."""
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    size = f"n{int(np.log2(n_chars + 1) * 2)}" if known else "n-"
    values = [f"s{source}" if source is not None else "s", f"l{lang}" if lang is not None else "l"]
    values.append("\0".join(values))
    return np.array([xxhash.xxh64_intdigest(v.encode()) % META_SLOTS for v in (*values, size)], np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        """Newton steps with a ridge penalty on all but the constant; the step is halved while the loss grows."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
        loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (penalty * w * w).sum() / 2
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = _sigmoid(z @ w)
            slope = z.T @ (p - y) + penalty * w
            move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
            rate = 1.0
            while rate > 1e-3 and loss(w - rate * move) > loss(w):
                rate /= 2
            w = w - rate * move
            if np.abs(rate * move).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


# -- sums over documents --------------------------------------------------------------------------

@dataclass
class Sums:
    """What both views learn from, of bad (0) and good (1) documents: all of it adds up over tasks."""

    style_n: np.ndarray = field(default_factory=lambda: np.zeros(2))
    style_x: np.ndarray = field(default_factory=lambda: np.zeros((2, STYLE_WIDTH)))
    style_xx: np.ndarray = field(default_factory=lambda: np.zeros((STYLE_WIDTH, STYLE_WIDTH)))
    words: np.ndarray = field(default_factory=lambda: np.zeros((2, WORD_SLOTS)))
    meta_n: np.ndarray = field(default_factory=lambda: np.zeros(2))
    meta: np.ndarray = field(default_factory=lambda: np.zeros((2, META_SLOTS)))

    _PARTS = ("style_n", "style_x", "style_xx", "words", "meta_n", "meta")

    def add_text(self, good: int, x: np.ndarray, slots: np.ndarray) -> None:
        self.style_n[good] += 1
        self.style_x[good] += x
        self.style_xx += np.outer(x, x)
        np.add.at(self.words[good], slots, 1.0)

    def add_meta(self, good: int, slots: np.ndarray) -> None:
        self.meta_n[good] += 1
        self.meta[good, slots] += 1

    def cells(self) -> pd.DataFrame:
        """``part, cell, value`` of everything that is not zero."""
        found = []
        for number, name in enumerate(self._PARTS):
            flat = getattr(self, name).ravel()
            at = np.flatnonzero(flat)
            found.append(pd.DataFrame({"part": number, "cell": at, "value": flat[at]}))
        return pd.concat(found, ignore_index=True)

    @classmethod
    def of(cls, cells: pd.DataFrame) -> Sums:
        sums = cls()
        for number, name in enumerate(cls._PARTS):
            own = cells[cells["part"] == number]
            getattr(sums, name).ravel()[own["cell"].to_numpy(np.int64)] = own["value"].to_numpy(float)
        return sums


def _log_odds(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Weights towards good of multinomial naive Bayes."""
    shares = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
    return np.log(shares[1] / shares[0])


@dataclass
class Weights:
    """The two views before calibration."""

    center: np.ndarray
    direction: np.ndarray
    words: np.ndarray
    meta: np.ndarray

    @classmethod
    def fit(cls, sums: Sums) -> Weights:
        """A linear discriminant with a common covariance, and log-odds of words and metadata values."""
        n = np.maximum(sums.style_n, 1.0)
        means = sums.style_x / n[:, None]
        total = max(sums.style_n.sum(), 1.0)
        common = sums.style_xx / total - sum(w / total * np.outer(m, m) for w, m in zip(sums.style_n, means))
        ridge = 1e-6 + 0.01 * np.diag(common).clip(0)
        direction = np.linalg.solve(common + np.diag(ridge), means[1] - means[0])
        presence = (sums.meta + 1.0) / (sums.meta_n[:, None] + 2.0)
        return cls(means.mean(axis=0), direction, _log_odds(sums.words).astype(np.float32), np.log(presence[1] / presence[0]))

    def text(self, x: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Discriminant, mean weight of the words and pairs, mean of the lowest ones."""
        known = self.words[slots]
        if not len(known):
            return np.array([(x - self.center) @ self.direction, 0.0, 0.0])
        few = max(1, int(len(known) * LOW_SHARE))
        return np.array([(x - self.center) @ self.direction, known.mean(), np.partition(known, few - 1)[:few].mean()])

    def metadata(self, slots: np.ndarray) -> np.ndarray:
        return self.meta[slots]


@dataclass
class Model:
    """Without both classes among the labels there are no weights, and every document scores ``prior``."""

    prior: float
    weights: Weights | None = None
    by_text: Logistic | None = None
    by_meta: Logistic | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: probability of good quality by the text, by the metadata, by both, from rows of what the weights say."""
        if self.weights is None:
            return np.full((len(text), 3), self.prior)
        each = self.by_text.margin(text), self.by_meta.margin(meta)
        return np.c_[_sigmoid(each[0]), _sigmoid(each[1]), _sigmoid(each[0] + each[1] - _logit(self.prior))]

    def judge(self, seen: list[Seen]) -> np.ndarray:
        if self.weights is None:
            return np.full((len(seen), 3), self.prior)
        text = np.array([self.weights.text(d.style, d.words) for d in seen]).reshape(-1, 3)
        return self.scores(text, np.array([self.weights.metadata(d.meta) for d in seen]).reshape(-1, 4))


@dataclass
class Seen:
    """What the views see of a document."""

    style: np.ndarray
    words: np.ndarray
    meta: np.ndarray


def _seen(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[Seen]]]:
    """Parts of the documents, nulls as None, with what the views see of them."""
    for start in range(0, len(frame), _CHUNK):
        part = frame.iloc[start : start + _CHUNK].astype(object)
        part = part.where(part.notna(), None)
        yield part, [
            Seen(style(t), word_slots(t), meta_slots(s, g, n)) for t, s, g, n in zip(part["text"], part["source"], part["lang"], part["n_chars"])
        ]


# -- rounds ---------------------------------------------------------------------------------------

def _share(column: str, wanted: int, rows: int) -> Column:
    """About ``wanted`` of ``rows`` rows, the same in every run."""
    return F.pmod(F.xxhash64(column, F.lit("fit")), F.lit(1_000_000)) < int(min(1.0, wanted / max(1, rows)) * 1_000_000)


def sampled_labels(labels: DataFrame, fit_rows: int) -> DataFrame:
    """``label_id, good, held`` of about ``fit_rows`` labelled documents; every third by hash is held for calibration."""
    voted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id"))
    voted = voted.agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    held = F.pmod(F.xxhash64("label_id", F.lit("held")), F.lit(3)) == 2
    return voted.where(_share("label_id", fit_rows, voted.count())).withColumn("held", held)


def _learn(rows: DataFrame, model: Model | None) -> Sums:
    """Sums over all labelled rows to learn from and, given a model, all documents without label that one of its views is sure of."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for frame in parts:
            for part, seen in _seen(frame):
                p = model.judge(seen) if model is not None else None
                for i, (d, good, held) in enumerate(zip(seen, part["good"], part["held"])):
                    by_text = by_meta = good
                    if good is None:  # each view is taught by the other
                        by_text, by_meta = (int(q >= 0.5) if max(q, 1 - q) >= SURE else None for q in (p[i, 1], p[i, 0]))
                    elif held:
                        continue
                    if by_text is not None:
                        sums.add_text(int(by_text), d.style, d.words)
                    if by_meta is not None:
                        sums.add_meta(int(by_meta), d.meta)
        yield sums.cells()

    cells = rows.mapInPandas(add, "part int, cell long, value double").groupBy("part", "cell").agg(F.sum("value").alias("value"))
    return Sums.of(cells.toPandas())  # at most two values for each slot


def _calibrated(weights: Weights, known: DataFrame, prior: float) -> Model:
    """Both views held against the labelled rows kept for that; if these lack a class, against all labelled ones."""

    def shown(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for part, seen in _seen(frame):
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype(int), "good": part["good"].astype(int), "held": part["held"].astype(bool),
                    "text": [weights.text(d.style, d.words).tolist() for d in seen], "meta": [weights.metadata(d.meta).tolist() for d in seen],
                })

    rows = known.mapInPandas(shown, "doc_id long, good int, held boolean, text array<double>, meta array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "good"], kind="stable")  # no more than the sample of labels
    if rows.loc[rows["held"], "good"].nunique() == 2:
        rows = rows[rows["held"]]
    y = rows["good"].to_numpy(float)
    text, meta = (np.array(rows[c].tolist(), float) for c in ("text", "meta"))
    return Model(prior, weights, Logistic.fit(text, y), Logistic.fit(meta, y))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on at most about ``fit_rows`` labelled documents and, for ``rounds`` rounds, all documents without label.

    ``labels``: ``doc_id, quality``; several labels of one document count as their majority, a tie as good.
    Null labels and ids are not used.  The sample of labels is broadcast: its bound is ``fit_rows``.
    """
    chosen = F.broadcast(sampled_labels(labels, fit_rows))
    read = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    rows = read.join(chosen, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    known = read.join(chosen, F.col("doc_id") == F.col("label_id")).drop("label_id")
    count = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    total = sum(count.values())
    if len(count) < 2:
        return Model(float(np.clip(count.get(1, 0) / total if total else 1.0, 0.001, 0.999)))
    prior = float(np.clip(count[1] / total, 0.001, 0.999))
    taught = known.where("NOT held") if known.where("NOT held").select("good").distinct().count() == 2 else known.withColumn("held", F.lit(False))
    model = _calibrated(Weights.fit(_learn(taught, None)), known, prior)
    for _ in range(rounds):
        model = _calibrated(Weights.fit(_learn(rows, model)), known, prior)
    return model


# -- documents ------------------------------------------------------------------------------------

def score(model: Model, spark) -> Column:
    """Struct ``by_text, by_metadata, quality``: probabilities of good quality of a row of documents.

    An empty or null text is judged as a text without words; nulls in the metadata are values of their own.
    """
    held = spark.sparkContext.broadcast(model)  # a few arrays of fixed size

    @F.pandas_udf("by_text double, by_metadata double, quality double")
    def run(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars})
        judged = [held.value.judge(seen) for _, seen in _seen(frame)]
        return pd.DataFrame(np.concatenate(judged) if judged else np.zeros((0, 3)), columns=["by_text", "by_metadata", "quality"])

    return run(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("double"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, by_text, by_metadata, quality, kept``.

    ``kept``: ``quality`` is ``KEEP_AT`` or more.  Repeated rows have equal results; an empty table gives no rows; without labels of
    both classes every document gets their share (all good without any label).  Other columns are not read.
    """
    scored = docs.select("doc_id", score(fit(docs, labels), docs.sparkSession).alias("s"))
    return scored.select("doc_id", "s.by_text", "s.by_metadata", "s.quality", (F.col("s.quality") >= KEEP_AT).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; their columns stay as they are."""
    return docs.where(score(fit(docs, labels), docs.sparkSession)["quality"] >= KEEP_AT)
