import numpy as np

from scriptorium.llm import cotraining
from scriptorium.llm.common import table
from tests.llm.conftest import ODD

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, sample):
    """Fit on the labels of two thirds of the documents and judge the rest."""
    folder = sample.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = cotraining.quality(docs, labels.where("doc_id % 3 != 0"))
    rows = scored.join(labels.where("doc_id % 3 = 0").selectExpr("doc_id", "quality = 1 AS good"), "doc_id").collect()
    right = np.array([r.kept == r.good for r in rows])
    assert len(rows) > 50 and right.mean() > 0.95


def test_pseudo_labels_pass_between_the_views(spark):
    """All labelled documents are of one source, so only what the text view is sure of tells the others apart."""
    rng = np.random.default_rng(1)
    word = lambda good: rng.choice(["calm", "clear", "plain", "told"] if good else ["buy", "cheap", "win", "now"])
    text = lambda good: " ".join([word(good) for _ in range(30)] + [f"w{n}" for n in rng.integers(0, 40, 30)])
    rows = [(i, text(i % 2), "labelled", "en", 9) for i in range(120)]
    rows += [(1000 + i, text(i % 2), "press" if i % 2 else "mill", "en", 9) for i in range(400)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, i % 2, 0) for i in range(120)], LABELS)
    apart = []
    for rounds in (0, 2):
        weights = cotraining.fit(docs, labels, rounds=rounds).weights
        press, mill = (weights.metadata(cotraining.meta_slots(s, "en", 9)).sum() for s in ("press", "mill"))
        apart.append(press - mill)
    assert apart[0] == 0 and apart[1] > 5


def test_the_text_view_reads_words():
    one, two = "The cat sat on the mat and ate.", "The dog bit on the leg and ran."
    assert np.allclose(cotraining.style(one), cotraining.style(two))
    assert sorted(cotraining.word_slots(one)) != sorted(cotraining.word_slots(two))
    assert len(cotraining.word_slots(one)) == 8 + 7 and len(cotraining.word_slots(None)) == 0
    assert (cotraining.word_slots("A b") == cotraining.word_slots("a  B")).all()


def test_bad_words_in_ordinary_prose_are_learnt(spark):
    """A few words of a long text decide, whatever the source."""
    rng = np.random.default_rng(2)
    prose = lambda: [f"w{n}" for n in rng.integers(0, 300, 200)]
    rows = [(i, " ".join(prose() + ["vile", "slur"] * (2 * (i % 2 == 0))), f"s{rng.integers(5)}", "en", 9) for i in range(400)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, i % 2, 0) for i in range(250)], LABELS)
    got = {r.doc_id: r.kept for r in cotraining.quality(docs, labels).collect()}
    assert np.mean([got[i] == (i % 2 == 1) for i in range(250, 400)]) > 0.95


def test_sums_add_up_over_parts(spark):
    """Sums of tasks, sent as cells, are those of all documents at once."""
    texts = ["a b c", "", None, "B c d e", "! ?"]
    whole, parts = cotraining.Sums(), [cotraining.Sums(), cotraining.Sums()]
    for i, t in enumerate(texts):
        for s in (whole, parts[i % 2]):
            s.add_text(i % 2, cotraining.style(t), cotraining.word_slots(t))
            s.add_meta(i % 2, cotraining.meta_slots(None, "en", i))
    import pandas as pd

    cells = pd.concat([p.cells() for p in parts]).groupby(["part", "cell"], as_index=False)["value"].sum()
    again = cotraining.Sums.of(cells)
    for name in cotraining.Sums._PARTS:
        assert np.allclose(getattr(again, name), getattr(whole, name))


def test_odd_rows_and_missing_labels(spark, documents):
    frame = documents(ODD, extra=True).selectExpr("doc_id", "text", "nullif(lang, 'en') AS lang", "source", "nullif(n_chars, 0) AS n_chars", "w", "n", "kind AS good", "start AS held", "gone_id AS label_id")
    none = spark.createDataFrame([], LABELS)
    rows = cotraining.quality(frame, none).collect()
    assert len(rows) == len(ODD) and all(r.kept and 0 <= r.quality <= 1 for r in rows)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 1), (4, 0, 0), (5, 0, 0), (7, 1, 0), (9, 1, 0)], LABELS)
    left = cotraining.keep_good(frame, some)
    assert left.columns == frame.columns and left.count() <= len(ODD)
    assert cotraining.quality(documents([]), some).count() == 0
