import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts; ids count from 1 unless given."""

    def make(texts, ids=None, extra=False):
        ids = list(ids) if ids is not None else range(1, len(texts) + 1)
        rows = [(i, t, "en", "src1", len(t or "")) for i, t in zip(ids, texts)]
        frame = spark.createDataFrame(rows, DOCS)
        if extra:  # names that the operators use inside
            for name in ("key", "fp", "recipe", "hash", "w", "n", "text_key", "gone_id", "label_id", "start", "gram", "norm", "words", "kind"):
                frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make


#: Null, empty, white space only, a very long text, ties and repeated rows.
ODD = [None, "", " \t\n ", "a b", "a  b", "a b", "word " * 60_000, None, "ünï çödé 中文 \U0001f600 x", "x" * 100_000]
