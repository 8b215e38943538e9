import hashlib
import re

import pytest

from scriptorium.llm import exact
from tests.llm.conftest import ODD


def brute(ids, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    out = []
    for i, t in zip(ids, norm):
        group = [j for j, u in zip(ids, norm) if u == t]
        known = [j for j in group if j is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r) for r in frame.drop("n_chunks").collect()), key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force_even_if_identifiers_are_shared(spark, documents, bits):
    """With three bits nearly every chunk shares its identifier with another one."""
    words = ["alpha", "beta", "gamma", "rat", "bed me "]
    texts = ODD + [" ".join(words[(i * j) % 5] for j in range(1, 40 * i)) for i in range(1, 12)] * 2 + ["a\tb", "a\r\n\x0b b "]
    ids = [7, 3, None, 9, 2, 2, 11, 5, 1, 4, *range(20, 20 + len(texts) - 10)]
    assert rows(exact.exact_groups(documents(texts, ids, extra=True), bits=bits)) == brute(ids, texts)


def test_chunks_are_cut_by_content(spark, documents):
    body = " ".join(f"w{i * 7919 % 1000}" + " late" * (i * i % 61 == 3) for i in range(3000))
    frame = documents([body, "A new beginning. " + body])
    cut = frame.selectExpr("doc_id", f"explode(regexp_extract_all(text, r'{exact.CHUNK}', 0)) AS c").groupBy("c").count()
    assert cut.where("count = 2").count() > 0.8 * cut.count()


def test_no_rows(documents):
    assert exact.exact_groups(documents([])).count() == 0


def test_drop_copies_keeps_columns_and_rows(documents):
    frame = documents(["a b", "a  b", None, "", "c", "c"], [4, 1, None, None, 6, 6], extra=True)
    left = exact.drop_copies(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "a  b"), (6, "c")]
