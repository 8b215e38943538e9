import hashlib
import re

from scriptorium.llm import decontaminate
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(ids, texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for i, text in zip(ids, texts):
        w, hit, found = words(text), set(), set()
        for k in range(1, 11):
            for s in range(len(w) - k + 1):
                if (gram := tuple(w[s : s + k])) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[gram]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


LONG = "Zero one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (10, "Seven eight, nine"), (2, None), (3, ""), (None, "lonely item here"), (4, "ünï 中文"), (5, "…one"), (5, LONG), (6, "b c d e f g h i j k l m")]
TEXTS = [
    "x " + LONG.upper() + " y", "zero one two three four five six seven EIGHT nine", "one two three four five six seven eight nine",
    "seven-eight!nine seven eight nine", "a lonely item here and", "Ünï 中文 ünï 中文", "a b c d e f g h i j k l m n " * 3, *ODD,
]


def test_equals_brute_force(spark, documents):
    ids = [*range(1, len(TEXTS) - 2), None, 3, 3]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS gram", "2 AS k")
    for max_set in (decontaminate.MAX_SET, 0):  # broadcast and shuffled
        got = decontaminate.contamination(documents(TEXTS, ids, extra=True), bench, max_set=max_set).drop("spans", "text_key")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ids, TEXTS, ITEMS)


def test_spans_and_removal(spark, documents):
    bench = spark.createDataFrame([(1, "b c d"), (2, "d e"), (3, "f g")], "item_id long, text string")
    frame = documents(["A, B-c d! e; f g? h", "clean text", None])
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in decontaminate.contamination(frame, bench).collect()}
    assert got == {1: [(1, 7)], 2: [], 3: []}
    assert {r.doc_id: r.text for r in decontaminate.without_spans(frame, bench).collect()} == {1: "A, h", 2: "clean text", 3: None}
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(documents(["a b"]), none).collect()] == [False]
    assert decontaminate.contamination(documents([]), none).count() == 0
    assert decontaminate.without_spans(documents(["a b"]), none).first().text == "a b"


def test_runs_in_the_jvm(spark, documents):
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    plan = decontaminate.contamination(documents(["a b c d"]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
