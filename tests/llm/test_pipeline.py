"""Every stage, and the whole run, against plain versions in memory."""

import re
import struct
from hashlib import sha256

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm import cotraining
from scriptorium.llm.common import table


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r)
    return [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = [plain_print(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_clean(rows, benchmark):
    windows = set()
    for item in benchmark:
        w = plain_words(item["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    return [r for r in rows if not hit(plain_words(r["text"]))]


@pytest.fixture(scope="module")
def tables(spark, sample):
    return table(spark, sample, "documents"), table(spark, sample, "benchmark"), table(spark, sample, "labels")


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_equal_plain_versions(spark, sample, tables):
    docs, benchmark, labels = tables
    rows = [r.asDict() for r in docs.collect()]
    kept = {r.doc_id for r in cotraining.quality(docs, labels).where("kept").collect()}
    expected = {
        "quality": [r for r in rows if r["doc_id"] in kept], "exact_dedup": plain_exact(rows), "near_dedup": plain_near(rows),
        "decontamination": plain_clean(rows, [b.asDict() for b in benchmark.collect()]),
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == [*expected, "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sample)
        assert left.columns == docs.columns
        assert ids(left) == sorted(r["doc_id"] for r in expected[name]), name


def test_run_equals_plain_versions(spark, sample, tables):
    docs, benchmark, labels = tables
    good = cotraining.quality(docs, labels).where("kept").select("doc_id")
    rows = [r.asDict() for r in docs.join(good, "doc_id", "left_semi").collect()]
    rows = plain_clean(plain_near(plain_exact(rows)), [b.asDict() for b in benchmark.collect()])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    expected = {}
    for r in rows:
        tokens = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(tokens, skip_special_tokens=False)
        expected[r["doc_id"]] = (len(tokens), sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest(), sha256(decoded.encode()).hexdigest(), tokens)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, sample).collect()}
    assert got == expected and 0 < len(got) < docs.count()


def test_repeated_rows_leave_one(spark, sample, tables):
    """Rows that repeat id and text, ids with two texts, rows without id, and columns with names that are used inside."""
    docs = tables[0].limit(3)
    extra = docs.select(*[F.lit(f"x{i}").alias(c) if c == "source" else F.col(c) for i, c in enumerate(docs.columns)])
    odd = spark.createDataFrame([(9001, "Quite another text than that", "en", "a", 1), (9001, "quite another text than that", "en", "a", 1), (None, None, None, None, None), (None, "", "en", "a", 0), (9002, " \t ", "en", "a", 1)], docs.schema)
    every = docs.unionByName(docs).unionByName(extra).unionByName(odd).selectExpr("*", "1 AS key", "'g' AS gone_id", "2 AS again_n", "3 AS root", "4 AS fp")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, every, sample)
    assert once.columns == every.columns
    assert ids(once.where("doc_id IS NOT NULL AND doc_id < 9000")) == ids(docs)
    assert once.where("text IS NULL OR text = ''").count() == 1 and once.where("doc_id = 9002").count() == 1 and once.where("doc_id = 9001").count() == 2
    near = stages["near_dedup"](spark, every, sample)
    assert near.where("text IS NULL OR trim(BOTH ' \t' FROM text) = ''").count() == 1
    assert near.where("doc_id = 9001").count() == 1
    assert ids(near.where("doc_id < 9000")) == ids(stages["near_dedup"](spark, docs, sample))


def test_stages_on_empty_tables(spark, sample, tables):
    empty = tables[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sample).count() == 0, name
