"""The registered query of every operator, over its whole table, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bond, bpe, cotraining, decontaminate, exact, langid, merkle, quotes, secret_scan, simhash, token_groups, urls, wrappers
from scriptorium.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabularies of the BPE query and of language identification; every executor has the package.
BPE_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def op1_quotation(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as mail threads, each turn quoting the turns before it."""
    linked = quotes.link(quotes.with_quotes(table(spark, folder, "conversations")), "conv_id", "turn", "text")
    return linked.select(
        F.col("thread").alias("conv_id"), F.col("order").alias("turn"), F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"),
        "depth", "n_quoted", "n_linked", F.sha2("own", 256).alias("own_sha256"),
    )


@query()
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents")).drop("found")


@query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents")).drop("text_key")


@query(r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+') AS w FROM benchmark),
win AS (SELECT item_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS gram
        FROM (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+') AS w FROM documents),
g AS (SELECT r, k, unnest(range(0, len(w) - k + 1)) AS s, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS gram
      FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT r, s, g.k, gram FROM g WHERE gram IN (SELECT gram FROM win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
i AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (gram)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
""")
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans", "text_key")


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"), PIECE_FILE)


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents")).drop("n_chunks")


@query()
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), BPE_FILE, keep_ids=False)


@query()
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query()
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(r"""
WITH RECURSIVE
src AS (SELECT doc_id, CAST(lang AS VARCHAR) AS lang, source, n_chars, text, CAST(doc_id AS VARCHAR) AS ds FROM documents),
crc AS (SELECT ds, xor(list_reduce(list_transform(range(1, len(ds) + 1), lambda i: CAST(ascii(ds[i]) AS BIGINT)), lambda c, b:
            list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295), 4294967295) AS c
        FROM (SELECT DISTINCT ds FROM src WHERE ds IS NOT NULL)),
base AS (SELECT src.*, coalesce(c % 7 = 0, FALSE) AS hit,
    coalesce(strlen(ds) || ':' || ds, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS nc,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS nf,
    coalesce(strlen(text) || ':' || text, '-') AS z FROM src LEFT JOIN crc USING (ds)),
leaves AS (SELECT doc_id, sha256(a || nc || z) AS leaf, sha256(a || CASE WHEN hit THEN nf ELSE nc END || z) AS claimed, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM base),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size, row_number() OVER () AS r FROM leaves),
low AS (SELECT tree, size AS cnt, 0 AS lvl, pos AS idx, leaf AS h FROM placed
        UNION ALL SELECT tree, (cnt + 1) // 2, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE cnt > 1 GROUP BY tree, cnt, lvl, idx // 2),
sub AS (SELECT tree, lvl AS height, h FROM low WHERE cnt = 1),
high AS (SELECT (SELECT count(*) FROM sub) AS cnt, 0 AS lvl, tree AS idx, h FROM sub
         UNION ALL SELECT (cnt + 1) // 2, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE cnt > 1 GROUP BY cnt, lvl, idx // 2),
top AS (SELECT h AS root, lvl AS height FROM high WHERE cnt = 1),
steps AS (
    SELECT p.r, p.height + p.lvl AS step, (p.tree >> p.lvl) & 1 AS bit, high.h AS beside
    FROM (SELECT r, tree, sub.height, unnest(range(top.height)) AS lvl FROM placed JOIN sub USING (tree), top) p LEFT JOIN high ON high.lvl = p.lvl AND high.idx = xor(p.tree >> p.lvl, 1)
    UNION ALL SELECT p.r, p.lvl, (p.pos >> p.lvl) & 1, low.h
    FROM (SELECT r, tree, pos, unnest(range(height)) AS lvl FROM placed JOIN sub USING (tree)) p LEFT JOIN low ON low.tree = p.tree AND low.lvl = p.lvl AND low.idx = xor(p.pos >> p.lvl, 1)),
proof AS (SELECT r, sha256(string_agg(coalesce(beside, ''), '' ORDER BY step)) AS p FROM steps GROUP BY r),
fold AS (SELECT r, 0 AS step, claimed AS h FROM placed
         UNION ALL SELECT fold.r, fold.step + 1, sha256(CASE WHEN bit = 1 THEN coalesce(beside, '') || h ELSE h || coalesce(beside, '') END) FROM fold JOIN steps ON steps.r = fold.r AND steps.step = fold.step)
SELECT doc_id, leaf, sub.h AS subroot, root, coalesce(p, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM placed JOIN sub USING (tree) CROSS JOIN top LEFT JOIN proof USING (r)
JOIN fold ON fold.r = placed.r AND fold.step = sub.height + top.height
""")
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document tampered with whose id hashes to a multiple of 7."""
    return merkle.proofs(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


@query(r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, place ORDER BY s.score DESC, s.other_id) AS rank
      FROM p JOIN s ON p.ar = s.ar WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    shown = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return bond.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, shown)


@query(r"""
WITH RECURSIVE
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g
      FROM w WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.g = b.g JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
      GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT r, r AS o FROM w UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.o),
c AS (SELECT r, min(doc_id) AS component_id FROM (SELECT reach.r, w.doc_id FROM reach JOIN w ON w.r = reach.o) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN c USING (r) LEFT JOIN n USING (r)
""")
def op13_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return token_groups.similar_groups(table(spark, folder, "documents"))
