"""URL filter: rules first, then words of host and path weighed by multinomial naive Bayes.

Names run words together, so host labels are split into words by a unigram Viterbi search over the words that the pages
themselves use.  The urls that a rule judges teach the classifier; it judges the others.  Word and token counts are tables
over all pages: labels meet the words they contain, and pages the weights of their tokens, in joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import ascii_lower, cut_lineage, salted_join, written

#: Verdict, host and path of each rule; a host stands for its subdomains too.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Letters of a host label by the rules of domain names; a longer run of letters is no name and counts as one word.
LABEL = 63
SMOOTHING = 1.0
_RUNS = r"\p{L}+|\p{Nd}+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """Struct ``verdict, rule`` of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    fits = []
    for verdict, rule in ordered:
        name, _, rest = rule.partition("/")
        fit = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        fits.append(F.when(fit, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


# -- words of host labels -------------------------------------------------------------------------

class Segmenter:
    """The most likely split of a name into words; letters outside the vocabulary cost more the longer they run.

    ``counts`` need hold no other words than those inside the name; ``total`` counts all words.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.logs = {w: math.log(n / self.total) for w, n in counts.items()}

    def _unknown(self, size: int) -> float:
        return -math.log(self.total) - size * math.log(10)

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            scores = [(best[i] + self.logs.get(name[i:j], self._unknown(j - i)), i) for i in range(j)]
            score, i = max(scores)
            best.append(score)
            back.append(i)
        words, j = [], len(name)
        while j:
            words.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(words))


def word_counts(pages: DataFrame, text: str) -> DataFrame:
    """``word, n`` of all words between the markup of all pages, lower-cased."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``label, words`` of the distinct ``labels`` (letters only): each meets those words of the whole lexicon that it contains."""
    total = int(lexicon.agg(F.sum("n")).first()[0] or 0)
    size = F.length("label")
    inside = lambda i: F.transform(F.sequence(i, size), lambda j: F.substring(F.col("label"), i, j - i + 1))
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), inside)))
    names = labels.where(size <= LABEL)
    inside_names = names.select("label", F.explode(parts).alias("word"))
    # Only the words that some label contains are copied for the salts; the lexicon itself is moved once at most.
    asked = cut_lineage(lexicon.join(inside_names.select("word").distinct(), "word", "left_semi"))
    found = salted_join(inside_names, asked, "word", "label")
    known = found.groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(names: pd.Series, known: pd.Series) -> pd.Series:
        counts = [{w["word"]: w["n"] for w in k} if k is not None else {} for k in known]
        return pd.Series([list(Segmenter(c, total).split(n)) for n, c in zip(names, counts)])

    cut = names.join(known, "label", "left").select("label", split("label", "known").alias("words"))
    return cut.unionByName(labels.where(size > LABEL).select("label", F.array("label").alias("words")))


def _numbers(runs: Column) -> Column:
    return F.transform(F.filter(runs, lambda r: r.rlike(r"^\p{Nd}")), lambda r: F.concat(F.lit("#"), F.length(r).cast("string")))


def _names(runs: Column) -> Column:
    return F.filter(runs, lambda r: ~r.rlike(r"^\p{Nd}"))


def tokens(base: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``row, token`` of the urls in ``base`` (``row, host, path``): words of the host with ``h:``, pieces of the path with ``p:``; a number
    counts by its length.  A token is there as often as it occurs."""
    runs = lambda text: F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0))
    hosts = cut_lineage(base.select("host").distinct().select("host", runs(F.col("host")).alias("runs")))
    labels = hosts.select("host", F.explode(_names(F.col("runs"))).alias("label"))
    words = segmented(cut_lineage(labels.select("label").distinct()), lexicon)
    of_label = salted_join(labels, words, "label", "host").select("host", F.explode("words").alias("t"))
    of_host = of_label.unionByName(hosts.select("host", F.explode(_numbers(F.col("runs"))).alias("t")))
    gathered = of_host.groupBy("host").agg(F.collect_list(F.concat(F.lit("h:"), "t")).alias("of_host"))
    pieces = runs(F.col("path"))
    of_path = F.transform(F.concat(_names(pieces), _numbers(pieces)), lambda t: F.concat(F.lit("p:"), t))
    every = salted_join(base.select("row", "host", of_path.alias("of_path")), gathered, "host", "row", "left")
    none = F.array().cast("array<string>")
    return every.select("row", F.explode(F.concat(F.coalesce("of_host", none), "of_path")).alias("token"))


# -- the classifier -------------------------------------------------------------------------------

def weights(taught: DataFrame) -> tuple[DataFrame, float]:
    """``token, weight`` towards block of every token of the judged urls (``token, verdict``), and the weight of any other token."""
    block, allow = F.sum((F.col("verdict") == "block").cast("long")), F.sum((F.col("verdict") == "allow").cast("long"))
    counts = cut_lineage(taught.groupBy("token").agg(block.alias("b"), allow.alias("a")))
    size, b, a = (float(x or 0) for x in counts.agg(F.count("*"), F.sum("b"), F.sum("a")).first())
    b, a = b + SMOOTHING * (size + 1), a + SMOOTHING * (size + 1)
    weight = F.log((F.col("b") + SMOOTHING) / b) - F.log((F.col("a") + SMOOTHING) / a)
    return counts.select("token", weight.alias("weight")), math.log(SMOOTHING / b) - math.log(SMOOTHING / a)


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "html", rules: Iterable[tuple[str, str]] = RULES,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, score``.

    ``rule`` is null where none fits; there ``verdict`` is block if the classifier's ``score`` (probability of block) is over one half.
    With no url that a rule blocks or none that one allows, what no rule judges is allowed (score 0).  A url without host and path
    (null, empty, no ``://``) has no tokens: the prior judges it.  A run of more than ``LABEL`` letters in a host is one word.  Repeated rows
    have equal results; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    named = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    named = named.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict")
    base = cut_lineage(named).withColumn("row", F.monotonically_increasing_id())
    verdicts = {r.verdict: r["count"] for r in base.where("rule IS NOT NULL").groupBy("verdict").count().collect()}
    if len(verdicts) == 2:
        found = cut_lineage(tokens(base, written(word_counts(pages, text), "words")))
        judged = base.where("rule IS NOT NULL").select("row", "verdict")
        table, unseen = weights(found.join(judged, "row"))
        prior = math.log((verdicts["block"] + 1) / (verdicts["allow"] + 1))
        weighed = salted_join(found, table, "token", "row", "left").groupBy("row").agg(F.sum(F.coalesce("weight", F.lit(unseen))).alias("sum"))
        margin = F.lit(prior) + F.coalesce("sum", F.lit(0.0))
        scored = base.join(weighed, "row", "left").withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(700.0)), F.lit(-700.0)))))
    else:
        scored = base.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
