import itertools
import math
import re
from collections import Counter

import regex

from scriptorium.llm import urls
from scriptorium.llm.common import table

SCHEMA = "page_id long, url string, html string, tokens string, r string"


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/17?x=/de/", "http://b.com/de/#x", "http://b.com/fr/", "http://com/fr/", "http://xcom/fr/",
    "http://example.org", "http://example.org/", "http://example.org?q=/es/", "ftp://x.net:80/a/b?c#d", "no scheme", "", None, "://", "a://b://c/d", "http://ünï.org/ü", "http://b.com/de/" + "x" * 100_000,
]


def test_rules_equal_brute_force(spark):
    rows = [(i, u, f"<p>cheap pills {i}</p>", "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "x", "y")] * 2
    got = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else URLS[0]
        assert (r.host, r.path) == plain(url)
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))


def test_segmentation_is_the_most_likely_one():
    counts = {"cheap": 5, "pills": 4, "che": 50, "ap": 40, "a": 900, "pill": 30, "s": 100}
    finder = urls.Segmenter(counts)
    for name in ("cheappills", "apcheap", "xyz", "aaas", "pillsx"):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(name) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
            words = [name[i:j] for i, j in zip(edges, edges[1:])]
            score = sum(math.log(counts[w] / finder.total) if w in counts else finder._unknown(len(w)) for w in words)
            best = max(best or (-1e9, []), (score, words))
        found = finder.split(name)
        assert sum(finder.logs.get(w, finder._unknown(len(w))) for w in found) == best[0] or abs(sum(finder.logs.get(w, finder._unknown(len(w))) for w in found) - best[0]) < 1e-9


def test_classifier_learns_from_the_rules(spark):
    rules = [("block", "bad.net/"), ("allow", "good.net/")]
    rows = [(i, f"http://{'cheappills' if i % 2 else 'newsroom'}{i}.{'bad' if i % 2 else 'good'}.net/{'buy' if i % 2 else 'read'}/{i}", "<p>cheap pills news room</p>", "", "") for i in range(60)]
    rows += [(100, "http://pillscheap.info/buy", None, "", ""), (101, "http://roomnews.info/read", None, "", "")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, SCHEMA), rules=rules).collect()}
    assert got[100] == "block" and got[101] == "allow"


def test_weights(spark):
    taught = [("x", "block")] * 3 + [("y", "block")] + [("y", "allow")] * 2
    table, unseen = urls.weights(spark.createDataFrame(taught, "token string, verdict string"))
    weights = {r.token: r.weight for r in table.collect()}
    assert math.isclose(weights["x"], math.log(4 / 7) - math.log(1 / 5)) and math.isclose(unseen, math.log(1 / 7) - math.log(1 / 5))
    assert math.isclose(weights["y"], math.log(2 / 7) - math.log(3 / 5))


def plain_judge(pages, rules=urls.RULES):
    """All counts in memory: rules, words of all pages, the most likely splits, naive Bayes."""
    words = Counter(w for _, _, html in pages for w in regex.findall(r"\p{L}+", re.sub("<[^>]*>", " ", (html or "").lower())))
    finder = urls.Segmenter(words)
    judged = []
    for page, url, _ in pages:
        host, path = plain(url)
        rule, verdict = plain_rule(host, path)
        tokens = []
        for label in regex.findall(r"\p{L}+|\p{Nd}+", host.lower()):
            tokens += [f"h:#{len(label)}"] if label[0].isdigit() else ["h:" + w for w in (finder.split(label) if len(label) <= urls.LABEL else [label])]
        tokens += [f"p:#{len(x)}" if x[0].isdigit() else f"p:{x}" for x in regex.findall(r"\p{L}+|\p{Nd}+", path.lower())]
        judged.append((page, rule, verdict, tokens))
    counts = {v: Counter(t for _, _, verdict, tokens in judged if verdict == v for t in tokens) for v in ("block", "allow")}
    n = {v: sum(verdict == v for _, _, verdict, _ in judged) for v in counts}
    size = len(counts["block"] | counts["allow"]) + 1
    log = lambda v, t: math.log((counts[v][t] + 1) / (sum(counts[v].values()) + size))
    out = {}
    for page, rule, verdict, tokens in judged:
        margin = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(log("block", t) - log("allow", t) for t in tokens)
        score = 1 / (1 + math.exp(-max(-700.0, min(700.0, margin))))
        out[page] = (rule, verdict or ("block" if score > 0.5 else "allow"), score)
    return out


def test_all_verdicts_equal_brute_force(spark, sample):
    pages = table(spark, sample, "pages").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    rows += [(10_000 + i, u, "<p>Grüße aus Köln und Ünï</p>") for i, u in enumerate(URLS)] + [(20_000, f"http://{'long' * 5000}.grüßeausköln.net/Über/12", None)]
    expected = plain_judge(rows)
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        rule, verdict, score = expected[r.page_id]
        assert (r.rule, r.verdict) == (rule, verdict) and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-12), r


def test_no_rows_and_no_labels(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    row = urls.judge(spark.createDataFrame([(1, "http://a.net/b", None, "", "")], SCHEMA)).first()
    assert (row.rule, row.verdict, row.score) == (None, "allow", 0.0)


def test_only_words_inside_labels_are_copied(spark, monkeypatch):
    """The lexicon grows with the pages; what is copied for the salts is what some label contains."""
    lexicon = spark.range(2000).selectExpr("concat('zz', translate(id, '0123456789', 'abcdefghij')) AS word", "id + 1 AS n")
    lexicon = lexicon.unionByName(spark.createDataFrame([("red", 50), ("car", 40), ("dc", 1)], "word string, n long"))
    copied, join = [], urls.salted_join
    monkeypatch.setattr(urls, "salted_join", lambda rows, small, *more: copied.append(small.count()) or join(rows, small, *more))
    got = urls.segmented(spark.createDataFrame([("redcar",)], "label string"), lexicon).collect()
    assert [(r.label, r.words) for r in got] == [("redcar", ["red", "car"])] and copied == [3]
