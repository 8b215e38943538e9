"""Main text of web pages by union-free wrappers of hosts.

A page is a stream of tags and texts.  The streams of all pages of a host are aligned one after the other: where they differ, what only one
has becomes optional, and neighbours that repeat become a repeated group.  A text that is the same on all of them belongs to the wrapper,
any other is a slot.  The main element of a page is its article or main element, else the one with most text in slots; the main text is
what it holds, without menus, notices, comments and the like and without what the wrapper says is its own.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut_lineage, salted_join, written
from scriptorium.llm.urls import host_and_path

#: Streams or wrappers that one task folds into one.
FOLD = 64
#: Different pages that must have a text in one place before it counts as the wrapper's.
FIXED_PAGES = 2
#: The same inside an article, where text is its own more often.
ARTICLE_PAGES = 3
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag on the left ends the open tags on the right, up to the nearest one of ``_SCOPE``.
_ENDS = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article section main body html blockquote td th nav aside header footer form".split())
_INLINE = frozenset(
    "a abbr acronym b basefont bdi bdo big blink cite code data del dfn em font i ins kbd label mark meter nobr output progress q rb rp rt rtc ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre".split())
#: Never part of the main text.
_DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg menu dialog object canvas title".split())
#: Words in class, id or role that mark what surrounds an article.
_AROUND = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu nav navbar "
    "navigation newsletter notice popup promo promoted reactions related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

#: Words in class, id or role that mark an article.
_CONTENT = frozenset("content article main post entry body story".split())

#: The template of pages whose text is below an article; those of others hold a line break.
ARTICLE = "article"
_COMMENTS = frozenset("comment comments disqus respond".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``kind, tag, value``: ``open`` with its attributes, ``close``, ``text``.  Comments, declarations and raw elements are passed over."""
    at = 0
    while match := _TOKEN.search(page, at):
        if match.start() > at:
            yield "text", "", page[at : match.start()]
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            yield "close", tag, ""
        elif tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            yield "open", tag, match[3]
            if match[4] and tag not in _BLOCK:
                yield "close", tag, ""
    if at < len(page):
        yield "text", "", page[at:]


def _label(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role that say what it is for."""
    if not attributes:
        return tag
    words = {w for m in _ATTRIBUTE.finditer(attributes) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w}
    known = sorted(words & (_AROUND | _CONTENT))
    return ".".join([tag, *known])


def stream(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Structure and texts of a page: labels of opened and closed elements with ``#`` for texts, and path and text of each block.

    Missing end tags are supplied; inline elements belong to the block around them.
    """
    shape: list[str] = []
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []

    def flush() -> None:
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            shape.append("#")
            blocks.append(("/".join(label for _, label in stack), words))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            shape.append("/" + stack.pop()[1])

    for kind, tag, value in tokens(page):
        if kind == "text":
            text.append(value)
        elif tag in _INLINE:
            continue
        elif tag in _VOID:
            text.append(" ")
            if tag == "hr":
                flush()
        elif kind == "open":
            flush()
            ends = _ENDS.get(tag, {"p"} if tag in _BLOCK else set())
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    close(depth)
                elif stack[depth][0] in _SCOPE:
                    break
            label = _label(tag, value)
            stack.append((tag, label))
            shape.append(label)
        else:
            depth = max((d for d, (t, _) in enumerate(stack) if t == tag), default=None)
            if depth is not None:
                close(depth)
    close(0)
    return shape, blocks


# -- wrappers -------------------------------------------------------------------------------------
# A wrapper is a list of nodes [label, count, children]: label "#" for a text, "()" for a group of neighbours; count "" for
# once, "?" for optional, "+" for repeated, "*" for both.  A text has a fourth part: on how many pages it was found, and the hashes
# of the texts that stand there on every one of them; what else stands there fills a slot.

_GROUP = 6


def text_hash(words: str) -> int:
    """As Spark's xxhash64."""
    value = xxhash.xxh64_intdigest(words.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def tree(shape: list[str], texts: list[str] | None = None) -> list:
    """The nodes of one page, each once; with its ``texts`` they are known by their hashes."""
    levels: list[list] = [[]]
    told = iter(texts or [])
    for part in shape:
        if part == "#":
            levels[-1].append(["#", "", []] if texts is None else ["#", "", [], [1, [text_hash(next(told))]]])
        elif part[0] == "/":
            levels.pop()
        else:
            node = [part, "", []]
            levels[-1].append(node)
            levels.append(node[2])
    return folded(levels[0])


def _key(node: list) -> str:
    return node[0] if node[0] != "()" else "()" + ",".join(map(_key, node[2]))


def _count(counts: list[str], repeated: bool = False) -> str:
    """Of one node that stands for several: optional if any is (if it repeats, if all are)."""
    optional = (all if repeated else any)(c in ("?", "*") for c in counts)
    repeated = repeated or any(c in ("+", "*") for c in counts)
    return ("*" if optional else "+") if repeated else "?" if optional else ""


def folded(nodes: list) -> list:
    """Neighbours that repeat, as one repeated node or group, inside out."""
    out = [[label, count, folded(children), *text] for label, count, children, *text in nodes]
    for size in range(1, _GROUP + 1):
        i = 0
        while i + 2 * size <= len(out):
            keys = list(map(_key, out[i : i + size]))
            if list(map(_key, out[i + size : i + 2 * size])) != keys:
                i += 1
                continue
            runs, j = [], i
            while list(map(_key, out[j : j + size])) == keys:
                runs.append(out[j : j + size])
                j += size
            merged = runs[0]
            for run in runs[1:]:
                merged = [_joined(x, y) for x, y in zip(merged, run)]
            if size == 1:
                merged[0][1] = _count([run[0][1] for run in runs], repeated=True)
                out[i:j] = merged
            else:
                out[i:j] = [["()", "+", merged]]
            i += 1
    return out


def _joined(x: list, y: list, pages: bool = False) -> list:
    return [x[0], _count([x[1], y[1]]), aligned(x[2], y[2], pages), *_texts(x, y, pages)]


def _texts(x: list, y: list, pages: bool) -> list:
    """Of one place on other ``pages``, the texts that both have; neighbours on one page have theirs together, if neither is optional."""
    if len(x) < 4 or len(y) < 4:
        return []
    (n, some), (m, more) = x[3], y[3]
    both = pages or {x[1], y[1]} & {"?", "*"}
    return [[n + m if pages else max(n, m), sorted(set(some) & set(more) if both else {*some, *more})]]


def aligned(a: list, b: list, pages: bool = False) -> list:
    """A wrapper that accepts what either accepts: matching nodes are joined, the others become optional, one after the other.

    ``pages``: whether the two are of different pages, so that their texts are compared.
    """
    out: list = []
    matcher = difflib.SequenceMatcher(None, list(map(_key, a)), list(map(_key, b)), autojunk=False)
    for kind, i, j, k, m in matcher.get_opcodes():
        if kind == "equal":
            out += [_joined(x, y, pages) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[label, _count([count, "?"]), children, *text] for label, count, children, *text in a[i:j] + b[k:m]]
    return out


def fixed_texts(nodes: list, path: tuple[str, ...] = (), least: int = FIXED_PAGES) -> set[tuple[str, int]]:
    """Path and hash of the wrapper's own texts: there on all of ``least`` pages or more that have their place."""
    found: set[tuple[str, int]] = set()
    for label, _, children, *text in nodes:
        if label != "#":
            found |= fixed_texts(children, path if label == "()" else (*path, label), least)
        elif text and text[0][0] >= least:
            found |= {("/".join(path), t) for t in text[0][1]}
    return found


def slots(nodes: list, path: tuple[str, ...] = ()) -> set[str]:
    """Paths of the text slots of a wrapper."""
    found: set[str] = set()
    for label, _, children, *_text in nodes:
        if label == "#":
            found.add("/".join(path))
        else:
            found |= slots(children, path if label == "()" else (*path, label))
    return found


def _around(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in _DROPPED or bool(_AROUND & set(words))


def _plain(label: str) -> bool:
    """Whether only a word list or ``form`` can make the element one that surrounds articles."""
    tag = label.split(".")[0]
    return tag == "form" or tag not in _DROPPED


def _wrapping(chars: dict[str, int]) -> tuple[set[str], set[str]]:
    """Elements that hold most of a page's text, by path, which are not judged by ``_AROUND`` or as forms.

    First those around an article, main or h1 or with a word of content, but not comments; then all that hold other elements than paragraphs and the like.
    ``chars``: characters of each block path.
    """
    held: dict[str, int] = {}
    sure: set[str] = set()
    nested: set[str] = set()
    for path, n in chars.items():
        labels = path.split("/")
        for depth in range(1, len(labels) + 1):
            above = "/".join(labels[:depth])
            held[above] = held.get(above, 0) + n
            below = labels[depth:]
            words = set(labels[depth - 1].split(".")[1:])
            if words & _COMMENTS:
                pass
            elif words & _CONTENT or any(x.split(".")[0] in ("article", "main", "h1") and not _around(x) for x in below):
                sure.add(above)
            if any(x.split(".")[0] not in _LEAF for x in below):
                nested.add(above)
    half = sum(n for p, n in chars.items() if all(map(_plain, p.split("/")))) / 2
    most = {p for p, n in held.items() if n > half and _plain(p.rpartition("/")[2])}
    return most & sure, most & (sure | nested)


def _inside(split: dict[str, list[str]], tag: str, wrapping: set[str]) -> set[str]:
    """The blocks below the outermost elements ``tag`` that nothing around them rules out.

    Inside, what is no main text by its tag goes, headers too; what only its class speaks against goes unless nothing else is there.
    """
    sure, doubtful, kept = set(), set(), set()
    for path, labels in split.items():
        at = next((i for i, x in enumerate(labels) if x.split(".")[0] == tag), None)
        if at is None or not _clear(labels[:at], wrapping):
            continue
        below = [x.split(".") for x in labels[at + 1 :]]
        kept.add(path)
        if any(x[0] in _DROPPED or x[0] == "header" for x in below):
            continue
        (doubtful if any(_AROUND & set(x[1:]) for x in below) or _AROUND & set(labels[at].split(".")[1:]) else sure).add(path)
    return sure or doubtful or {p for p in kept if not any(x.split(".")[0] in _DROPPED for x in split[p])}


def _clear(labels: list[str], wrapping: set[str]) -> bool:
    """Whether no element on the way surrounds articles; html, body and what wraps the page do not by their class."""
    return not any(_around(x) and x.split(".")[0] not in ("html", "body") and "/".join(labels[: i + 1]) not in wrapping for i, x in enumerate(labels))


def page_slots(chars: dict[str, int]) -> tuple[str, set[str]]:
    """What the main text of one page is below, ``article``, ``main`` or neither (``""``), and the paths of its blocks there.

    Nothing in an element that surrounds articles counts, nor in a header.  Body and what wraps the page
    do not surround by their class, see ``_wrapping``.  ``chars``: characters of each block path.
    """
    split = {p: p.split("/") if p else [] for p in chars}
    sure, nested = _wrapping(chars) if not all(_clear(s, set()) for s in split.values()) else (set(), set())
    outer = [s[: next((i for i, x in enumerate(s) if x.split(".")[0] in ("article", "main")), len(s))] for s in split.values()]
    wrapping = sure if any(_clear(s, sure) for s in outer) else nested
    for tag in ("article", "main"):
        if below := _inside(split, tag, wrapping):
            return tag, below
    usable = {p: s for p, s in split.items() if _clear(s, wrapping)}
    return "", {p for p, s in usable.items() if not any(x.split(".")[0] == "header" for x in s)}


def _parent(path: str) -> str:
    """The element that a block counts for: that of a paragraph, heading or item is the one around it."""
    up, _, last = path.rpartition("/")
    return up if last.split(".")[0] in _LEAF else path


def _box(path: str) -> str:
    """The element inside the outermost article that a block counts for, empty if it is the article itself."""
    labels = _parent(path).split("/")
    at = next(i for i, x in enumerate(path.split("/")) if x.split(".")[0] == "article")
    return "/".join(labels) if len(labels) > at + 1 else ""


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` from ``host, html``: each host's wrapper as JSON."""

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"host": part["host"], "wrapper": [_shown(*stream(page)) for page in part["html"]]})

    return wrapped(pages.select("host", "html").mapInPandas(shapes, "host string, wrapper string"))


def _shown(shape: list[str], blocks: list[tuple[str, str]]) -> str:
    return json.dumps(tree(shape, [words for _, words in blocks]))


def wrapped(shapes: DataFrame) -> DataFrame:
    """``host, wrapper`` of the pages ``shapes`` (``host, wrapper``, each page's own).

    Equal pages are counted once; the others are folded in tasks of about ``FOLD``, level by level, until one wrapper per
    host is left.  All pages take part.
    """
    now = shapes.distinct()
    while True:
        now = written(now, "wrappers")
        counts = now.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        # Hashed into n / FOLD groups, or into one when they fit.
        groups = counts.select("host", F.ceil(F.col("n") / FOLD).alias("groups"))
        dealt = now.join(groups, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("groups")))
        now = dealt.groupBy("host", "part").applyInPandas(_fold, "host string, wrapper string")
    return now


def _fold(part: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(part["wrapper"], key=lambda w: (len(w), w))
    wrapper = json.loads(rows[0])
    for row in rows[1:]:
        other = json.loads(row)
        if other != wrapper:
            wrapper = folded(aligned(wrapper, other, pages=True))
    return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})


def _fixed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for host, wrapper in zip(part["host"], part["wrapper"]):
            nodes = json.loads(wrapper)
            often = fixed_texts(nodes, least=ARTICLE_PAGES)
            rows += [(host, path, text, (path, text) in often) for path, text in fixed_texts(nodes)]
        yield pd.DataFrame(rows, columns=["host", "path", "hash", "often"])


def _marked(blocks: DataFrame, fixed: DataFrame, words: str | Column) -> DataFrame:
    """``blocks`` (``row, host, path``) with ``fixed``: whether their ``words`` in this place are in ``fixed`` (``host, path, hash``), else null."""
    key = F.xxhash64("host", "path", "hash")
    # The join goes by one hash of host, path and text; a text that shares it by chance would be left out too.
    known = fixed.select(key.alias("key"), F.lit(True).alias("fixed")).distinct()
    return salted_join(blocks.withColumn("hash", F.xxhash64(words)).withColumn("key", key), known, "key", "row", "left").drop("key", "hash")


def boxes(parsed: DataFrame, fixed: DataFrame) -> DataFrame:
    """``row, boxes`` of article pages (``row, host, blocks``): the places of blocks in elements inside the article in which no page of the host has
    any text but the wrapper's; pages without such have no row.

    What stands in the article itself, and elements that any page fills with other text, are the article's.
    """
    each = parsed.select("row", "host", F.posexplode("blocks").alias("place", "b")).where("b.parent <> ''")
    inner = each.select("row", "host", "place", "b.path", F.xxhash64("host", "b.parent").alias("element"), F.col("b.words").alias("words"))
    marked = cut_lineage(_marked(inner, fixed.where("often"), "words").select("row", "place", "element", "fixed"))
    # An element that shares its hash by chance with one of other text is kept.
    constant = marked.groupBy("element").agg(F.count("*").alias("n"), F.count("fixed").alias("of_wrapper")).where("n = of_wrapper").select("element")
    return salted_join(marked.drop("fixed"), constant, "element", "row").groupBy("row").agg(F.collect_set("place").alias("boxes"))


def slotted(parsed: DataFrame, fixed: DataFrame) -> DataFrame:
    """``row, words`` of the pages ``parsed`` (``row, host, template, blocks``): what fills the slots of their main element.

    A template is the set of elements that hold a page's blocks, so pages of one host that are built differently are judged apart; its main
    element is the one whose slots hold most text over its pages.  The wrapper's own texts are left out, unless nothing else is there.
    """
    each = parsed.select("row", "host", "template", F.posexplode("blocks").alias("place", "b")).select("row", "host", "template", "place", "b.*")
    marked = cut_lineage(_marked(each, fixed, "words"))
    size = F.length("words")
    mass = marked.groupBy("host", "template", "parent").agg(F.sum(F.when(F.col("fixed"), 0).otherwise(size)).alias("own"), F.sum(size).alias("size"))
    best = mass.groupBy("host", "template").agg(F.min(F.struct(-F.col("own"), -F.col("size"), "parent"))["parent"].alias("best"))
    named = best.select(F.xxhash64("host", "template").alias("key"), "best")
    placed = salted_join(marked.withColumn("key", F.xxhash64("host", "template")), named, "key", "row")
    below = (F.col("best") == "") | (F.col("path") == F.col("best")) | F.startswith(F.col("path"), F.concat("best", F.lit("/")))
    gathered = placed.where(below).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "words", F.coalesce("fixed", F.lit(False)).alias("fixed")))).alias("all"))
    own = F.filter("all", lambda b: ~b["fixed"])
    return gathered.select("row", F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("all")), lambda b: b["words"]).alias("words"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars, n_blocks``.

    All pages of a host are aligned into its wrapper.  ``text``: of a page with an article what is below it, but for elements in which the
    wrapper knows only texts of its own (on ``ARTICLE_PAGES`` different pages or more, and on none another); of others what fills the wrapper's
    slots below the main element, else below the best element of the template; in page order, joined by a newline.  A host with a single
    page, or copies of one, has no text of its wrapper's own: there all blocks below the element count.  Character references decoded, white
    space in a block as one space.  Null and empty pages have an empty text.  Urls without host count as one host.  Repeated rows have equal
    results; an empty table gives no rows; other columns are not read.
    """

    @F.pandas_udf("template string, shape string, blocks array<struct<path string, parent string, words string>>")
    def parse(htmls: pd.Series) -> pd.DataFrame:
        rows = []
        for page in htmls:
            shape, blocks = stream(page)
            chars: dict[str, int] = {}
            for path, words in blocks:
                chars[path] = chars.get(path, 0) + len(words)
            below, paths = page_slots(chars)
            if below == "article":
                parents, template = {p: _box(p) for p in paths}, ARTICLE
            else:
                parents = {p: "" if below else _parent(p) for p in paths}
                template = below + "\n" + "\n".join(sorted(set(parents.values()))) if paths else None
            held = [{"path": p, "parent": parents[p], "words": w} for p, w in blocks if p in paths]
            rows.append((template, _shown(shape, blocks) if paths else None, held))
        return pd.DataFrame(rows, columns=["template", "shape", "blocks"])

    host = F.coalesce(host_and_path(F.col(url))[0], F.lit(""))
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), parse(F.coalesce(F.col(html), F.lit(""))).alias("r"))
    parsed = written(read.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "host", "r.*"), "parsed")
    shapes = parsed.where("template IS NOT NULL").select("host", F.col("shape").alias("wrapper"))
    fixed = cut_lineage(wrapped(shapes).mapInPandas(_fixed, "host string, path string, hash long, often boolean").distinct())
    article = parsed.where(F.col("template") == ARTICLE)
    boxed = written(boxes(article.select("row", "host", "blocks"), fixed), "boxes")
    all_words = F.transform("blocks", lambda b: b["words"])
    done = parsed.where("template IS NULL").select("page_id", "url", all_words.alias("words"))
    if boxed.isEmpty():
        done = done.unionByName(article.select("page_id", "url", all_words.alias("words")))
    else:
        some = article.select("page_id", "url", "row", "blocks").join(boxed, "row", "left")
        own = F.filter("blocks", lambda b, i: F.coalesce(~F.array_contains("boxes", i), F.lit(True)))
        kept = F.when(F.size(own) > 0, F.transform(own, lambda b: b["words"])).otherwise(all_words)
        done = done.unionByName(some.select("page_id", "url", kept.alias("words")))
    bare = parsed.where(F.col("template") != ARTICLE)
    if not bare.isEmpty():
        found = bare.select("page_id", "url", "row").join(slotted(bare.select("row", "host", "template", "blocks"), fixed), "row")
        done = done.unionByName(found.select("page_id", "url", "words"))
    told = done.withColumn("text", F.array_join("words", "\n"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("words").alias("n_blocks"))
