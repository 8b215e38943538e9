import html
import re

from scriptorium.llm import wrappers
from scriptorium.llm.common import table

SCHEMA = "page_id long, url string, html string, host string, content string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>First&nbsp;par &amp; <b>bold</b>
 text<p>Second {title}<ul><li>item<li>other</ul><div class="ad">Buy</div><aside>See also</aside><form><label>Mail</label><input></form>
<!-- no <p>comment</p> --></article><div id="comments"><p>Reader says</p></div><footer>&copy; us</footer></body></html>"""


def rows(spark, pages):
    frame = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], SCHEMA)
    return {r.page_id: r for r in wrappers.extract(frame).collect()}


def test_article_without_its_surroundings(spark):
    got = rows(spark, [("http://a.org/1", PAGE.format(title="Cats")), ("http://a.org/2", PAGE.format(title="Dogs").replace("<h1>Dogs</h1>", "").replace("<li>other", ""))])
    assert got[0].text == "Cats\nFirst par & bold text\nSecond Cats\nitem\nother" and got[0].n_chars == len(got[0].text)
    assert got[1].text == "First par & bold text\nSecond Dogs\nitem"


def test_page_without_article_element(spark):
    page = "<body><div class='menu'><a>Home page of us</a></div><div><h2>{0}</h2><p>{0} long text of the page, told at some length.</p><p>More of {0}.</p></div><div class='sidebar'>Side</div></body>"
    got = rows(spark, [(f"http://b.org/{i}", page.format(t)) for i, t in enumerate(("Red", "Blue"))])
    assert got[0].text == "Red\nRed long text of the page, told at some length.\nMore of Red."


def test_odd_pages(spark):
    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    pages = [("http://c.org/", None), ("http://c.org/", ""), (None, "<article><p>x"), ("http://c.org/", "no markup at all"), ("http://c.org/", long), ("http://c.org/", long), ("", "<<p>></p><article>a < b &lt;i&gt; &#x1F600;</b></article"), ("http://d.org/", "<p>Only\n\n a\tparagraph</p>")]
    got = rows(spark, pages)
    assert [got[i].text for i in (0, 1, 2)] == ["", "", "x"]
    assert got[4].n_blocks == got[5].n_blocks == 30_000
    assert got[6].text.startswith("a < b <i> \U0001f600") and got[7].text == "Only a paragraph"
    assert rows(spark, []) == {}


def test_sample_pages_equal_their_article(spark, sample):
    pages = table(spark, sample, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in wrappers.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, blocks))


def test_alignment():
    page = lambda *parts: wrappers.tree(" ".join(parts).split())
    p, h = "p # /p", "h1 # /h1"
    slot = [["#", "", []]]
    assert page(p, p, "hr /hr") == [["p", "+", slot], ["hr", "", []]]
    assert wrappers.aligned(page(h, p), page(p)) == [["h1", "?", slot], ["p", "", slot]]
    assert wrappers.aligned(page(p), page(p, p)) == [["p", "+", slot]]
    assert page("dt # /dt dd # /dd dt # /dt dd # /dd") == [["()", "+", [["dt", "", slot], ["dd", "", slot]]]]
    assert page("p /p p # /p") == [["p", "+", [["#", "?", []]]]]
    assert wrappers.slots(page("div", p, p, "#", "/div")) == {"div/p", "div"}


def test_many_structures_are_folded_level_by_level(spark):
    import itertools

    pages = []
    for k, chosen in enumerate(itertools.product([0, 1], repeat=7)):
        pages.append(("http://e.org/", "<article>" + "".join(f"<h{i % 6 + 1}>t{i}</h{i % 6 + 1}><p>x{k}</p>" for i, c in enumerate(chosen) if c) + "<p>end</p></article>"))
    frame = spark.createDataFrame([("e.org", h) for _, h in pages], "host string, html string")
    found = wrappers.infer(frame).collect()
    assert len(found) == 1
    got = rows(spark, pages)
    assert all(got[i].text.endswith("end") and got[i].n_blocks == h.count("<p>") + len(re.findall(r"<h\d>", h)) for i, (_, h) in enumerate(pages))


def test_pages_of_one_host_with_other_templates(spark):
    story = "<p>{0} goes on for some words.</p><p>And {0} ends.</p>"
    page = {"article": "<body><article>{}</article></body>", "post": "<body><div class='post'>{}</div></body>", "content": "<body><div class='content'>{}</div><p>by</p></body>", "main": "<body><main>{}</main></body>"}
    for where in ("http://f.org/", None):
        got = rows(spark, [(where, page[k].format(story.format(k * 9 if k == "article" else k))) for k in page])
        assert [got[i].text.split("\n")[-1] for i in range(4)] == ["And " + "article" * 9 + " ends.", "And post ends.", "And content ends.", "And main ends."]


def test_text_that_all_pages_share_is_template(spark):
    page = "<body><div class='content'><p>{0} is told here at length.</p><p>All rights reserved by Acme, long line long line long line.</p></div><div class='x'><p>The same long box on every page, which no page has written itself.</p></div></body>"
    got = rows(spark, [(f"http://g.org/{t}", page.format(t)) for t in ("Red", "Blue", "Green")] + [("http://h.org/", page.format("Red"))] * 3)
    assert [got[i].text for i in range(3)] == [f"{t} is told here at length." for t in ("Red", "Blue", "Green")]
    # Copies of one page do not show what is fixed.
    assert got[3].text == got[4].text == got[5].text and "Red is told" in got[3].text


def test_what_wraps_the_page_is_not_judged_by_its_class(spark):
    text = "<h1>Title</h1><p>This is the text of the page, at some length.</p>"
    outer = ["<body class='no-sidebar'>{}</body>", "<div class='content-with-sidebar'><div>{}</div></div>", "<div class='has-banner'><article>{}</article></div>", "<form id='aspnetForm'><div>{}</div></form>", "<div class='social-share-enabled'><div>{}</div></div>"]
    around = "<div class='sidebar'>Side</div><div id='comments'><p>Reader says</p></div>"
    got = rows(spark, [(f"http://{'abcde'[i]}.net/", o.format(text + "{0}").format(around if i != 2 else "")) for i, o in enumerate(outer)])
    assert [got[i].text for i in range(5)] == ["Title\nThis is the text of the page, at some length."] * 5
    # Without h1, and with comments longer than the text.
    bare = rows(spark, [("http://f.net/", "<div class='has-banner'><div><p>Some words of text.</p></div></div>"), ("http://g.net/", f"<div><p>Short.</p></div><div id='comments'><p>{'long talk ' * 50}</p></div>"), ("http://h.net/", f"<div><p>Short.</p></div><div class='post-comments'><article><p>{'long talk ' * 50}</p></article></div>")])
    assert [bare[i].text for i in range(3)] == ["Some words of text.", "Short.", "Short."]


def test_class_words_do_not_empty_an_article(spark):
    got = rows(spark, [
        ("http://a.net/", '<article><p class="search">Search text</p><section class="widget main"><p>W</p></section></article>'),
        ("http://b.net/", "<article><p>Told.</p><div class='reader-reactions'><p>reader</p></div></article>"),
        ("http://c.net/", "<article><header><p>By us</p></header><p>Told.</p></article>"),
        ("http://d.net/", "<article><p>One <label>two</label> <ruby>three<rt>four</rt></ruby> <acronym>five</acronym> su<wbr>per</p></article>"),
    ])
    assert [got[i].text for i in range(4)] == ["Search text\nW", "Told.", "Told.", "One two threefour five super"]


def test_constant_text_is_the_wrapper_s(spark):
    """Generated hosts without article elements: their own texts differ, everything else is the same; some parts are optional or repeat."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    pages, expected = [], []
    for host in range(6):
        top, bottom, box = line(6), line(9), line(12)
        for page in range(rng.randrange(4, 10)):
            own = [line(rng.randrange(8, 20)) for _ in range(rng.randrange(2, 7))]
            extra = f"<div class='x'><p>{box}</p></div>" if page % 2 else ""
            pages.append((f"http://h{host}.org/{page}", f"<body><div class='top'><p>{top}</p></div><div class='text'><p>{line(3)} title</p>{extra}" + "".join(f"<p>{o}</p>" for o in own) + f"<p>{bottom}</p></div></body>"))
            expected.append(own)
    got = rows(spark, pages)
    for i, own in enumerate(expected):
        assert got[i].text.split("\n")[1:] == own, pages[i]


def test_deciding_texts_come_from_the_alignment():
    page = lambda *texts: wrappers.tree("div p # /p p # /p /div".split(), list(texts))
    # Neighbours on one page are a repeated group; the texts that every page has in it are the wrapper's.
    both = wrappers.aligned(page("same", "one"), page("two", "same"), pages=True)
    assert wrappers.fixed_texts(both) == {("div/p", wrappers.text_hash("same"))}
    page = lambda *texts: wrappers.tree("h1 # /h1 p # /p".split(), list(texts))
    both = wrappers.aligned(page("same", "one"), page("same", "two"), pages=True)
    assert wrappers.fixed_texts(both) == {("h1", wrappers.text_hash("same"))}
    assert wrappers.fixed_texts(page("same", "one")) == set()


def test_the_wrapper_decides_inside_articles_too(spark):
    """A box that says the same on every article of a host is the host's; what the article itself says stays, and so does a box that any page fills."""
    page = "<body><article><h1>{0}</h1><p>{0} is told.</p><p>The same in all.</p><section><p>{1}</p></section><div><p>Sign up for more like this.</p></div></article></body>"
    names = ("Red", "Blue", "Green")
    got = rows(spark, [(f"http://{h}.org/{t}", page.format(t, "Shared part." if t != "Blue" else "Other part.")) for h, n in (("i", 3), ("j", 2)) for t in names[:n]] + [("http://k.org/", page.format("Red", "x"))] * 3)
    own = [f"{t}\n{t} is told.\nThe same in all.\n" + ("Shared part." if t != "Blue" else "Other part.") for t in names]
    assert [got[i].text for i in range(3)] == own
    # Two pages, or copies of one, say too little about an article.
    assert [got[i].text for i in (3, 4)] == [o + "\nSign up for more like this." for o in own[:2]]
    assert got[5].text == got[6].text == got[7].text and got[5].text.endswith("Sign up for more like this.")


def test_articles_take_part_in_their_host_s_wrapper(spark):
    """What a page without article shares with the articles of its host is the wrapper's."""
    around = "<body><div class='x'><p>The box of the host, on each of its pages, long enough to win over any text.</p></div>{}</body>"
    got = rows(spark, [("http://l.org/1", around.format("<article><p>One.</p></article>")), ("http://l.org/2", around.format("<div class='post'><p>Two of us.</p></div>"))])
    assert [got[i].text for i in range(2)] == ["One.", "Two of us."]
