from __future__ import annotations

import html as entities
import re

import numpy as np
import pytest

from quillstone.llm import html, q_html

FULL = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=x>Menu one</a><li>Menu two</ul></nav>
<div class="cookie-notice"><p>We use cookies on this long and wordy line of text, which you should accept right away.</p></div>
<article><h1>Head &lt;line&gt;</h1><p>First <b>para</b>graph\n with   spaces&nbsp;here.<br>next<p>x<ul><li>one<li>two</ul>
<aside>side</aside><div class="ad">Buy now, a very long advert that has many many words in it and goes on and on.</div>
<form><label>Name</label><input name=n></form><p>Last &eacute;&#233;&#x1F600;</p><section id="comments"><p>Reader says hello</p></section></article>
<div class="sidebar"><p>More</p></div><footer>&copy; foot</footer></body></html>"""


def test_full_page():
    assert html.main_text(FULL) == "Head <line>\nFirst paragraph with spaces here. next\nx\none\ntwo\nLast éé😀"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>", ""),
        ("<article></article>", ""),
        ("<article><p>cut off <b", "cut off"),
        ("<article><p>a</p></article", "a"),
        ("<main><p>main text</p><nav>n</nav></main>", "main text"),
        ("<main><p>outer</p><article><p>the article itself, with enough words</p></article></main>", "the article itself, with enough words"),
        ("<nav>only menu</nav>", ""),
        ("<article><p>one</p><!-- <p>no</p> --><script>x</script><p>two</article>", "one\ntwo"),
        ("<article><div>a<div>b</div>c</div></article>", "a\nb\nc"),
        ("<article>x<span class='ad'>ad</span>y</article>", "xy"),
        ("<div class='page has-sidebar with_menu'><article><p>body text</p></article></div>", "body text"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ],
    ids=str,
)
def test_cases(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<head><title>t</title><body><article><p>the text</p></article></body>", "the text"),
        ("<html><head><meta charset=utf-8><title>t</title><style>p{}</style><body><p>the text", "the text"),
        ("<head><title>t</title><article><p>the text</p></article>", "the text"),
        ("<head><title>t</title><main><h1>Head</h1><p>the text", "Head\nthe text"),
        ("<head><title>t</title>\n bare text", "bare text"),
        ("<head><title>t</title><noscript><img src=x><p>no</p></noscript><script>no</script><link rel=x><body>yes", "yes"),
        ("<head><noscript><p>no<body><p>yes", "yes"),
        ("<head><title>t</title></head><body><p>closed</p></body>", "closed"),
    ],
    ids=str,
)
def test_head_without_its_end_tag(page, want):
    assert html.main_text(page) == want


def test_without_an_article_the_dense_lines_stay():
    links = "".join(f"<li><a href=/{k}>l{k}</a></li>" for k in range(12))
    text = "<p>" + "A long line of running text that has many words. " * 4 + "</p>"
    got = html.main_text(f"<body><ul>{links}</ul>{text * 6}<ul>{links}</ul></body>")
    assert got.count("\n") == 5 and "l3" not in got


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<div class=page><div>{}</div><footer>foot</footer></div>"])
def test_without_an_article_no_paragraph_is_lost(wrap):
    """Paragraphs of any lengths and the heading stay, at the ends and in the middle."""
    for seed in range(50):
        rng = np.random.default_rng(seed)
        lines = ["The heading", *(" ".join(f"w{k}" for k in range(1 + int(n))) for n in rng.lognormal(3, 1.2, 20))]
        inner = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
        assert html.main_text(f"<body>{wrap.format(inner)}</body>") == "\n".join(lines), seed


LONGER = "<p>" + "many words of running text " * 20 + "</p>"


@pytest.mark.parametrize(
    "before,want",
    [
        ("<h1><a href=/>Linked heading</a></h1>", "Linked heading"),
        ("<ul><li>a short item<li><a href=/>link</a></ul>", "a short item\nlink"),
        ("<p><a href=/>One link</a></p>", "One link"),
        ("<ul><li><a href=/>l1</a><li><a href=/>l2</a></ul>", ""),
        ("<div><a href=/>l1</a> | <a href=/>l2</a></div>", ""),
        ("<p>See <a href=/>l1</a> and <a href=/>l2</a></p>", "See l1 and l2"),
        ("<div><a href=/>never closed</div><p>x</p><ul><li>y</ul>", "never closed\nx\ny"),
        ("<dl><dt>term<dd>meaning</dl><table><tr><td>1<td>2</table>", "term\nmeaning\n1\n2"),
    ],
    ids=str,
)
def test_without_an_article_only_unnamed_menus_go(before, want):
    for first in (True, False):
        got = html.main_text(f"<body>{before}{LONGER * 8}" if first else f"<body>{LONGER * 8}{before}")
        kept = [x for x in got.split("\n") if not x.startswith("many")]
        assert "\n".join(kept) == want and got.count("many words of running text many") == 80


MANY = "<p>" + "words of a long paragraph " * 12 + "</p>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<main><article>{MANY}</article><article><p>a second, short one</p></article></main>", "@\na second, short one"),
        (f"<main><h1>Title</h1><article>{MANY}</article></main>", "Title\n@"),
        (f"<article>{MANY}</article><article><h3><a href=/>teaser</a></h3></article>", "@"),
        (f"<article>{MANY}<section id='social-history'><p>kept</p></section><p class='notice-of-intent'>kept too</p></article>", "@\nkept\nkept too"),
        (f"<body>{MANY}<div class='volcano-banner'>BUY</div><p>end</p></body>", "@\nend"),
        (f"<body><h1>H</h1>{MANY}<h2>I</h2><p>short</p>{MANY}<p>x</p></body>", "H\n@\nI\nshort\n@\nx"),
        (f"<article>{MANY}<article class='comment'><p>a reader says much about it</p></article></article>", "@"),
        (f"<article>{MANY}</article><div id='commentList'><p>said</p></div>", "@"),
        (f"<div class='story'>{MANY * 6}</div><article><p>tiny</p></article>", "@\n" * 5 + "@\ntiny"),
        (f"<div class='content with-sidebar'>{MANY}</div><div class='sidebarLeft'><p>no</p></div>", "@"),
        (f"<main>{MANY}<p>one</p></main><main><p>two</p></main>", "@\none\ntwo"),
    ],
    ids=str,
)
def test_region_and_names(page, want):
    assert html.main_text(page).replace(("words of a long paragraph " * 12).strip(), "@") == want


def test_names_of_furniture():
    for name in ("ad", "cookie-banner", "navLeft", "sidebar_box", "ad-container-2", "main-nav", "related-posts", "post-comments", "share-buttons"):
        assert html.names_furniture(name), name
    for name in ("social-history", "notice-of-intent", "has-sidebar", "page_with_menu", "content", "no-banner", "adder", "article-body", ""):
        assert not html.names_furniture(name), name


def test_smoothing_and_threshold():
    values = np.array([1.0, 1.0, 9.0, 9.0])
    assert 1 < html.threshold(values) <= 9
    assert html.threshold(np.array([3.0, 3.0])) == 3.0
    flat = html.smoothed(np.ones(9))
    assert np.allclose(flat, 1)


def test_long_page_and_pieces(monkeypatch):
    page = "<article>" + "<p>word &amp; more</p>" * 5000 + "</article>"
    whole = html.main_text(page)
    monkeypatch.setattr(html, "PIECE", 7)
    assert html.main_text(page) == whole and whole.count("\n") == 4999


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, FULL, "y"), (2, FULL, "y"), (None, "<p>p", None)], "page_id bigint, html string, text string")
    rows = html.extract(df).collect()
    assert len(rows) == 4 and sum(r["n_chars"] == len(r["text"]) for r in rows) == 4
    assert html.extract(df.limit(0)).count() == 0


def test_query_by_plain_parsing(spark, data):
    """The pages of the test table have one article of h1 and p, which a pattern can cut out."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = q_html.op8_html_main_text(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(filter(None, parts))
