import html as entities
import re

import pytest

from tidemark.llm import html_density as d
from tidemark.llm.html_density import extract_text, main_text

ARTICLE = (
    "<h1>A headline of the day</h1><p>The first paragraph has a fair number of words, so that it is dense.</p>"
    "<p>The second one &amp; its <b>bold</b> part follow\n  with   more words than the menu has.</p>"
    "<ul><li>one point worth making</li><li>another point worth making</li></ul>"
)
LINES = (
    "A headline of the day\nThe first paragraph has a fair number of words, so that it is dense.\n"
    "The second one & its bold part follow with more words than the menu has.\n"
    "one point worth making\nanother point worth making"
)
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Menu entry number {i}</a></li>' for i in range(12)) + "</ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{NAV}<article>{ARTICLE}</article><footer>&copy; the site</footer></body></html>",
        f"<body>{NAV}<div class='ad'>Buy this now.</div><main>{ARTICLE}</main><aside>Other news of note</aside>",
        f"<body><header><h2>Site name</h2></header><div id='content'>{ARTICLE}</div><div class='sidebar'><p>Some "
        f"other long text which is not the article at all, but long.</p></div>",
        f"<body><article>{ARTICLE}</article><section id='comments'><p>I do not agree with any of this, and say so at "
        f"some length.</p></section><form><label>Your mail</label><input></form>",
        f"<body><div class='cookie-notice'>We use cookies on this site.</div><div><div>{ARTICLE}</div></div>"
        f"<script>var t = '</p>';</script><style>p{{}}</style>",
        f"<body><article class='post has-comments'><header>{ARTICLE}</header><footer>By someone</footer></article>",
    ],
)
def test_only_the_article_is_left(page):
    assert main_text(page)[0] == LINES


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<div class='layout has-sidebar'>{ARTICLE}<div class='sidebar'><p>Less of a text.</p></div></div></body>",
        f"<body>{NAV}<div id='content' class='comments-open'>{ARTICLE}</div></body>",
        f"<body><div title='the hidden cost' data-note='aria-hidden=true'>{ARTICLE}</div><div hidden>Not shown to anyone.</div></body>",
        f"<body><article>{ARTICLE.replace('<ul>', '<section class=related-work><ul>')}</section></article></body>",
        f"<body><article>{ARTICLE}<section class='comments'><p>I do not agree with this.</p></section></article></body>",
        f"<body><article>{ARTICLE}<div class='related'><a href='/1'>Another article to read</a></div></article></body>",
    ],
)
def test_names_alone_do_not_drop_text(page):
    assert main_text(page)[0] == LINES


def test_unclosed_and_misnested_markup():
    page = '<body><article><h1>Title here</h1><p><b>First part of text<br><p>Second part.</p><li>x</article><footer>no</footer>'
    assert main_text(page)[0] == "Title here\nFirst part of text\nSecond part.\nx"


def test_odd_pages():
    assert main_text(None) == ("", 0) == main_text("")
    assert main_text("just   text &lt;3")[0] == "just text <3"
    assert main_text("<body>" + "<div>" * 20_000 + "deep text")[0] == "deep text"
    assert main_text("<p a='" + "x" * 50_000)[0] == ""
    assert main_text("a<b" * 3)[0].startswith("a")
    assert main_text("<nav><a>only</a></nav>")[0] == ""
    assert main_text("<p>a<p></p>b")[0] == "a\nb"


def by_template(page: str) -> str:
    """Plain reading of the generated pages: the article's blocks end where tags of blocks stand."""
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    body = re.sub(r"<br>", " ", body)
    parts = re.split(r"</?(?:p|h1|li|ul)>", body)
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_generated_pages(spark):
    got = extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).toPandas()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for row in got.itertuples():
        assert row.text == by_template(pages.html[row.page_id])
        assert row.n_chars == len(row.text)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 9), (1, "u", "<p>hi there", 9), (None, None, "", 9)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()), key=str)
    assert got == [(1, "", 0), (1, "hi there", 8), (None, "", 0)]
    assert extract_text(df.limit(0)).count() == 0


WORDS = "the river rose in the night and took the lower road with it so that nobody came to the market"


def unmarked_page(links=60, boxes=40):
    """No article, no telling names: a list of links, short boxes, the story, and more boxes."""
    farm = "".join(f"<li><a href='/{k}'>read more about item number {k}</a></li>" for k in range(links))
    shop = "".join(f"<div><span>item {k}</span><b>{k}.99</b></div>" for k in range(boxes))
    story = [f"{WORDS} {k}" for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in story)
    page = f"<html><body><div><ul>{farm}</ul></div><div><div><h2>A flood</h2>{body}<p>So it was.</p></div><div>{shop}</div></div></body></html>"
    return page, "\n".join(["A flood", *story, "So it was."])


def test_density_alone_chooses():
    page, want = unmarked_page()
    assert d.main_text(page)[0] == want
    # without the density, or without what it takes from links, the choice is another
    assert d.main_text(page, lambda *counts: 1.0)[0] != want
    no_links = lambda c, t, lc, lt, ratio: d._log_ratio(c, t, 0, 0, ratio)
    farm = f"<html><body><div>{''.join(f'<p><a href=x>{WORDS} {k}</a></p>' for k in range(9))}</div><div>{''.join(f'<p>{WORDS} {k}!</p>' for k in range(5))}</div></body></html>"
    assert "!" in d.main_text(farm)[0] and "market 8" not in d.main_text(farm)[0]
    assert "market 8" in d.main_text(farm, no_links)[0]


def test_names_are_matched_whole():
    for name in ("side-by-side", "has-sidebar wide", "comments-open", "related-work", "notice-board"):
        page = f"<body><p>{WORDS}.</p><div class='{name}'><p>{WORDS}!</p></div></body>"
        assert d.main_text(page)[0] == f"{WORDS}.\n{WORDS}!", name
    for name in ("sidebar", "site-footer", "ad-banner", "comment-list", "cookie notice", "sidebar-left"):
        page = f"<body><div><p>{WORDS}.</p><p>{WORDS}?</p></div><div class='{name}'><p>{WORDS}!</p></div></body>"
        assert d.main_text(page)[0] == f"{WORDS}.\n{WORDS}?", name
    for attr in ("title='the hidden gem'", "data-id='share'", "data-hidden-count='3'"):
        assert d.main_text(f"<body><div {attr}><p>{WORDS}</p></div></body>")[0] == WORDS


def test_parts_of_one_article():
    parts = [f"<div><p>{WORDS} {k}.</p>{'<p>Short.</p>' * (k % 3)}</div>" for k in range(5)]
    text = d.main_text(f"<body><div><a href=x>home</a></div>{''.join(parts)}</body>")[0]
    assert all(f"market {k}." in text for k in range(5)) and text.count("Short.") == 4
