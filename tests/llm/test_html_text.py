import html
import re

import pytest

from ranlens.llm import html_text
from ranlens.llm.catalog import op1_html_text


def main_text(page):
    return html_text.main_texts([page], html_text.trained_tree())[0]


def plain(page):
    """The article of the generated pages, cut by regular expressions."""
    article = re.search(r"<article>(.*)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|ul|li|div)(?: [^>]*)?>", article.group(1) if article else "")
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_the_query_equals_a_plain_cut(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op1_html_text(spark, folder).collect()
    assert len(rows) == len(pages)
    for row in rows:
        expected = plain(pages[row.page_id].html)
        assert (row.url, row.text, row.n_chars) == (pages[row.page_id].url, expected, len(expected))


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("<!-- never closed <p>x", ""),
        ("<article><p>a <b>bo</b>ld &amp; &lt;x&gt; &#65;&nbsp;&eacute;  \n y<br>z", "a bold & <x> A é y z"),
        ("<article><h1>T</h1><script>if (a<b) '</p>'</script><p>x<style>p{}</style></p><textarea><p>n</p></textarea>y</article>", "T\nx\ny"),
        ("<main><p>one<nav>menu</nav><p>two<aside>box</aside><form><p>mail</p></form><footer>f</footer>three</main>", "one\ntwo\nthree"),
        ("<article>A<p>b<div class=ad>buy</div>c<ul><li>d<li><a href=x>e</a></ul></article><p>after it", "A\nb\nc\nd\ne"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</p></header><p>x</p></article>", "T\nx"),
        ("<article><p>x</p><section id=comments><article><p>me too</p></article></section></article>", "x"),
        ("<body class=has-sidebar><div class=sidebar>s</div><main><p>x</main><div class='cookie-notice'>c</div>", "x"),
        ("<article><p class=ad>buy<p>x</article>", "x"),
        ("<div id=main><div class=left>l l l l</div><article><p>x</article><div>r</div></div>", "x"),
        ("<div class=with-sidebar><article>x</article></div><div class=related><article>other</article></div>", "x"),
        ("<div class=content><h1>T</h1><p>x</p><p style='display: none'>h</p></div><div class=comments><p>c c c</p></div>", "T\nx"),
        ("<article></div></p></x><p>stray ends</article>", "stray ends"),
        ('<article><p title="a > b">quoted</p><a href="x', "quoted"),
        ("<ARTICLE><P>upper</P></ARTICLE>", "upper"),
    ],
)
def test_pages(page, expected):
    assert main_text(page) == expected


def test_a_page_without_marks_is_told_by_words_and_links():
    text = "this paragraph has many words in it and not one of them is a link, so that it must be of the main text of the page"
    menu = "".join(f"<li><a href={i}>item {i}</a></li>" for i in range(9))
    assert main_text(f"<ul>{menu}</ul><div>{text}.</div><div>{text}, too.</div><p><a href=x>more</a>") == f"{text}.\n{text}, too."


def test_long_pages_are_whole_and_no_regex_runs_away():
    paragraphs = [f"paragraph {i}" for i in range(20_000)]
    assert main_text("<article>" + "".join(f"<p>{p}" for p in paragraphs)) == "\n".join(paragraphs)
    for junk in ("<", "<!--", "<a '", '<p "', "<p", "</", "<!"):
        main_text("<article><p>x</p>" + junk * 20_000)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "t", 1), (None, None, "<article><p>x", "t", 1), (2, "u", "<p>", "t", 1), (2, "u", "<p>", "t", 1)]
    found = html_text.extracted(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_text.extracted(spark.createDataFrame([], schema)).collect() == []


def test_the_tree_tells_its_labelled_blocks():
    x, y = html_text.labelled_table()
    assert (html_text.trained_tree().is_main(x) == y).mean() > 0.98


LONG = "this paragraph has many words in it and not one of them is a link, so that it must be of the main text of the page."


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<article class='post category-social tag-search'><h1>T</h1><p>{LONG}<p>x<div class=share>s</div></article>", f"T\n{LONG}\nx"),
        ("<main><p>crumbs</p><article class='post social'><p>x</p></article></main>", "crumbs\nx"),
        ("<article><p>x</p></article><article class=comment><p>me too</p></article>", "x"),
        (f"<div class='content no-ads'><h1>T</h1><p>{LONG}</p><p>x</p></div>", f"T\n{LONG}\nx"),
        (f"<div class='hidden-print content'><p>{LONG}</p><p>x</p></div>", f"{LONG}\nx"),
        ("<body class=comments-enabled><div class=comments-enabled><main><p>x</p></main></div>", "x"),
        ("<form id=aspnetForm><div class=nav><a href=x>Home</a></div><article><p>x<div class=ad>a</div></article><p>f</p></form>", "x"),
        (f"<form id=aspnetForm><div class=content><p>{LONG}<div class=comments><p>{LONG}</div></div></form>", LONG),
        (f"<form><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><div>{LONG}</div><div>{LONG}</div></form>", f"{LONG}\n{LONG}"),
        (f"<main><form><p>{LONG}</p></form></main>", LONG),
        ("<div class=overlay><article><p>x<div class=ad>buy</div></article></div>", "x"),
        (f"<p>{LONG}</p><div class=modal><article><p>{LONG}</p><p>{LONG}</p><p>x</p></article></div>", f"{LONG}\n{LONG}\nx"),
        (f"<div class=social><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<p>{LONG}</p><div class=comments-area><p>{LONG}</p></div><form><p>{LONG}</p></form>", LONG),
        (f"<div class=content><p>x</p></div><div class=comments><article><p>{LONG}</p></article></div>", "x"),
    ],
)
def test_a_name_or_form_does_not_empty_a_page(page, expected):
    assert main_text(page) == expected


OTHER = "what is told here is no part of the text above, though it has as many words as a paragraph of it and ends with a stop."


@pytest.mark.parametrize(
    "name",
    """reader-comments post-comments c-comments comment__body disqus_thread sponsored-content related-articles newsletter-box
    cookie-notice-bar inline-advert promo-box ad-slot-top story-ads article__share social-bar article-comments user-comment
    site-notice content-footer post_related comments advertisement""".split(),
)
@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><h1>T</h1><p>{long}</p>{other}<p>x</p></article>", "T\n{long}\nx"),
        ("<main><h1>T</h1><p>{long}</p></main>{other}", "T\n{long}"),
        ("<div class=post-content><h1>T</h1><p>{long}</p>{other}<p>{long}</p></div>{other}", "T\n{long}\n{long}"),
        ("<div><a href=x>Home</a></div><p>{long}</p>{other}<p>{long}</p>", "{long}\n{long}"),
        ("<article class='post category-social tag-ads no-ads'><p>{long}</p>{other}</article>", "{long}"),
    ],
)
def test_parts_with_longer_names_are_no_article(name, page, expected):
    for other in (f"<div class={name}><p>{OTHER}</p></div>", f"<section id='{name}' class=box><h3>More</h3><article><p>{OTHER}</p></article></section>"):
        assert main_text(page.format(long=LONG, other=other)) == expected.format(long=LONG)


@pytest.mark.parametrize("name", "no-ads ad-free comments-enabled has-share category-social tag-ads topic-cookies hidden-print without-comments".split())
def test_names_that_deny_a_part_or_name_a_topic_are_none(name):
    assert main_text(f"<div class='{name}'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>").endswith(f"{LONG}\n{LONG}")
    assert main_text(f"<div class='content {name}'><h1>T</h1><p>{LONG}</p><p>x</p></div>") == f"T\n{LONG}\nx"
