"""What stays of made-up pages: recurring parts of articles, comments and adverts by name, broken and hostile pages, and the
counting of recurring subtrees against a plain one."""

import time

import pytest

from tasklore.llm import pages

KIND = "page_id long, url string, html string"


def texts(spark, made):
    return {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(made, KIND)).collect()}


def test_recurring_tables_and_lists_of_articles_stay(spark):
    fares = "<table><tr><td>Fare zone A</td></tr><tr><td>3 euros</td></tr></table><ul><li>Bring water</li><li>Bring a map</li></ul><div><p>Box</p></div>"
    made = [(k, f"http://h.example/{k}", f"<article><p>Own text {k}.</p>{fares if k < 4 else ''}</article>") for k in range(10)]
    made += [(20 + k, f"http://m.example/{k}", f"<main><p>Own text {k}.</p>{fares if k < 4 else ''}</main>") for k in range(10)]
    got = texts(spark, made)
    kept = "Fare zone A\n\n3 euros\n\nBring water\n\nBring a map"
    assert all(got[k] == f"Own text {k}.\n\n{kept}\n\nBox" for k in range(4)) and got[9] == "Own text 9."
    assert all(got[20 + k] == f"Own text {k}.\n\n{kept}" for k in range(4))  # the recurring box beside goes


def test_pages_without_an_article_lose_their_template(spark):
    shell = "<body><div>Site name</div><table><tr><td>Links</td></tr></table><div><h1>Title {0}</h1><p>Story {0}.</p></div><p>Imprint</p></body>"
    got = texts(spark, [(k, f"http://n.example/{k}", shell.format(k)) for k in range(9)])
    assert got == {k: f"Title {k}\n\nStory {k}." for k in range(9)}


def test_comments_and_adverts_by_name():
    names = ["user-comments", "reader-comments", "google-ads", "advert-mpu", "related-stories", "social-media", "story-notice", "ad-slot", "cookieBanner"]
    for name in names:
        assert pages.blocks(pages.parse(f"<article><p>Text</p><div class='{name}'>gone</div></article>")) == "Text", name
    for name in ["share-price", "comment-culture", "story", "user-guide", "media"]:
        assert pages.blocks(pages.parse(f"<article><p>Text</p><div class='{name}'>stays</div></article>")) == "Text\n\nstays", name


def test_main_is_preferred_to_a_teaser_outside():
    assert pages.blocks(pages.parse("<main><p>Own</p></main><article>teaser</article>")) == "Own"
    assert pages.blocks(pages.parse("<main><h1>no</h1><article>Own</article></main><article>teaser</article>")) == "Own"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b</p>c", "a\n\nb\n\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a\n\nb\n\nc\n\nd\n\ne"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<article>x<b>y</article>z</b>", "xy"), ('<a href="x>y">t</a>u', "tu"), ("<!-- a > b", ""), ("a<!-- b --> c", "a c"), ("3 < 4 & 5 > 2 <a", "3 < 4 & 5 > 2 <a"),
        ('<a ">x</a>y', "xy"), ("<i>a</b>b</i>c", "abc"), ("</p>x", "x"), ("<script>if (a < b) {}</script>t", "t"), ("&lt;p&gt; &amp;eacute;  x", "<p> &eacute; x"),
    ],
)
def test_broken_pages(page, text):
    assert pages.blocks(pages.parse(page)) == text


@pytest.mark.parametrize("unit", ["<i>", "<a ", '<a "', "<div>", '<a ">"', "<!--", "<ul><li>", "<table><tr><td>", "<li>", "</p>", "<i></b>", "<p><b>", "<script>", "&lt", "</i"])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    if unit == "<i>":
        page = "<i>" * 160_000 + "</b>" * 160_000
    start = time.process_time()
    root = pages.parse(page)
    pages.hashed(root), pages.countable(root), pages.blocks(root)
    assert time.process_time() - start < 20  # minutes to hours where a step looks through the stack or to the page's end


def test_template_counts_against_plain_ones(spark):
    """A page without an article loses exactly the subtrees that a plain count finds in enough distinct texts of its host."""
    parts = ["<div>One</div>", "<div>Two</div>", "<section><p>Three</p><p>3</p></section>", "<p>Four</p>"]
    made = [(k, f"http://c{k % 2}.example/{k}", "<body>" + "".join(p for j, p in enumerate(parts) if (k * (j + 3)) % 7 < 3) + f"<p>Own {k // 2 if k < 24 else 0}</p></body>") for k in range(30)]
    by = {}
    for _, url, page in made:
        root = pages.parse(page)
        pages.hashed(root)
        by.setdefault(url[7:9], {}).setdefault(pages.blocks(root), set()).update(pages.countable(root))
    want = {}
    for k, url, page in made:
        own = by[url[7:9]]
        n = {}
        for found in own.values():
            for h in found:
                n[h] = n.get(h, 0) + 1
        root = pages.parse(page)
        pages.hashed(root)
        want[k] = pages.blocks(root, {h for h, c in n.items() if c >= pages.PAGES and c >= pages.SHARE * len(own)})
    got = texts(spark, made)
    assert got == want and len(set(want.values())) > 5
