"""Ordinary text beside words that also name furniture: it stays; furniture goes."""

import pytest

from millrace.llm.quality import quality_rules
from millrace.llm.sitestyle import Page

ARTICLE = """<article><h1>Title</h1>{}</article>"""


@pytest.mark.parametrize("html", [
    '<h2 id="social-life">Kept words</h2>', '<h2 id="promotion-to-captain">Kept words</h2>', '<section id="related-work"><p>Kept words</p></section>', '<section class="sharing-economy"><p>Kept words</p></section>',
    '<h2 id="comments-on-method">Kept words</h2>', '<h2 id="comments">Kept words</h2>', '<p class="related">Kept words</p>', '<h3 class="share">Kept words</h3>', '<div class="navigation-of-birds"><p>Kept words</p></div>',
    '<section id="comments"><h2>Kept words</h2></section>', '<p class="footer-ballet notice">Kept words</p>', '<blockquote class="banner">Kept words</blockquote>',
])
def test_article_text_stays(html):
    assert "Kept words" in Page(ARTICLE.format(html)).text(set())


@pytest.mark.parametrize("name", ["search-methods", "survey-results", "alert-levels", "header-files", "register-allocation", "newsletter-history"])
def test_headings_outside_articles_stay(name):
    assert Page(f'<body><h1>Title</h1><h2 id="{name}">Kept words</h2><p>More of it.</p></body>').text(set()) == "Title\n\nKept words\n\nMore of it."


@pytest.mark.parametrize("html", [
    '<div class="related-posts">Gone words</div>', '<div class="comments-area"><p>Gone words</p></div>', '<ul class="nav-links"><li>Gone words</li></ul>', '<div class="ad-slot-1">Gone words</div>', '<div class="socialShare">Gone words</div>',
    '<div class="box newsletter">Gone words</div>', '<aside>Gone words</aside>', '<div role="navigation">Gone words</div>', '<form>Gone words</form>', '<div class="cookie-banner">Gone words</div>',
])
def test_furniture_goes(html):
    assert Page(ARTICLE.format(f"<p>Text that stays here.</p>{html}")).text(set()) == "Title\n\nText that stays here."
    assert Page(f"<body><article><p>Text that stays here.</p></article>{html}</body>").text(set()) == "Text that stays here."


def test_ids_of_boxes_outside_articles_count():
    assert Page('<body><div id="comments">Gone</div><div id="comments-on-method">Kept words</div></body>').text(set()) == "Kept words"


def test_ids_of_sections_outside_articles_count_for_comments():
    assert Page('<body><h1>Title</h1><section id="comments"><article>Gone</article></section><section id="related"><p>Kept words</p></section></body>').text(set()) == "Title\n\nKept words"


KEPT = [
    "The design in question won the prize that year.", "She keeps a catalog in the back office.", "He wrote a blog in the evenings.", "Their design up to then was rejected by every board.",
    "The newsletter reached its readers in May of that year.", "| Tag | Limit | Unit | Note |", "|---a|---b|---c|---d|", "You sign in at the desk and wait there.", "Read more books than you write, she said.", "A cookie policy was all they talked about.",
]
GONE = ["Sign in | Sign up", "Read more »", "All rights reserved.", "Privacy Policy · Terms of Service", "Skip to content", "Newsletter", "LOG IN", "Back to top ↑", "Mentions légales", "Home | News | About | Shop | Cart"]


def test_lines(spark):
    filler = "A plain sentence with enough different words stands here so that the document as such is kept."
    rows = [(k, f"{filler}\n{line}\n{filler[:-1]} too, again.") for k, line in enumerate([*KEPT, *GONE])]
    out = {r["k"]: r["clean_text"].split("\n") for r in quality_rules(spark.createDataFrame(rows, "k long, text string")).collect()}
    assert [line for k, line in enumerate(KEPT) if len(out[k]) != 3] == []
    assert [line for k, line in enumerate(GONE, len(KEPT)) if len(out[k]) != 2] == []
