"""Names that speak of the topic, teasers beside an article, and boilerplate names that labelled pages wrap in layout words."""

import pytest

from causeway.llm import html

TEXT = " ".join(f"word{i}" for i in range(80))
ROWS = " ".join(f"row{i}" for i in range(20))
LINKS = "".join(f"<li><a href='/{i}'>see also page {i}</a></li>" for i in range(10))


@pytest.fixture(scope="module")
def weights():
    return html.learn(html.labelled_pages())


def page(inside, after="", root="article"):
    return f"<body><nav><a href='/'>Home page</a></nav><{root}><p>{TEXT}</p>{inside}<p>{TEXT}</p></{root}>{after}<footer>us</footer></body>"


@pytest.mark.parametrize("root", ["article", "main"])
@pytest.mark.parametrize("left, right", [('<table class="share-price-table"><tr><td>', "</td></tr></table>"), ('<section id="side-effects"><p>', "</p></section>"), ('<h2 id="search-for-life">', "</h2>"), ('<div class="block form-of-government">', "</div>")])
def test_names_of_the_topic_are_not_boilerplate(weights, root, left, right):
    assert html.main_text(page(f"{left}{ROWS}{right}", root=root), weights) == f"{TEXT} {ROWS} {TEXT}"


@pytest.mark.parametrize("name", ["share-buttons", "c-share__list", "social-share-facebook", "newsletter-signup-box", "reader-thoughts", "colophon", "comment-list", "related-stories", "ad-300x250", "share_3kdf9", "ad-slot-kicker comments"])
def test_boilerplate_names_stay(weights, name):
    assert html.main_text(page(f'<div class="{name}"><p>{ROWS}</p></div>'), weights) == f"{TEXT} {TEXT}"


def test_a_topical_name_around_links_is_boilerplate(weights):
    assert html.main_text(page(f'<div class="related-kicker"><ul>{LINKS}</ul></div>'), weights) == f"{TEXT} {TEXT}"
    assert html.main_text(page(f'<div class="related-kicker hidden">{ROWS}</div><div class="side-effects" aria-hidden="true">{ROWS}</div>'), weights) == f"{TEXT} {TEXT}"


def test_teasers_beside_the_article_are_left_out(weights):
    teasers = "".join(f"<article><h3><a href='/{i}'>Story {i}</a></h3><p>{ROWS}</p></article>" for i in range(3))
    for root in ("article", "main"):
        assert html.main_text(page("", f'<div class="more-stories">{teasers}</div>', root), weights) == f"{TEXT} {TEXT}" or root == "main"
    inside = f"<body><main><article><p>{TEXT}</p></article><div class='more-stories'>{teasers}</div></main></body>"
    assert html.main_text(inside, weights) == TEXT


def test_other_articles_are_kept(weights):
    parts = f"<body><article><p>{TEXT}</p></article><article><h2><a href='/2'>Second part</a></h2><p>{TEXT}</p></article></body>"
    assert html.main_text(parts, weights) == f"{TEXT} Second part {TEXT}"
    update = f"<body><main><article><p>{TEXT}</p></article><article><p>Update: {ROWS}</p></article></main></body>"
    assert html.main_text(update, weights) == f"{TEXT} Update: {ROWS}"
    listing = "".join(f"<article><h3><a href='/{i}'>Story {i}</a></h3><p>{ROWS}</p></article>" for i in range(3))
    assert html.main_text(f"<body><article>{listing}</article></body>", weights).count("row19") == 3


def test_measures_take_linear_time_on_deep_pages(weights):
    import time

    def seconds(p):
        began = time.perf_counter()
        html.main_text(p, weights)
        return time.perf_counter() - began

    for unit, tail in (("<b>", "<article></article>"), ("<a href=x>x", ""), ("<article class=side-effects>", "x "), ("<div class=share-price>x", "<article><a>y</a></article>")):
        short, long_ = (seconds(unit * n + tail * n) for n in (2_000, 20_000))
        assert long_ < 1 + 40 * short, unit
