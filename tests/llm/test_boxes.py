"""Boxes inside an article part no text, however long."""

import pytest

from causeway.llm import html

SHARE = '<div class="share">Share Tweet Email Print</div>'
LEAD = " ".join(f"lead{i}" for i in range(30))
TEXT = " ".join(f"word{i}" for i in range(80))
LINKS = "".join(f"<li><a href='/{i}'>see also page {i}</a></li>" for i in range(60))


@pytest.fixture(scope="module")
def weights():
    return html.learn(html.labelled_pages())


@pytest.mark.parametrize("left, right", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
@pytest.mark.parametrize("first", ["<h1>Big news</h1>", f"<p>{LEAD}</p>"])
@pytest.mark.parametrize("box", [SHARE, f"<aside>{'Read this other thing too ' * 40}</aside>", f'<div class="related"><ul>{LINKS}</ul></div>', f"<aside>{'x ' * 400}</aside><p>between</p>{SHARE}"])
def test_text_on_both_sides_of_a_box_is_kept(weights, left, right, first, box):
    page = f"<html><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav>{left}{first}{box}<p>{TEXT}</p>{right}<aside>{'See more of it ' * 30}</aside><footer>us</footer></body></html>"
    lead = "Big news" if "h1" in first else LEAD
    assert html.main_text(page, weights) == " ".join([lead, *["between"] * ("between" in box), TEXT])
    assert html.main_text(page.replace(f"<p>{TEXT}</p>", "").replace(first, f"<p>{TEXT}</p>").replace(right, f"{first}{right}", 1), weights).split()[:80] == TEXT.split()


def test_a_teaser_article_in_a_sidebar_is_boilerplate(weights):
    page = f'<body><article><p>{TEXT}</p></article><aside><article><h2>Teaser</h2><p>{LEAD}</p></article></aside></body>'
    assert html.main_text(page, weights) == TEXT


def test_a_page_without_a_root_keeps_its_lead(weights):
    page = f"<body><nav>Home page</nav><p>{LEAD}</p><aside>{'Read this other thing too ' * 40}</aside><p>{TEXT}</p><footer>us</footer></body>"
    assert html.main_text(page, weights) == f"{LEAD} {TEXT}"


def test_marks_of_the_only_root_are_not_held_against_it(weights):
    page = f'<body><nav>Home page</nav><article class="shared-article social-science"><h1>Big news</h1><p>{TEXT}</p><div class="share">Share it</div></article><footer>us</footer></body>'
    assert html.main_text(page, weights) == f"Big news {TEXT}"
    assert html.main_text(f'<body><div class="post-header-share main-content"><p>{TEXT}</p></div></body>', weights) == TEXT
    two = f'<body><article><p>{TEXT}</p></article><article class="comment"><p>{LEAD}</p></article></body>'
    assert html.main_text(two, weights) == TEXT


def test_deep_and_long_pages_take_linear_time(weights):
    import time

    def seconds(page):
        began = time.perf_counter()
        html.main_text(page, weights)
        return time.perf_counter() - began

    for unit in ("<b>x", "<div class=share>x ", "<article>x", "</b>x", "<li><ul>x", "<p><b>x</p>", "< a", "<a b='"):
        short, long_ = seconds(unit * 3_000), seconds(unit * 30_000)
        assert long_ < 1 + 40 * short, unit
    assert html.main_text("<b>x" * 2_000, weights) == "x" * 2_000


def test_tables_without_rows_and_with_more_columns(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    (r,) = html.extract(spark.createDataFrame([(1, "u", f"<article>{TEXT}</article>", "a", "b")], schema)).collect()
    assert r.text == TEXT and r.n_chars == len(TEXT)
