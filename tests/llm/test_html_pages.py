"""Pages that the given ones do not show: heads left open, class words on articles and on what holds them."""

import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toolweave.llm import html_text
from toolweave.llm.html_text import main_text

TEXT = "<p>one two three four five six seven eight</p>"
WORDS = "one two three four five six seven eight"
HEAD = "<html><head><meta charset=utf-8><title>T</title><style>p{}</style><link rel=x>"
ASIDE = "<div class='comment-list'><p>nice one</p></div>"


@pytest.mark.parametrize("page", [
    f"{HEAD}<body><article>{TEXT}</article>",
    f"{HEAD}<article>{TEXT}</article></html>",
    f"{HEAD}</head ><body><article>{TEXT}</article>",
    f"{HEAD}<body><article>{TEXT}</article><header>late</header>",
    f"<html><head class='menu-top'><title>T</title></titles></title><body><article>{TEXT}</article>",
    f"<head></head><article><select-box></select-box>{TEXT}</article>",
    f"<article class='post category-privacy'>{TEXT}</article>",
    f"<article class='post privacy'>{TEXT}</article>{ASIDE}",
    f"<main><article class='post tag-search'>{TEXT}</article></main>",
    f"<div class='layout-sidebar-right'><h1>No</h1><article>{TEXT}</article></div>{ASIDE}",
    f"<main><div class='layout-sidebar-right'><article>{TEXT}</article></div></main>",
    f"<div class='long-form'>{TEXT}</div>{ASIDE}",
    f"<div class='page-with-comments'><div class='long-form'>{TEXT}</div></div>",
])
def test_kept(page):
    assert main_text(page) == WORDS


@pytest.mark.parametrize("rest", [
    ASIDE,
    "<div class='post-comments'><article><p>nice one</p></article></div>",
    "<article class='comment-body'><p>nice one</p></article>",
    "<section id=comments><article><p>nice one</p></article></section>",
    "<div class='page-footer'><p>all rights</p></div>",
    "<div role=complementary><p>all rights</p></div>",
])
def test_still_dropped(rest):
    assert main_text(f"<body><article>{TEXT}</article>{rest}") == WORDS
    assert main_text(f"<body><article>{TEXT}{rest}</article>") == WORDS


LONG = " ".join(f"w{k}" for k in range(60))


def test_length_and_neighbours_decide_without_tags():
    links = "".join(f"<div><a href=/{k}>link {k}</a></div>" for k in range(4))
    linked = " ".join(f"<a href=/{k}>l{k} m{k}</a> x{k}" for k in range(12))
    flat = " ".join(f"l{k} m{k} x{k}" for k in range(12))
    page = f"<body>{links}<div>Share this</div>{links}<h1>Head line</h1><div>{LONG}</div><div>{linked}</div><div>{LONG}</div>{links}<div>Made by us</div>{links}"
    assert main_text(page) == f"Head line\n\n{LONG}\n\n{flat}\n\n{LONG}"
    assert main_text(f"<div>{LONG}</div><div><a href=/>see also this</a></div><div>{LONG}</div>") == f"{LONG}\n\n{LONG}"
    short = "Read <a href=/>this</a> with care and then go on to the rest"
    assert main_text(f"<div>{LONG}</div><div>{short}</div><div>{LONG}</div>").count("Read this with care") == 1


def test_the_tree_asks_for_links_first_and_uses_length_and_neighbours():
    def asked(tree):
        return {tree[0]} | asked(tree[2]) | asked(tree[3]) if isinstance(tree, tuple) else set()

    assert html_text.FEATURES[html_text.TREE[0]] == "links"
    used = {html_text.FEATURES[f] for f in asked(html_text.TREE)}
    assert {"words", "words_before", "links_after"} <= used
    assert all(html_text.decide(html_text.TREE, r[:-1]) == r[-1] for r in html_text.LABELLED)


def test_without_class_names_and_articles(spark):
    """The given pages as if nobody had marked anything but lines, links and navigation."""
    share = []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        bare = re.sub(r"<(/?)(?:article|main|section|aside)\b[^>]*>", r"<\1div>", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|\S+?(?=[\s>]))", "", r.html))
        want, got = Counter(main_text(r.html).split()), Counter(main_text(bare).split())
        share.append((sum((want & got).values()) / max(1, want.total()), sum((want & got).values()) / max(1, got.total())))
    found, right = (sum(x) / len(share) for x in zip(*share))
    assert found > 0.95 and right > 0.75, (found, right)


@pytest.mark.parametrize("piece", [
    "<script ", "<div>", "<p><td><div>", "<b><i></b>", "<div class=menu><h1>x</h1>", "<a \"", "<script></script ", "<!", "<!--", "<div><article>", "<li><div>", "<a>x", "<title>", "&amp", "<p class='", "</p>",
])
def test_time_in_proportion(piece):
    took = []
    for size in (60_000, 480_000):
        page = piece * (size // len(piece))
        began = time.process_time()
        main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


def test_nesting():
    deep = "<div>" * 100_000 + LONG + "</div>" * 100_000
    assert main_text(deep) == LONG
    assert main_text("<b>" * 2000 + LONG + "</b>" * 2000 + "<p>" + LONG) == f"{LONG}\n\n{LONG}"


def test_repeated_rows_and_names(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, page), (1, page), (2, None), (2, ""), (None, "<p>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"TEXT": F.lit("x"), "n_chars": F.lit("y")})
    got = html_text.extract(df)
    assert [c.lower() for c in got.columns] == ["page_id", "html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 0), (2, 0)]
    assert html_text.extract(df.limit(0)).count() == 0
