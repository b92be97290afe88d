import html
import random
import time

import pytest

from tidemark.llm import html_extraction as H

TREE = H.train()
P1 = "This is the first paragraph of a long enough article, with a <a href='/x'>link</a> &amp; some marks &eacute; &#233;."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a> <p>Our slogan is short</p></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for everyone who reads it.</div><!-- ad --><div class="ad">Buy now our great things.</div>
<article><h1>The  title\n here</h1><p>{P1}<p><b>Unclosed bold<br>second<p>Short.</p></article>
<aside>Popular posts this week that others read</aside><section id="comments"><h2>Comments</h2><p>I disagree with all of this text, really.</p></section>
<form><label>Your mail</label><input><button>Go</button></form><footer>&copy; us &middot; all rights</footer></body></html>"""


def test_tree_learns_its_table_and_asks_both_neighbours():
    assert all(H.is_content(TREE, row[:-1]) == bool(row[-1]) for row in H.rows_of_pages(H.LABELLED))
    asked, todo = set(), [TREE]
    while todo:
        node = todo.pop()
        if node.feature >= 0:
            asked.add(node.feature)
            todo += [node.low, node.high]
    assert asked & {4, 5} and asked & {6, 7}  # words and links of the block before, and of the one after


def test_neighbours_decide_where_nothing_else_does():
    menu = "".join(f"<p><a href=/{i}>item {i}</a></p>" for i in range(4))
    p = "<p>" + "many words of a real text " * 8 + "</p>"
    assert "Nine words that stand alone between the menu lists" not in H.main_text(f"<body>{menu}<p>Nine words that stand alone between the menu lists</p>{menu}{p}", TREE)
    assert "Nine words that stand alone between the menu lists" in H.main_text(f"<body>{menu}{p}<p>Nine words that stand alone between the menu lists</p>{p}", TREE)
    assert H.main_text(f"<article>{p}<p><a href=/>The linked source</a></p>{p}</article>", TREE).split("\n")[1] == "The linked source"
    assert "item" not in H.main_text(f"<article>{p}{menu}</article>", TREE)


def test_article_without_its_surroundings():
    assert H.main_text(PAGE, TREE) == "\n".join(["The title here", "This is the first paragraph of a long enough article, with a link & some marks é é.", "Unclosed bold second", "Short."])


@pytest.mark.parametrize("opening", ["<body>", '<body class="has-sidebar">', '<body class="no-sidebar single-post">', '<body class="page header-fixed">', '<body class="modal-closed">', '<body class="sidebar">', '<body><div class="content search-enabled">', '<body><div class="sidebar">', "<body><form>"])
def test_against_articles_of_known_text(opening):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "a&b", "c<d", "é", "zero​width"]
    for _ in range(60):
        paragraphs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        title = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        body = f'<div class="entry-header"><h1>{html.escape(title)}</h1></div>' + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        page = f"<html>{opening}<nav><a href=/>x</a></nav><div class='ad'>buy</div><article>{body}</article><footer>end</footer>"
        assert H.main_text(page, TREE) == "\n".join([title, *paragraphs])


def test_against_known_text_without_an_article_element():
    rng = random.Random(6)
    for _ in range(60):
        paragraphs = [" ".join("word" for _ in range(rng.randint(20, 90))) for _ in range(rng.randint(2, 6))]
        links = lambda n: "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(n))
        page = f'<html><body class="has-sidebar"><ul>{links(5)}</ul><div id="page-7"><h1>The title of it</h1>' + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div><h3>Related</h3><ul>{links(4)}</ul></body>"
        assert H.main_text(page, TREE) == "\n".join(["The title of it", *paragraphs])


def test_time_is_linear_in_nesting():
    def took(page):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            H.main_text(page, TREE)
            best = min(best, time.perf_counter() - began)
        return best

    for piece in ("<div>", "<p><b>", "<i></b>", "<a '"):
        assert took(piece * 16000) < 10 * max(took(piece * 4000), 0.002)


def test_query(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<article><p>cut o<"), (4, "u", "<p>" * 2000 + "x"), (5, "u", "<div class='ad"), (6, "u", "<article><p>&am it & that"), (7, "u", "<article><p>" + "long text " * 100_000)]
    out = H.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [r.n_chars for r in out] == [len(r.text) for r in out] and out[0] == out[1] and len(out) == 9
    assert out[2].text == out[3].text == "" and out[7].text == "&am it & that" and out[8].n_chars == 999_999
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
