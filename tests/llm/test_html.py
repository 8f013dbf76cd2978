import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylog.llm.html_text import PRIOR, blocks_of, extract, label_blocks, main_text, min_cut, page_graph, sample_pages, train

LONG = "A long sentence of an article, with many words in it. It goes on for a while, as articles do."
PAGES = {
    f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; 2024</footer>": f"Title\n{LONG}\nShort.",
    f"<html><body><header><h1>Site</h1></header><main><p>One &amp; two &lt;3 &#233;&nbsp;x</p><p>{LONG}<br>on</p></main><aside>{LONG}</aside>": f"One & two <3 é x\n{LONG} on",
    f"<div class='menu'>{LONG}</div><div id=content><h2>Head</h2><p>{LONG}</p>loose text of the page, {LONG}</div><div class=comments><p>{LONG}</p></div>": f"Head\n{LONG}\nloose text of the page, {LONG}",
    f"<article><p><b>bold<br><p>{LONG}<script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><ul><li>a<li>b</ul></article>": f"bold\n{LONG}\na\nb",
    f"<ARTICLE><P>{LONG}</P><DIV CLASS='ad'>Buy</DIV><FORM><label>Mail</label><input></FORM><section id=comments><article><p>{LONG}</p></article></section></ARTICLE>": LONG,
    f"<div role=alert>{LONG}</div><div class='cookie-notice'>{LONG}</div><article><header><h1>T</h1></header><p title='a > b'>{LONG}</p><footer>tags</footer></article>": f"T\n{LONG}",
    f"<article><p>{LONG}</p><blockquote>said</blockquote><pre>a\n  b</pre><table><tr><td>1<td>2</table><p>1 < 2 and a<b>c</b>d</p>": f"{LONG}\nsaid\na b\n1\n2\n1 < 2 and acd",
    "": "", "   ": "", "<nav>only a menu</nav>": "", "<script>never ends": "", "<!-- never ends": "", "<p": "", "<article></article>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert main_text(page) == PAGES[page]


def test_references_are_decoded_once():
    assert main_text(f"<article><p>&amp;lt; &amp;amp; {LONG}</p></article>") == f"&lt; &amp; {LONG}"


def test_cut_is_the_least():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(label, odds=odds, edges=edges):
            return sum(abs(x) for x, y in zip(odds, label, strict=True) if (x > 0) != y) + sum(w for a, b, w in edges if label[a] != label[b])

        assert cost(min_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_neighbours_decide_where_the_text_does_not():
    assert min_cut([5.0, -0.5, 5.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]
    assert min_cut([5.0, -3.0, 5.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, False, True]


def test_classifier_is_trained():
    pages = [f"<nav><a href=/>Home</a><a href=/b>About us</a></nav><article><p>{LONG}</p><p>{LONG} {LONG}</p></article>"] * 20
    weights = train(pages)
    assert weights[2] < 0 and (weights != PRIOR).any()
    assert (train([]) == PRIOR).all() and (train(["<article>x</article>"]) == PRIOR).all()


def test_table(spark):
    rows = [(i, f"http://x/{i}", p) for i, p in enumerate(PAGES)] + [(100, "u", None), (101, None, "<article><p>" + LONG * 3000 + "</p></article>"), (101, None, "<article><p>" + LONG * 3000 + "</p></article>"), (None, None, "<article>x y</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"k": F.lit(1), "h": F.lit(2), "_text": F.lit(3)})
    out = extract(df).collect()
    assert len(out) == len(rows) and all((r["k"], r["h"], r["_text"]) == (1, 2, 3) for r in out)
    got = {r["page_id"]: r for r in out}
    assert all(got[i]["text"] == want for i, want in enumerate(PAGES.values()))
    assert got[100]["text"] == "" and got[101]["text"] == LONG * 3000 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract(df.where("false")).collect() == []


@pytest.mark.parametrize("start, end", [
    ("<article class='post comments-open'>", "</article>"), ("<main class='content no-sidebar'>", "</main>"), ("<div class='layout has-sidebar'><article>", "</article></div>"),
    ("<article class='post related'>", "</article>"), ("<div class='with_sidebar'><main id=main>", "</main></div>"),
])
def test_layout_classes_leave_the_article(start, end):
    assert main_text(f"<nav>Menu</nav>{start}<p>{LONG}</p><div class='comments'><article class=comment><p>{LONG}</p></article></div>{end}<div class=sidebar>{LONG}</div>") == LONG


@pytest.mark.parametrize("attrs", ["id='related-work'", "id=discussion", "class='text share-info'", "class='post-related-notes'"])
def test_words_in_names_do_not_veto_long_text(attrs):
    assert main_text(f"<nav>Menu</nav><article><p>{LONG}</p><section {attrs}><h2>More</h2><p>{LONG}</p><p>{LONG}</p></section></article>") == f"{LONG}\nMore\n{LONG}\n{LONG}"
    assert main_text(f"<div {attrs}><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n{LONG}"


def some_page(rng, i, bare=False):
    """A page and its article; ``bare``: without a name that tells."""
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."
    body = [text(rng.randint(3, 9))[:-1]] + [" ".join(text(rng.randint(5, 14)) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(2, 7))]
    nav = "".join(f"<li><a href=/{k}>{text(1)[:-1]}</a>" for k in range(rng.randint(3, 8)))
    box = (lambda name, s: f"<div>{s}</div>") if bare else (lambda name, s: f"<{name}>{s}</{name}>")
    inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{p}" for p in body[1:])
    return box("nav", f"<ul>{nav}</ul>") + box("article", inner) + box("footer", f"&copy; {2000 + i} {text(4)}"), "\n".join(body)


def test_text_and_place_do_where_names_say_nothing():
    rng = random.Random(4)
    weights = train([some_page(rng, i)[0] for i in range(60)])
    pages = [some_page(rng, i, bare=True) for i in range(60)]
    assert sum(main_text(page, weights) == want for page, want in pages) >= 57


def test_labels_of_whole_pages_are_the_least_cut():
    rng, turned = random.Random(5), 0
    for i in range(40):
        page = some_page(rng, i, bare=True)[0].replace("<p>", "<p><a href=/>x y</a> ", 1)
        blocks = blocks_of(page)[:14]
        weights = PRIOR + np.array([rng.uniform(-1, 1) for _ in PRIOR])
        odds, edges = page_graph(blocks, weights)

        def cost(label, odds=odds, edges=edges):
            return sum(abs(x) for x, y in zip(odds, label, strict=True) if (x > 0) != y) + sum(w for a, b, w in edges if label[a] != label[b])

        found = label_blocks(blocks, weights)
        turned += sum((x > 0) != y for x, y in zip(odds, found, strict=True))
        assert cost(found) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(blocks)))))
    assert turned  # the edges do change labels


def test_clashing_columns_and_the_sample(spark):
    df = spark.createDataFrame([(i, f"<article><p>{LONG} {i}</p></article>", "own", 5) for i in range(300)], "page_id long, html string, text string, n_chars int")
    out = extract(df).where("page_id = 7").first()
    assert (out["text"], out["n_chars"], out["_text"]) == ("own", 5, LONG + " 7") and out["_n_chars"] == len(out["_text"])
    assert 20 <= len(sample_pages(df, "html", most=60)) <= 60 and sample_pages(df, "html", chars=5) == []
    assert len(sample_pages(df.withColumn("html", F.lit("<p>x")), "html")) == 1
