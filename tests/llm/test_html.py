"""Wrapper induction: tree matching against brute force, templates, chrome and odd pages."""

import random

import pytest
from pyspark.sql import functions as F

from fogline.llm import html


def page(title, paragraphs, i, extra="", outside=""):
    menu = "".join(f'<li><a href="/{i}{k}">item {i} {k}</a>' for k in range(4))
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="menu">
    <header><a href=/>Site</a></header><nav><ul>{menu}</ul></nav><!-- <p>hidden</p> --><div class="ad banner">Buy {i}</div>{outside}<article><h1>{title}</h1>{"".join(f"<p>{x}" for x in paragraphs)}
    <div class="share-buttons">Share this {i}</div>{extra}<p>All rights of this text are reserved.</p><section id="comments"><article class="comment"><p>first! {i}</p></article></section></article>
    <aside><p>side {i}</p></aside><form><p>mail</p><input></form><footer>&copy; {i}</footer></body>"""


def texts_of(spark, pages, host="http://one.info/", **kwargs):
    d = spark.createDataFrame([(i, f"{host}{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html.extract_main_text(d, **kwargs).collect())]


def brute_size(a, b):
    """Nodes, and equal texts, of the best matching, by its definition."""
    if a.tag != b.tag:
        return 0
    p, q = a.kids, b.kids
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p)):
        for j in range(len(q)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_size(p[i], q[j]))
    return 1 + (a.tag == "#text" and a.text == b.text) + best[-1][-1]


def random_tree(r, depth=0):
    if depth == 4 or r.random() < 0.3:
        return r.choice("abcde")
    return "".join(f"<{t}>{random_tree(r, depth + 1)}</{t}>" for t in r.choices(["div", "p", "h2"] if depth else ["div"], k=r.randint(1, 4)))


def test_simple_tree_matching_equals_brute_force():
    r = random.Random(5)
    for _ in range(150):
        a, b = html.parse(random_tree(r)), html.parse(random_tree(r))
        m = html.Matching(a, b)
        assert m.size(a.root.cls, b.root.cls) == brute_size(a.root, b.root)
        pairs = html.align(a, b)
        assert pairs == [(i, j) for i, j in pairs if a.leaves[i].node.tag == b.leaves[j].node.tag]
        assert sorted(i for i, _ in pairs) == [i for i, _ in sorted(pairs)] and sorted(j for _, j in pairs) == [j for _, j in sorted(pairs)]


def test_matched_texts_are_ordered_and_favour_equal_ones():
    a = html.parse("<div><h1>t</h1><p>a</p><p>b</p><ul><li>x<li>y</ul></div>")
    b = html.parse("<div><p>b</p><ul><li>x<li>z<li>y</ul><p>c</p></div>")
    assert [(a.leaves[i].node.text, b.leaves[j].node.text) for i, j in sorted(html.align(a, b))] == [("b", "b"), ("x", "x"), ("y", "y")]


def test_pages_lose_chrome_and_template(spark):
    texts = [[f"Paragraph {i} &amp; more\n  text <b>bold</b><br>line", f"Second of {i}: " + "word " * (5 + i)] for i in range(8)]
    got = texts_of(spark, [page(f"Title {i}", t, i) for i, t in enumerate(texts)] + [None, "", "<p>lone", "plain &lt;text&gt;"])
    for i in range(8):
        assert got[i] == f"Title {i}\nParagraph {i} & more text bold line\nSecond of {i}: " + " ".join(["word"] * (5 + i))
    assert got[8:] == ["", "", "lone", "plain <text>"]


@pytest.mark.parametrize("broadcast", [html.BROADCAST, 0])
def test_every_page_of_a_host_is_judged_by_the_same_template(spark, broadcast):
    got = texts_of(spark, [page(f"Title {i}", [f"text {i} " * (3 + i % 5)], i) for i in range(131)], broadcast=broadcast)
    assert got == [f"Title {i}\n" + " ".join([f"text {i}"] * (3 + i % 5)) for i in range(131)]


def test_template_heavy_pages_have_a_template(spark):
    long = "".join(f"<div>Standing notice {k} of this host, which is longer than its articles.</div>" for k in range(9))
    assert texts_of(spark, [page(f"T {i}", [f"short {i}"], i, outside=long) for i in range(6)]) == [f"T {i}\nshort {i}" for i in range(6)]
    bare = texts_of(spark, [f"<body>{long}<div><h1>T {i}</h1><p>short {i}</div><div>{long}</div>" for i in range(6)])
    assert bare == [f"T {i}\nshort {i}" for i in range(6)]


def test_copies_of_one_article_are_no_template(spark):
    words = ["The same long article text in all of these pages, again and again.", "With a second paragraph that is the same as well."]
    got = texts_of(spark, [page("One title", [*words, f"tiny {i}"], i) for i in range(6)])
    assert all(words[0] in x and words[1] in x and f"tiny {i}" in x for i, x in enumerate(got))
    same = texts_of(spark, [page("One title", words, 1)] * 9)
    assert all(words[0] in x and words[1] in x for x in same)


def test_names_that_only_contain_chrome_words_are_content(spark):
    kinds = ["class='share-price'", "class='social-history'", "id='related-work'", "class='comment-on-policy'", "id='promotion-criteria'"]
    for kind in kinds:
        assert texts_of(spark, [f"<article><section {kind}><p>kept</section></article>"]) == ["kept"], kind
    for kind in ["class='site-footer'", "class='x adBanner'", "id=comments", "class='related-posts'", "role=navigation", "itemprop=comment", "hidden", "style='display: none'", "class='cookie-notice'", "class='social-links'"]:
        assert texts_of(spark, [f"<article><p>kept<section {kind}><p>dropped</section></article>"]) == ["kept"], kind


def test_a_story_outside_a_small_article_element_stays(spark):
    story = "<p>" + "a long story outside of any article element " * 5
    assert texts_of(spark, [f"<body><div>{story}</div><article>teaser</article>"]) == [" ".join(["a long story outside of any article element"] * 5) + "\nteaser"]


def test_deep_wide_and_long_pages_of_one_host(spark):
    deep = ["<div>" * 1500 + f"<p>deep {i}" + "<p>constant" for i in range(6)]
    assert texts_of(spark, deep) == [f"deep {i}" for i in range(6)]
    wide = ["<body>" + "".join(f"<p>p {i} {k}</p>" if (k + i) % 7 else f"<div>d {i} {k}</div>" for k in range(900)) + "<p>the end of all" for i in range(5)]
    got = texts_of(spark, wide)
    assert all(got[i].split("\n") == [f"{'p' if (k + i) % 7 else 'd'} {i} {k}" for k in range(900)] for i in range(5))
    long = ["<article><p>" + f"word{i} " * 200_000 for i in range(2)]
    assert [len(x) for x in texts_of(spark, long)] == [200_000 * 6 - 1] * 2


@pytest.mark.parametrize("broadcast", [html.BROADCAST, 0])
def test_pages_of_many_hosts(spark, broadcast):
    rows = [(i, f"http://h{i % 3}.info/{i}" if i % 4 else f"http://hot.info/{i}", page(f"T {i}", [f"body {i} " * 9], i)) for i in range(700)]
    rows += [(9, None, None), (9, None, None), (None, "http://hot.info/x", ""), (10**6, "http://deep.info", "<div>" * 5000 + "deep" + "<p>x" * 3000), (3, "http://h0.info/3", rows[3][2])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("Host", F.lit(1)).withColumn("own", F.lit(1))
    out = html.extract_main_text(d, broadcast).collect()
    assert len(out) == len(rows)
    assert all(x.text == f"T {x.page_id}\n" + " ".join([f"body {x.page_id}"] * 9) and x.n_chars == len(x.text) for x in out if x.page_id is not None and x.page_id < 700 and x.url)
    assert [x.text for x in out if x.url is None or x.page_id is None] == ["", "", ""]
    assert html.extract_main_text(d.limit(0), broadcast).count() == 0
