"""Main text of pages."""

from pyspark.sql import functions as F

from cohortflow.llm import style_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">Cookies!</div><div id="sidebar">Side</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
 text<br>goes on<p>Second &eacute;&#233;<ul><li>one<li>two</ul><form><input name=q> Search</form>
<div class="share">Share this</div><section class="comments"><p>Nice!</p></section></article>
<aside>Aside</aside><footer>&copy; host</footer></body></html>"""


def test_article_blocks():
    assert style_tree.main_text(PAGE, set()) == "Title & more\nFirst bold text goes on\nSecond éé\none\ntwo"
    assert style_tree.main_text(None, set()) == "" and style_tree.main_text("", set()) == ""
    assert style_tree.main_text("plain &lt;text", set()) == "plain <text"
    assert style_tree.main_text("<p>a<div>b</div>c", set()) == "a\nb\nc"
    assert style_tree.main_text("<html><head><title>x</title><body><p>kept", set()) == "kept"


def test_layout_names_keep_the_page():
    for name in ("content-sidebar-wrap", "layout has-sidebar", "no-sidebar", "long-form", "no-comments", "sidebar-wrap", "page sidebar left"):
        for tag in ("article", "main"):
            page = f'<body><div class="{name}"><div id=inner><{tag}><p>First.<p>Second.</{tag}><div class="sidebar">Side</div></div></div></body>'
            assert style_tree.main_text(page, set()) == "First.\nSecond.", (name, tag)
        page = f'<body><div class="menu">Menu</div><div class="{name}"><p>First of many words.</p><p>Second.</p></div></body>'
        assert style_tree.main_text(page, set()) == "First of many words.\nSecond.", name
    form = "<body><form id=aspnet><main><p>Text</p></main></form></body>"
    assert style_tree.main_text(form, set()) == "Text"


def test_marked_branches_without_the_page_stay_silent():
    teasers = '<body><article><p>The whole long story.</p></article><div class="related"><article><p>Teaser</p></article></div></body>'
    assert style_tree.main_text(teasers, set()) == "The whole long story."
    inside = '<div class="has-sidebar sidebar"><article><p>The whole long story.</p></article><aside><article>Teaser</article></aside></div>'
    assert style_tree.main_text(inside, set()) == "The whole long story."
    comments = "<body><p>Short.</p><div class=comments><p>Very long comments by many readers.</p></div></body>"
    assert style_tree.main_text(comments, set()) == "Short."
    assert style_tree.main_text('<body><div class="cookie-notice">Cookies!</div></body>', set()) == ""


def test_layout_branch_is_a_node_of_the_tree():
    wrap = style_tree.parsed('<body><div class="content sidebar"><article><p>x</p></article></div></body>')
    plain = style_tree.parsed('<body><div class="other"><article><p>x</p></article></div></body>')
    assert len(wrap.parents) == len(plain.parents) == 4 and len(wrap.blocks[0][0]) == 4
    silent = style_tree.parsed('<body><div class="sidebar"><p>y</p></div><article><p>x</p></article></body>')
    assert silent.layouts[-1] == style_tree.parsed("<body><article><p>x</p></article></body>").layouts[-1]


def test_implied_ends_inside_silenced_elements():
    text = lambda html: style_tree.main_text(html, set())
    assert text('<div><p class="ad">Buy<p>Real one<p>Real two</div><p>More') == "Real one\nReal two\nMore"
    assert text('<ul><li class="share">x<li>real<li>too</ul>') == "real\ntoo"
    assert text('<dl><dt class="ad">x<dd>real</dl>') == "real"
    assert text('<p class="ad">Buy<div>Real</div>') == "Real"
    for unclosed in ("<nav><ul><li>Menu</ul>", "<header>Site", '<div class="ad">Buy', "<div role=banner>Site", "<span class=ad>Buy"):
        for tag in ("article", "main"):
            assert text(f"<body>{unclosed}<{tag}><p>Story</{tag}></body>") == "Story", (unclosed, tag)
    assert text("<body><nav><article>Teaser</article></nav><p>Story</body>") == "Story"


def test_main_before_articles_beside_it_and_math():
    text = lambda html: style_tree.main_text(html, set())
    assert text("<body><article>Teaser, longer than the text</article><main><p>Text</p></main></body>") == "Text"
    assert text("<main><p>Text</p><article>Story</article></main><article>Teaser</article>") == "Text\nStory"
    assert text("<main></main><article>Story</article>") == "Story"
    math = '<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="application/x-tex">x=1</annotation></math> holds<svg><text>Fig</text></svg></p>'
    assert text(f"<article>{math}</article>") == "So x=1 holds"


def test_repeated_branch_is_learnt_and_removed(spark):
    rows = [
        (i, f"http://Site.example/{i}?q=1", f"<body><div class=top><p>Always the same line</p></div><div class=story><p>Story number {i}</p><p>More of {i * 7}</p></div></body>")
        for i in range(12)
    ] + [(100, "http://other.example/", "<body><div class=top><p>Always the same line</p></div></body>"), (101, None, None), (102, "no host", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()}
    assert got[3] == "Story number 3\nMore of 21"
    assert got[100] == "Always the same line" and got[101] == "" and got[102] == "x"
    assert style_tree.extract(pages.limit(0)).count() == 0


def test_identical_pages_keep_their_article(spark):
    rows = [(i, "http://a.example/x", "<body><article><p>One text.</p></article></body>") for i in range(9)]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"One text."} and {r["n_chars"] for r in got} == {9}


def test_importance_is_the_entropy_formula(spark):
    rows = [("h", f"<body><div class=a><p>same</p></div><div class=b><p>{i}</p></div></body>") for i in range(4)]
    tree = style_tree.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()
    got = sorted(round(r["importance"], 6) for r in tree)
    # same block on all pages: content 0; different blocks: content 1; layouts never vary. body: 4 + 4 blocks, half of the weight repeated
    assert got == [0.0, 0.0, 0.45, 0.9, 0.9]


def test_filtered_blocks_equal_the_plain_form(spark):
    """The stored parse, filtered in Spark, against the text read from the page, whatever branches go."""
    pages = [
        PAGE, "", None, "<body><main><p>a</p></main><article><p>b</p></article><p>c</p></body>", "<body><article><p>b</p><p class=x>d</p></article><p>c</p></body>",
        "<body><p>a<p class=y>b</body>",
    ]
    rows = [(i, html, removed) for i, html in enumerate(pages) for removed in [[], *[[p] for p in sorted(style_tree.parsed(html).parents)]]]
    table = [(i, html, [style_tree._signed(p) for p in removed]) for i, html, removed in rows]
    parsed = style_tree.parsed_pages(spark.createDataFrame(table, "n int, html string, removed array<bigint>"))
    got = parsed.select("n", "removed", style_tree.kept_text(F.col("removed")).alias("text")).collect()
    want = sorted((i, tuple(removed), style_tree.main_text(html, {p % 2**64 for p in removed})) for i, html, removed in table)
    assert sorted((r["n"], tuple(r["removed"]), r["text"]) for r in got) == want
    assert len({t for _, _, t in want}) > 6


def test_odd_rows_of_a_table(spark):
    """Null and repeated ids, rows that differ under one id, a very long page, extra columns named like the operator's own."""
    long_text = "word " * 400_000
    rows = [
        (None, None, None, 1, "h", [1]), (1, "http://a/x", "<p>one", 1, "h", [1]), (1, "http://a/y", "<p>two", 1, None, None),
        (1, "http://a/y", "<p>two", 1, None, None), (2, "no url", f"<article><p>{long_text}</p></article>", None, "h", []),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row int, host string, path array<int>")
    got = style_tree.extract(pages).collect()
    assert sorted(((r["page_id"] or 0), r["text"]) for r in got) == [(0, ""), (1, "one"), (1, "two"), (1, "two"), (2, long_text.strip())]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
