import math
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import common, html_extract

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages, urls=None):
    rows = [(i + 1, (urls or {}).get(i, f"http://h{i}.org/"), h) for i, h in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"] - 1: r["text"] for r in got}


def test_article_without_the_rest(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <header>site</header><nav><ul><li><a href="/">home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
      <article><h1>Title &amp;&amp; more</h1><p><b>First
        line</b>  of&nbsp;text<br>goes on<p>second <span>in</span>line &lt;b&gt; &copy; &#233;<div class="comments"><p>nice!</p></div>
      <form><input value="x">search</form><aside>see also</aside><ul><li>one<li>two</ul></article>
      <div id="cookie-notice">cookies</div><footer>&copy; me</footer></body></html>"""
    assert texts(spark, [page]) == {0: "Title && more\nFirst line of text goes on\nsecond inline <b> © é\none\ntwo"}


def test_site_style_tree_removes_what_a_site_repeats(spark):
    page = lambda i: f"<body><div id=top>Welcome to our site</div><div id=x7><p>story number {i} is new</p></div><div class=q9>All rights kept</div></body>"
    got = texts(spark, [page(i) for i in range(6)], {i: "https://Site.org:8080/p" for i in range(6)})
    assert got == {i: f"story number {i} is new" for i in range(6)}
    alone = texts(spark, [page(0)])
    assert alone[0] == "Welcome to our site\nstory number 0 is new\nAll rights kept"


def test_copies_of_a_page_dont_make_its_content_unimportant(spark):
    page = "<body><div id=a>one</div><div id=b>two</div></body>"
    assert set(texts(spark, [page] * 8, {i: "http://s.org/" for i in range(8)}).values()) == {"one\ntwo"}


def test_alike_articles_stay(spark):
    page = "<article><p>same text</p></article><p>{}</p>"
    assert set(texts(spark, [page.format(i) for i in range(5)], {i: "http://s.org/" for i in range(5)}).values()) == {"same text"}


def test_what_a_site_repeats_within_its_articles(spark):
    """A block without a telling class goes, whatever the paragraphs beside it; what differs stays."""
    page = lambda i: "<main><h1>Story {0}</h1>{1}<p>Get our letter every week.</p></main>".format(i, "".join(f"<p>Paragraph {k} of the story {i}.</p>" for k in range(1 + i % 3)))
    got = texts(spark, [page(i) for i in range(6)], {i: "http://s.org/" for i in range(6)})
    assert got == {i: "\n".join([f"Story {i}", *(f"Paragraph {k} of the story {i}." for k in range(1 + i % 3))]) for i in range(6)}


def test_what_one_branch_of_a_site_repeats(spark):
    """Four list pages share a line that the other pages of the same style path haven't got."""
    pages = [f"<body><p>Choose one of our stories.</p><ul><li>list of stories {i} and more of them</ul></body>" for i in range(4)]
    pages += [f"<body><p>the story {i} itself</p></body>" for i in range(20)]
    got = texts(spark, pages, {i: "http://s.org/" for i in range(24)})
    assert got == {i: f"list of stories {i} and more of them" if i < 4 else f"the story {i - 4} itself" for i in range(24)}


def test_a_line_that_articles_share_at_different_places_stays(spark):
    """It lies among contents that differ: its style node is important."""
    pages = ["<article>" + "".join(f"<p>{'A line of many stories.' if k == i % 4 else f'Paragraph {k} of {i}.'}</p>" for k in range(4)) + "</article>" for i in range(8)]
    got = texts(spark, pages, {i: "http://s.org/" for i in range(8)})
    assert all(t.count("\n") == 3 and "A line of many stories." in t for t in got.values())


def test_noise_within_a_line(spark):
    pages = ['<p>one <span class="ad">Buy now</span> two</p>', "<p>one <a class=share-link href=x>Share <a>it</a></a>two", "<p>one<span class=ad>Buy<p>two</span></p>three", '<p>one <b class="strong-ad-hoc">x</b></p>', "<p>a <small id=cookie-notice>ok <small>really</small> yes</small>b</p>"]
    assert texts(spark, pages) == {0: "one two", 1: "one two", 2: "one\ntwo\nthree", 3: "one x", 4: "a b"}


def test_names_that_are_phrases_of_the_content(spark):
    names = ("side-by-side", "form-of-government", "searching", "notice-of-rights", "platform", "sides", "header-image", "add", "menuett")
    page = "<article><p>Start.</p>" + "".join(f'<section class="{n}"><p>In {n}.</p></section>' for n in names) + "</article>"
    assert texts(spark, [page]) == {0: "\n".join(["Start.", *(f"In {n}." for n in names)])}


def test_deep_noise_goes_whole(spark):
    page = "<article><p>in the article</p></article><div class=sidebar>" + "<div>" * 2100 + "x" + "</div>" * 2100 + "<p>rest of the sidebar</p></div><p>after</p>"
    assert texts(spark, [page, page.replace("<article>", "<div>").replace("</article>", "</div>")]) == {0: "in the article", 1: "in the article\nafter"}


def brute_force_importance(pages):
    """Of each style node, from whole sets of pages: 1 less the mean of its contents' entropies over the pages, added up page by page."""
    holders = defaultdict(lambda: defaultdict(set))
    for url, source in pages:
        page, site = html_extract.Page(source), html_extract.ident(html_extract.host(url))
        key = (site, tuple(b[1] for b in page.blocks))
        for (_, text, _), nodes in zip(page.blocks, page.nodes(site), strict=True):
            for node in nodes:
                holders[node][text].add(key)
    out = {}
    for node, contents in holders.items():
        m = len(set().union(*contents.values()))
        entropy = [-sum(1 / len(p) * math.log(1 / len(p), m) for _ in p) if m > 1 else 0 for p in contents.values()]
        out[node] = (m, 1 - sum(entropy) / len(entropy))
    return out


def test_importance_is_the_brute_force_entropy(spark, sf_dir):
    rows = [(r["url"], r["html"]) for r in common.table(spark, sf_dir, "pages").collect()]
    rows += [(f"http://s.org/{i}", f"<body><p>a</p><p>{i % 3}</p><ul>{'<li>x<li>y' * (i % 4)}</ul><div>end</div></body>") for i in range(20)] * 2
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA)
    got = {r["node"]: (r["m"], r["importance"]) for r in html_extract.importance(html_extract.parsed(pages)).collect()}
    want = brute_force_importance(rows)
    assert got.keys() == want.keys() and Counter(m for m, _ in want.values())[12]
    assert all(got[n][0] == m and got[n][1] == pytest.approx(x, abs=1e-9) for n, (m, x) in want.items())


def test_many_low_nodes_are_joined(spark):
    """Beyond the broadcast's bound the low nodes are met in a join, with the same result."""
    page = lambda i: f"<body><div id=top>Welcome</div><p>story {i}</p><div class=q9>All rights kept</div></body>"
    df = spark.createDataFrame([(i // 2, "http://s.org", page(i // 2)) for i in range(12)] + [(99, None, None)], SCHEMA)
    few, many = (sorted(map(tuple, html_extract.extract(df, n).collect())) if n is not None else None for n in (10, 0))
    assert few == many and {r[2] for r in few} == {"", *(f"story {i}" for i in range(6))}


def test_articles_that_are_not_the_main_text(spark):
    body = "<div class=entry-content><p>The story itself is told here at length.</p></div>"
    comments = "<ol><li class=comment><article><p>nice!</p></article></li></ol>"
    pages = [body + comments, body + "<aside><article><p>see also</p></article></aside>", body + "<article class=teaser><p>Next story</p></article>"]
    story = "The story itself is told here at length."
    assert texts(spark, pages) == {0: story, 1: story, 2: f"{story}\nNext story"}


def test_tags_that_are_never_closed(spark):
    pages = ["<head><meta charset=x><body><p>in", "<div><button>send</div><p>after", "<svg><title>t</title><text>no</text></svg><p>yes", "<p>a<script>b</p>"]
    assert texts(spark, pages) == {0: "in", 1: "after", 2: "yes", 3: "a"}


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain text only", "<p>a < b and c<d <", '<p title="a>b">x</p>', "<div>" * 5000 + "deep" + "</div>" * 5000, "<p>" + "long " * 50_000, "<!-- open", "<script>never closed", "</p></div>ok", "<p>\x00&#0;&unknown;&amp"]
    got = texts(spark, pages, {0: None, 3: "not a url"})
    assert [got[i] for i in range(4)] == ["", "", "", "plain text only"]
    assert got[5] == "x" and got[6] == "deep" and len(got[7]) == 250_000 - 1 and got[8] == "" and got[9] == "" and got[10] == "ok"
    assert got[4].startswith("a < b and c")


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "n")] * 3, SCHEMA + ", host string")
    assert [r["text"] for r in html_extract.extract(df).collect()] == ["x"] * 3
    assert html_extract.extract(df.limit(0)).count() == 0


def test_hosts():
    assert [html_extract.host(u) for u in ("http://A.b:80/x", "https://u:p@c.d?q", "//e.f", "nothing", None, "")] == ["a.b", "c.d", "e.f", "", "", ""]
