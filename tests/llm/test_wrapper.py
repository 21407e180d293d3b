import pytest

from fieldwater.llm import wrapper as H

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li>'
    '<li>b</li></ul></nav><!-- x --><div class="ad">Buy {0}</div><article><h1>Head {0}</h1><p><b>One &amp; {0}.<br><p>Two\n\t  {0}</p></article>'
    '<aside>side {0}</aside><form>f<input></form><div id="comments"><p>reader {0}</p></div><footer>&copy; {0}</footer></body></html>'
)
SOUP = (
    "<div><div>Welcome to our site</div><table><tr><td>Rates</td></tr></table><div class='text'>{0}</div><span>Call us</span></div>"
)


def texts(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, text string, host string")
    return {r.page_id: r.text for r in H.extract(frame).collect()}


def test_article_pages(spark):
    got = texts(spark, [(k, f"http://h.example/{k}", PAGE.replace("{0}", f"v{k}")) for k in range(4)])
    assert got == {k: f"Head v{k}\nOne & v{k}.\nTwo v{k}" for k in range(4)}


def test_constant_nodes_of_a_host_are_template(spark):
    rows = [(k, f"https://u@Soup.example:80/{k}", SOUP.replace("{0}", f"story {k}<p>more {k}</p>" * (k + 1))) for k in range(5)]
    rows.append((9, "http://other.example/", SOUP.replace("{0}", "alone")))
    got = texts(spark, rows)
    assert {k: got[k] for k in range(5)} == {k: "\n".join([f"story {k}", f"more {k}"] * (k + 1)) for k in range(5)}
    # Nothing to compare with: no template, all blocks stay.
    assert got[9] == "Welcome to our site\nRates\nalone\nCall us"


def test_awkward_pages(spark):
    rows = [
        (1, "http://a.b/", None), (2, None, ""), (3, "nonsense", "plain text &lt;b&gt; &unknown; &#233;"), (4, "http://a.b/", "<p>one<p>two<li>x<li>y"),
        (5, "http://a.b/", "<div><p>open <b>bold <i>both</b> end"), (6, "http://a.b/", "<script>never closed <p>x"), (7, "http://a.b/", "<p title='a>b'>q</p><"),
        (8, "http://a.b/", "<p>" + "long " * 50_000 + "</p>"), (9, "http://a.b/", "<div>" * 150 + "deep" + "</div>" * 150), (4, "http://a.b/", "<p>one<p>two<li>x<li>y"),
    ]
    got = texts(spark, rows)
    assert got[1] == got[2] == got[6] == ""
    assert got[3] == "plain text <b> &unknown; é" and got[4] == "one\ntwo\nx\ny" and got[5] == "open bold both end"
    assert got[7].startswith("q") and len(got[8]) == 249_999 and got[9] == "deep"
    assert texts(spark, []) == {}


def test_a_site_that_repeats_one_article(spark):
    got = texts(spark, [(k, "http://same.example/x", PAGE.replace("{0}", "v")) for k in range(3)])
    assert set(got.values()) == {"Head v\nOne & v.\nTwo v"}


def brute(a, b):
    """Most pairs over all order-keeping matchings of children."""
    if a[0] != b[0]:
        return 0

    def children(x, y):
        if not x or not y:
            return 0
        return max(children(x[1:], y), children(x, y[1:]), brute(x[0], y[0]) + children(x[1:], y[1:]))

    return 1 + children(a[1], b[1])


@pytest.mark.parametrize(
    "pair", [("(a(b)(c(d))(b))", "(a(c(d)(e))(b))"), ("(a)", "(b)"), ("(a(p)(q)(p))", "(a(q)(p)(q))"), ("(r(a(x)(y))(b))", "(r(b)(a(y)(x))(b))")]
)
def test_tree_matching(pair):
    a, b = map(H.tree, pair)
    count, pairs = H.matched(a, b)
    assert count == len(pairs) == brute(a, b) or count == brute(a, b) == 0
    assert sorted(pairs) == sorted(set(pairs)) and len({p for p, _ in pairs}) == len({q for _, q in pairs}) == len(pairs)


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-comments", "search-results"])
def test_a_class_of_the_layout_does_not_drop_the_article(spark, name):
    shell = "<body><div class='menu'>m {0}</div><div class='%s'>%s<div id='comments'>c {0}</div></div></body>"
    inner = ["<main><article>a {0}</article></main>", "<article>a {0}</article>", "<p>a {0}, a text longer than all the comments</p>"]
    pages = [(shell % (name, i)).replace("{0}", str(k)) for i in inner for k in range(2)]
    got = texts(spark, [(k, f"http://h{k // 2}.example/", p) for k, p in enumerate(pages)])
    assert got == {**{k: f"a {k % 2}" for k in range(4)}, **{k: f"a {k % 2}, a text longer than all the comments" for k in (4, 5)}}


def test_side_regions_with_articles_of_their_own_are_left_out(spark):
    page = "<body><main><article>post {0}</article><div id='comments'><article>reader</article></div></main><aside><article>x {0}</article></aside></body>"
    assert texts(spark, [(k, "http://h.example/", page.replace("{0}", str(k))) for k in range(2)]) == {0: "post 0", 1: "post 1"}


@pytest.mark.parametrize("first", [None, "", "<div><div class='text'>only this</div></div>", "<h1>404</h1>"])
def test_template_does_not_depend_on_the_first_page(spark, monkeypatch, first):
    monkeypatch.setattr(H, "MERGED", 2)
    bars = "<div><ul><li>Our bar</li></ul><table><tr><td>Rates</td></tr></table>%s<div class='text'>{0}</div><h2>Call us</h2></div>"
    rows = [(0, "http://soup.example/", first)]
    rows += [(k, "http://soup.example/", (bars % ("<hr>" * (k % 3) + "<section>s {0}</section>" * (k % 2))).replace("{0}", f"story {k}")) for k in range(1, 7)]
    got = texts(spark, rows)
    assert {k: got[k] for k in range(1, 7)} == {k: f"s story {k}\n" * (k % 2) + f"story {k}" for k in range(1, 7)}
    assert got[0] == {"<h1>404</h1>": "404"}.get(first, "only this" if first else "")


def test_copies_of_an_odd_page_are_no_template(spark):
    rows = [(k, "http://h.example/", f"<p>story {k}</p>") for k in range(3)] + [(k, "http://h.example/", "<table><tr><td>odd page</td></tr></table>") for k in (7, 8)]
    got = texts(spark, rows)
    assert got[7] == got[8] == "odd page" and got[1] == "story 1"


@pytest.mark.parametrize("tag", ["div", "ul", "blockquote"])
def test_deep_pages(spark, tag):
    rows = [(k, "http://deep.example/", f"<{tag}>" * n + f"deep {k}" + "</b></p></table>" * 1000) for k, n in enumerate((50_000, 49_999, 50_000, 3))]
    assert texts(spark, rows) == {k: f"deep {k}" for k in range(4)}


def test_merged_trees_hold_both():
    trees = [H.tree(t) for t in ("(a(b)(c(d))(b))", "(a(c(d)(e))(b))", "(a)", "(a(p)(q)(p))", "(a(q)(p)(q(x)))", "(a(x(y))(b))")]
    whole = trees[0]
    for t in trees[1:]:
        whole = H.merged(whole, t)
    assert all(H.matched(t, whole)[0] == t[3] == brute(t, whole) for t in trees) and H.tree(H.written(whole)) is whole
