import pytest

from forumshift.llm import wrappers as W

SCHEMA = "page_id long, url string, html string, host string, ref string, fixed string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def page(i, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>"
            f"<nav><ul><li><a href=\"/{i}\">menu{i}</a></li></ul></nav><!-- ad {i} --><div class=\"ad\">buy {i}</div>{extra}"
            f"{body}<footer>&copy; host &middot; foot{i}</footer></body></html>")


CASES = [
    ("<article><h1>A &amp; B</h1><p><b>A\n  &amp; B<br><p>one\ttwo</p><p>&eacute;&#x41;&#66; &am</article>", "A & B\nA & B\none two\néAB &am"),
    ("<article><p>a</p><div class='comments'><p>reader</p></div><aside>side</aside><p>b</p></article>", "a\nb"),
    ("<article><header><h1>Head</h1></header><p>x</p><form><input><button>go</button></form></article>", "Head\nx"),
    ("<header>site</header><main><div><p>in <i>main</i>.</p>tail</div><ul><li>l1<li>l2</ul></main>", "in main.\ntail\nl1\nl2"),
    ("<article><p>a<p>b</p></article><section id='comments'><article class='comment'>c</article></section>", "a\nb"),
    ("<div role='banner'>x</div><article><p>t</p><table><tr><td>1</td><td>2</td></tr></table></article>", "t\n1 2"),
    ("<article><p>cut <b>of", "cut of"),
    ("<article></article>", ""),
    ("<article><p>kept</p><p style='display: none'>not</p><p hidden>nor</p><noscript>js</noscript></article>", "kept"),
    ("<article><h1>h</h1>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>", "h\ndeep\nafter"),
]


@pytest.mark.parametrize("body,text", CASES)
def test_named_content(body, text):
    want = text if "cut of" not in text else "cut of"
    got = W.main_text(W.tree(page(1, body).replace("<footer>", "" if "cut" in body else "<footer>"))[0])
    assert got.startswith(want) if "cut" in body else got == want


def test_tree_matching_is_the_largest():
    """Against all order-preserving matchings of small trees."""
    import itertools
    import random

    def count(x, y):
        if x.label != y.label:
            return 0
        xs, ys = x.children(), y.children()
        best = 0
        for k in range(min(len(xs), len(ys)) + 1):
            for p in itertools.combinations(xs, k):
                for q in itertools.combinations(ys, k):
                    n = [count(u, v) for u, v in zip(p, q)]
                    if all(n):
                        best = max(best, sum(n))
        return best + 1

    rng = random.Random(5)

    def grow(depth):
        tag = rng.choice(["div", "ul", "section"])
        inner = "".join(grow(depth - 1) for _ in range(rng.randrange(0, 4))) if depth else ""
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        (a, _), (b, _) = W.tree(grow(2)), W.tree(grow(2))
        assert len(W.match(a, b)) == count(a, b)


def test_template_of_a_host_is_learned(spark):
    """Pages without a named article: what stays the same on a host is template."""
    body = "<div id='x'><p>Welcome to our site</p><div><p>story {i} text</p><p>more {i}</p></div><p>All rights reserved</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i, body.replace("{i}", str(i)))) for i in range(8)]
    rows += [(100, "http://lone.example/1", page(100, body.replace("{i}", "100")))]
    rows += [(200 + i, f"http://copies.example/{i}", page(7, "<article><p>the same text</p></article>")) for i in range(9)]
    got = {r.page_id: r.text for r in W.extract_pages(pages(spark, rows)).collect()}
    assert all(got[i] == f"story {i} text\nmore {i}" for i in range(8))
    assert got[100] == "Welcome to our site\nstory 100 text\nmore 100\nAll rights reserved"
    assert all(got[200 + i] == "the same text" for i in range(9))


def test_odd_rows(spark, monkeypatch):
    long = "<article>" + "<p>word word</p>" * 5000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain text"), (None, "http://a/", page(1, "<article><p>x</p></article>")),
            (4, "http://a/", "<<>><p>&lt;b&gt;</p><"), (5, "http://a/", long), (5, "http://a/", long)]
    for limit in (W.BROADCAST_BYTES, 0):  # references joined by broadcast or by the host
        monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
        out = W.extract_pages(pages(spark, rows))
        assert out.columns == ["page_id", "url", "text"]
        got = {(r.page_id, r.text) for r in out.collect()}
        assert {(1, ""), (2, ""), (3, "plain text"), (None, "x")} <= got
        assert (5, "\n".join(["word word"] * 5000)) in got
    assert W.extract_pages(pages(spark, [])).collect() == []


def test_constant_blocks_inside_an_article_are_template(spark):
    """Learned nodes also decide where the article is named; copies and near copies are no evidence."""
    def story(i, n):
        return "".join(f"<p>own text {i} of paragraph {k}, told at some length</p>" for k in range(n))

    rows = [(i, f"http://h.example/{i}", page(i, f"<article><h1>T{i}</h1><p>Read our guide first.</p>{story(i, 2 + i % 5)}"
                                               "<p>Reprints need our consent.</p></article>")) for i in range(12)]
    near = [f"<article><h1>Same</h1>{story(0, 9)}<p>copy {i}</p></article>" for i in range(12)]
    rows += [(100 + i, f"http://near.example/{i}", page(i, near[i])) for i in range(12)]
    got = {r.page_id: r.text for r in W.extract_pages(pages(spark, rows)).collect()}
    for i in range(12):
        assert got[i] == "\n".join([f"T{i}"] + [f"own text {i} of paragraph {k}, told at some length" for k in range(2 + i % 5)])
        assert got[100 + i].count("\n") == 10 and got[100 + i].endswith(f"copy {i}")


def test_long_lists_align_by_text():
    """A closing paragraph meets itself, however many paragraphs stand before it."""
    def body(i, n):
        return "<div>" + "".join(f"<p>{i} {k}</p>" for k in range(n)) + "<p>closing</p><ul><li>x</li></ul></div>"

    (a, xs), (b, ys) = W.tree(body(1, 900)), W.tree(body(2, 350))
    pairs = W.match(a, b)
    closing = [[n.number for n in t if n.text() == "closing"][0] for t in (xs, ys)]
    assert pairs[closing[0]] == closing[1]
    assert len(pairs) == len(ys)


@pytest.mark.parametrize("body,text", [
    ("<div class='page has-sidebar'><article><p>a</p></article><div class='sidebar'>s</div></div>", "a"),
    ("<article class='post comments-open'><p>a</p></article>", "a"),
    ("<form id='aspnet'><div class='widget'><article><p>a</p></article></div><div class='share-buttons'>s</div></form>", "a"),
    ("<article><h2 id='related-work'>Related work</h2><h2 id='search'>Search</h2><section id='discussion'><p>d</p></section>"
     "<div class='social-history'>h</div></article>", "Related work\nSearch\nd\nh"),
    ("<article><p>a</p><div class='comment-list'>c</div><div class='ad_box'>x</div><div class='site-footer'>f</div>"
     "<section class='related-posts'>r</section></article>", "a"),
    ("<article><p>a</p></article><div class='comments'><article class='comment'>c</article></div>", "a"),
    ("<main class='site-content no-sidebar'><p>m</p></main><aside><article>teaser</article></aside>", "m"),
    ("<div hidden><article>gone</article></div><main><p>m</p></main>", "m"),
    ("<div class='sidebar'><article>teaser</article></div><div><p>the story itself</p></div>", "the story itself"),
    ("<div class='text'>s</div><div class='comments'><article class='comment'>long one</article><article class='comment'>two</article></div>", "s"),
])
def test_words_that_name_no_chrome(body, text):
    """An element that holds the article is no chrome, nor one whose name only contains a word."""
    assert W.main_text(W.tree(page(1, body))[0]) == text


def test_long_mixed_lists_are_aligned_in_full(monkeypatch):
    """Lists of more than 200 children get the largest matching, also when the table is solved by halves."""
    import random

    rest = "<p>a</p><ul><li>b</li></ul>" * 120
    for cells in (W.CELLS, 1):
        monkeypatch.setattr(W, "CELLS", cells)
        (a, _), (b, ys) = W.tree("<div><h2>new</h2>" + rest + "</div>"), W.tree("<div>" + rest + "</div>")
        assert len(W.match(a, b)) == len(ys)
    rng = random.Random(8)
    for _ in range(30):
        x, y = ("<div>" + "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c</li></ul>"]) for _ in range(40)) + "</div>" for _ in range(2))
        sizes = []
        for cells in (1 << 16, 1):
            monkeypatch.setattr(W, "CELLS", cells)
            sizes.append(len(W.match(W.tree(x)[0], W.tree(y)[0])))
        assert sizes[0] == sizes[1]


@pytest.mark.parametrize("body,text", [
    ('<article><pre>x = 1 <span class="token comment"># set x</span></pre><p>see <em class="notice">this</em>, <a class="share">that</a> '
     'and <span id="search">there</span></p><p>a <span hidden>not</span>b</p></article>', "x = 1 # set x\nsee this, that and there\na b"),
    ("<article>" + "<div>" * 200 + "before<p>mid</p>after" + "</div>" * 200 + "<p>end</p></article>", "before\nmid\nafter\nend"),
    ("<article>" + "<div>x<b>" * 30_000 + "</i>" * 30_000 + "</article>", "\n".join(["x"] * 30_000)),
])
def test_depth_and_inline_elements(body, text):
    assert W.main_text(W.tree(page(1, body))[0]) == text


def grown(rng, depth, out, run):
    """A random story: its markup; appends the blocks it must give to ``out``; ``run``: the open text run."""
    def close():
        t = " ".join("".join(run).split())
        if t:
            out.append(t)
        run.clear()

    html = ""
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(8)
        if kind < 3:
            t = rng.choice(["word ", " two  words\n", "&amp;&eacute; ", "x"])
            html += t
            run.append(t.replace("&amp;&eacute;", "&é"))
        elif kind == 3:
            html += f'<{(i := rng.choice(["b", "em", "span", "code"]))} class="{rng.choice(["comment", "notice", "x", "ad"])}">in</{i}>'
            run.append("in")
        elif kind == 4:
            html += rng.choice(['<div class="ad">no</div>', "<nav><p>no</p>no</nav>", "<!-- no -->", "<script>no<p></script>", "<aside>no</aside>",
                                '<div style="display: none">no<p>no</p></div>'])
            if not html.endswith(("-->", "</script>")):
                close()
        elif depth:
            close()
            tag = rng.choice(["div", "section", "blockquote", "div class='x'"])
            html += f"<{tag}>" * (levels := rng.choice([1, 1, 1, 3, 3000] if depth == 3 else [1, 2])) + grown(rng, depth - 1, out, run)
            close()
            html += f"</{tag.split()[0]}>" * levels
    return html


def test_random_nested_pages_give_every_block_in_order():
    import random

    deep = 0
    for seed in range(150):
        rng, out, run = random.Random(seed), [], []
        html = grown(rng, 3, out, run)
        t = " ".join("".join(run).split())
        out += [t] if t else []
        deep += html.count("<div>" * 3000) > 0
        root, nodes = W.tree(page(seed, f"<article>{html}</article>"))
        assert W.main_text(root) == "\n".join(out), html[:500]
        if len(nodes) > 3000:
            assert len(W.match(root, W.tree(page(seed, f"<article>{html}</article>"))[0])) >= 3000
    assert deep >= 5
