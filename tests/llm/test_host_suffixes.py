import html as H
import re

from helpers import sf

from flipframe.llm import host_suffixes as S

SCHEMA = "page_id long, url string, html string, text string, ident string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h, "c", "c") for i, u, h in pages], SCHEMA)
    got = S.page_texts(df).collect()
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(pages)
    return {r.page_id: r.text for r in got}


def test_pages_give_their_articles(spark):
    pages = sf(spark, "pages")
    got = {r.page_id: r.text for r in S.page_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


FOOT = "All prices include tax and are shown without delivery cost"


def test_repeated_runs_of_a_host_go_and_unique_ones_stay(spark):
    page = "<body><div>Top stories of this site for you today</div><div>{}</div><p>" + FOOT + "</p></body>"
    pages = [(k, f"http://a.com/{k}", page.format(f"First{k} unique words last{k}")) for k in range(4)]
    pages += [(9, "http://b.com/", page.format("Other host")), (10, "http://b.com/", page.format("Other host"))]
    got = texts(spark, pages)
    assert [got[k] for k in range(4)] == [f"First{k} unique words last{k}" for k in range(4)]
    pages = [(9, "http://b.com/", page.format("Other host")), (9, "http://b.com/", page.format("Other host"))]
    assert FOOT in texts(spark, pages)[9]  # one page, stored twice, repeats nothing


def test_run_inside_a_block_is_cut_out(spark):
    pages = [(k, "http://c.com/x", f"<div>Start {k} {FOOT} end{k}</div>") for k in range(2)]
    assert texts(spark, pages) == {k: f"Start {k}\n\nend{k}" for k in range(2)}


def test_long_repeats_equal_brute_force(spark):
    import random

    rnd = random.Random(3)
    pages = [(k, f"http://{'ab'[k % 2]}.org/", "<div>" + " ".join(rnd.choice("xy") for _ in range(40)) + "</div>") for k in range(8)]
    got = texts(spark, pages)
    for k, u, h in pages:
        w = h[5:-6].split()
        others = {tuple(x[i : i + S.RUN]) for j, v, t in pages if v == u and j != k for x in [t[5:-6].split()] for i in range(len(x) - S.RUN + 1)}
        gone = {i + n for i in range(len(w) - S.RUN + 1) if tuple(w[i : i + S.RUN]) in others for n in range(S.RUN)}
        runs = "".join(" " if i in gone else c for i, c in enumerate(w)).split()
        assert got[k] == "\n\n".join(" ".join(r) for r in runs)


def test_markup(spark):
    cases = {
        "<article><h1>T&eacute;st</h1><p>a <b>b</b>c<br>d &lt;i&gt; &#8364; &amp;amp;</p><script>x</script><!-- c --></article>": "Tést\n\na bc d <i> € &amp;",
        "<nav>menu</nav><main><p>one<p>two <i>x</main><footer>foot</footer>": "one\n\ntwo x",
        "<header><h1>Site</h1></header><article><header><h1>Real</h1></header><p>t</p><aside>no</aside><form>no</form></article>": "Real\n\nt",
        "<article><p>t</p><div class='comments'><article><p>reader</p></article></div></article>": "t",
        "<div class=\"cookie-notice\">c</div><div id=sidebar>s</div><div role='navigation'>n</div><p>kept</p><div hidden>h</div>": "kept",
        "<div class='main-content with-sidebar'><p>kept</p></div>": "kept",
        "<article><p>a < b and c</p></article>": "a < b and c",
        "<article><p>open": "open",
        "<nav><ul><li>never closed<article><p>text</p></article>": "text",
        "<style>p{}</style><p>x</p><script>var t='</p>';": "x",
        "<p>a<!-- never closed": "a",
        "": "",
        None: "",
        "plain words only": "plain words only",
        "<p></p> \u00a0 <p> </p>": "",
    }
    got = texts(spark, [(k, f"http://h{k}.net/", h) for k, h in enumerate(cases)])
    assert got == dict(enumerate(cases.values()))


def test_null_urls_long_pages_and_empty_tables(spark):
    long = "<article>" + "<p>w&amp;w</p>" * 30_000 + "</article>"
    got = texts(spark, [(1, None, "<p>a</p>"), (None, None, long), (3, "", None)])
    assert got[1] == "a" and got[3] == "" and got[None].count("w&w") == 30_000
    assert S.page_texts(spark.createDataFrame([], SCHEMA)).count() == 0


ESSAY = "The river rose in spring and the whole village moved its boats to higher ground"


def test_copies_of_a_page_keep_their_text(spark):
    page = "<nav>Menu {}</nav><div>" + ESSAY + "</div>"
    pages = [(k, f"http://m.com/{k}", page.format(k)) for k in range(3)] + [(3, "http://m.com/other", "<div>Something else</div>")]
    assert texts(spark, pages) == {**{k: ESSAY for k in range(3)}, 3: "Something else"}


def test_runs_end_with_their_block(spark):
    page = "<nav>Home News Sport Travel Money</nav><p>The story {0} tells of w{0}</p>"
    pages = [(k, f"http://n.com/{k}", page.format(k)) for k in range(4)]
    assert texts(spark, pages) == {k: f"The story {k} tells of w{k}" for k in range(4)}


def test_a_run_needs_its_share_of_the_pages(spark):
    phrase = "as far as anyone here can tell"
    pages = [(k, f"http://p.com/{k}", f"<p>In {k} it was so, {phrase if k < 2 else 'and'} more{k}</p><p>Share this</p>") for k in range(10)]
    assert texts(spark, pages) == {k: f"In {k} it was so, {phrase if k < 2 else 'and'} more{k}" for k in range(10)}


def test_layout_classes_mark_nothing():
    kept = [
        "<div class='{}'><article><p>text</p></article></div>".format(c)
        for c in ("layout has-sidebar", "menu-open", "nav-fixed", "no-comments", "widget-layout", "toolbar", "cookie-notice", "modal")
    ]
    kept += ["<div class='{}'><p>text</p></div>".format(c) for c in ("layout has-sidebar", "menu-open", "nav-fixed", "no-comments", "page no_ads")]
    kept += [
        "<article class='post comments-open'><p>text</p></article>", "<body class='comments'><p>text</p></body>",
        "<div class=sidebar><main><p>text</p></main></div>", "<section class='menu'><div><article>text</article></div></section>",
    ]
    for page in kept:
        assert [t for z, t in S.blocks(page) if z != S.MARKED] == ["text"], page
    gone = ["<{0}><article>text</article></{0}>".format(t) for t in ("aside", "footer", "div class=related", "div id='comments'", "div hidden")]
    gone += ["<div class='{}'>text</div>".format(c) for c in ("cookie-notice", "sidebar", "Site-Footer", "left sidebar-left", "nav", "comment-list")]
    gone += ["<article class=comment>text</article>", "<aside><main>text</main></aside>", "<article><div class=comments><article>text</article></div></article>"]
    for page in gone:
        assert S.blocks(page) == [(S.MARKED, "text")], page


def test_short_plain_text_beside_an_article_stays(spark):
    page = "<nav>Home</nav><div>By author {0}</div><article><p>Text {0}</p></article><p>" + FOOT + "</p>"
    pages = [(k, f"http://s.com/{k}", page.format(k)) for k in range(4)]
    assert texts(spark, pages) == {k: f"By author {k}\n\nText {k}" for k in range(4)}


def _text(page):
    return S.main_text(S.blocks(page), set())


def test_compound_classes_and_stray_quotes():
    for c in ("main-nav", "main-menu", "content-sidebar", "article-ad", "story-ad", "post-share"):
        assert _text(f"<div class='{c}'>Home About</div><article>A</article>") == "A", c
    assert _text("<article>A<div class='sidebar-content main-content'>B</div></article>") == "A\n\nB"
    assert _text("<p class=it's>Hello</p>") == "Hello"
    assert _text("<title>T</title><article>A</article>") == "A"


def test_inline_elements_split_no_block():
    assert _text("<article><p>The <span class='banner'>banner</span> text</p></article>") == "The banner text"
    assert _text("<p>An <a class='share' href=x>a share</a> of it</p>") == "An a share of it"


def test_broken_pages_take_linear_time():
    import time

    t = time.perf_counter()
    for page in ("<div>" * 40_000, "<div>" * 40_000 + "</b>" * 40_000, "<p>" * 40_000, "<a x='" * 40_000, "<p class=it's>" * 20_000, "<title>" * 40_000, "<a =\"x\"=\"x\"" * 20_000):
        S.blocks(page)
    assert time.perf_counter() - t < 10
