import time

from dinelens.llm.html_text import Page, extract_text


def text(source, paths=()):
    return Page(source).extract(list(paths))


BODY = "A first paragraph of the article, long enough to count.", "A second one &amp; its&nbsp;end é."
ARTICLE = f"<h1>The title</h1><p>{BODY[0]}<p><b>{BODY[1]}</p>"
WANT = "The title\nA first paragraph of the article, long enough to count.\nA second one & its end é."


def page(main, extra=""):
    return (
        "<!DOCTYPE html><html lang='en'><head><title>t</title><style>p{}</style><script>var t='</p>';if(a<b){}</script></head><body class=home>"
        "<header><p>Site name and slogan</p></header><nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- <p>no</p> -->"
        f"<div class='ad'>Buy this now, it is cheap.</div>{main}{extra}<footer>&copy; someone</footer></body></html>"
    )


def test_boilerplate_goes_and_blocks_stay():
    extras = [
        "<aside>See also</aside>",
        "<div id='comments'><div class='comment'><p>First! A long reader comment that goes on and on for a while.</p></div></div>",
        "<form><label>Mail</label><input name=q><button>Go</button></form>",
        "<div class='cookie-notice'>We use cookies</div>",
        "<div hidden>secret</div><div style='display:none'>hidden</div>",
        "<section class='related-posts'><h2>Related</h2><p>More to read</p></section>",
        "<ul class='menu'><li>One<ul><li>Two</li></ul></li></ul>",
        "<noscript>Enable scripts</noscript><iframe>x</iframe><textarea>y</textarea>",
    ]
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class='post-12'>{}</div>", "<div id=x><div class='entry content'>{}</div></div>"):
        for extra in ["", *extras, "".join(extras)]:
            assert text(page(wrap.format(ARTICLE), extra)) == WANT, (wrap, extra)


def test_boilerplate_inside_the_article_goes():
    inside = ARTICLE.replace("<p><b>", "<div class='share'><a href=x>Share</a></div><div class='advert'>Ad</div><p class='notice'>Note<p><b>")
    assert text(page(f"<article>{inside}</article>")) == WANT


def test_markup_and_references():
    assert text("<p>a  <i>b</i>\n c&lt;d &#233;&#x1F600; &unknown; 1 < 2<br>e</p>") == "a b c<d é\U0001f600 &unknown; 1 < 2 e"
    assert text("<table><tr><td>x<td>y</table><ul><li>one<li>two</ul>") == "x\ny\none\ntwo"
    assert text("plain text only") == "plain text only"
    for broken in ("", "<", "<p", "<p class='", "</div></p>", "<!-- open", "<script>x", "<a href=\"x>y", "<div" * 50, "</" * 50, "<![CDATA[x", "<p>\x00"):
        Page(broken).extract(["html>body"])


def test_deep_nesting_takes_linear_time_and_memory():
    n = 100_000
    for one in ("<div>", '<div class="x">t ', '<div class="sidebar ad"><span class="promo">t '):
        began = time.process_time()
        p = Page(one * n)
        assert len(p.paths) == n + 1 and len(set(p.paths)) == n + 1
        p.votes()
        assert len(p.extract([1])) == (0 if one == "<div>" else 2 * n - 1)
        assert time.process_time() - began < 60


def test_an_empty_table(spark):
    got = extract_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text"] and got.collect() == []


def test_paths_of_the_host_win(spark):
    # The widget is longer than the article on one page; the other pages outvote it.
    good = [(i, "http://h.example/x", f"<body><div class='post-{i}'><p>{'Article words here. ' * 8}</p></div><div class='extra'><p>Short.</p></div></body>") for i in range(5)]
    odd = (9, "http://H.example:80/y", f"<body><div class='post-9'><p>{'Article words here. ' * 8}</p></div><div class='extra'><p>{'Noise noise noise. ' * 9}</p></div></body>")
    rows = [*good, odd, (10, None, None), (10, None, None), (11, "u", ""), (None, "http://q/", "<p>z</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text")
    got = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    assert extract_text(pages).count() == len(rows)
    assert got[9] == got[0] == ("Article words here. " * 8).strip()
    assert got[10] == got[11] == "" and got[None] == "z"
    assert extract_text(pages.limit(0)).count() == 0


def test_whole_article_on_the_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract_text(pages).collect():
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_title_and_lead_beside_the_inner_container_stay():
    # The inner div holds over 95% of the text; the title and the closing paragraph lie beside it.
    body = f"<h1>The title</h1><div class='entry'><p>{'Article words here. ' * 30}</p></div><p>The end.</p>"
    want = f"The title\n{('Article words here. ' * 30).strip()}\nThe end."
    source = f"<body><div class='page'><div class='post'>{body}</div></div></body>"
    assert text(source) == want
    path = Page(source).paths[Page(source).own()]
    assert text(source, [path]) == want
    # Beside the body's own inner containers, and with a linked title.
    assert text(f"<body><div><h1><a href='/'>The title</a></h1></div><div class='a'><div class='b'><p>{'Words. ' * 99}</p></div></div></body>").startswith("The title\nWords.")


def test_a_teaser_on_the_winning_path_does_not_win(spark):
    # Most pages of the host have their article in div.post; some only a teaser there and the article in div.story.
    long, teaser = ("Article words here. " * 20).strip(), ("Teaser words here. " * 7).strip()
    rows = [(i, "http://h.example/x", f"<body><div class='post'><p>{long}</p></div></body>") for i in range(6)]
    rows += [(i, "http://h.example/x", f"<body><div class='post'><p>{teaser}</p></div><div class='story'><p>{long}</p></div></body>") for i in range(6, 10)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(long in got[i] for i in range(10))
    # More templates on a host than paths are kept.
    many = [(i, "http://h.example/x", f"<body><div class='t{chr(97 + i % 26)}{chr(97 + i // 26)}'><h1>T</h1><p>{long}</p></div></body>") for i in range(120)]
    assert {r["text"] for r in extract_text(spark.createDataFrame(many, "page_id long, url string, html string")).collect()} == {f"T\n{long}"}


def test_words_on_wrappers_do_not_drop_the_article():
    side = "<div class='sidebar'><p>Some other text.</p></div>"
    for wrap in (
        "<div class='content has-sidebar'>{}</div>",
        "<div id='no-sidebar'>{}</div>",
        "<div class='noSidebar'>{}</div>",
        "<div class='post comments-open'>{}</div>",
        "<main class='with-sidebar'>{}</main>",
        "<div class='layout sidebar-right'><article>{}</article></div>",
        "<div class='sidebar'><main>{}</main></div>",
        "<div class='comments'><div>{}</div></div>",
    ):
        assert text(page(wrap.format(ARTICLE))) == WANT, wrap
        if "div class='sidebar'" not in wrap:
            assert text(page(wrap.format(ARTICLE), side)) == WANT, wrap
            assert text(page(wrap.format(ARTICLE + side))) == WANT, wrap
    posts = "".join(f"<div class='post-{i} comments-open'><p>Post number {i} with some words.</p></div>" for i in range(6))
    assert text(page(f"<div><p>All posts.</p>{posts}</div>")).count("with some words") == 6
    # Comments longer than the article, each one an article of its own.
    thread = "".join(f"<li class='comment'><article class='comment-body'><p>{'A reader says so. ' * 5}</p></article></li>" for _ in range(6))
    assert text(page(f"<article>{ARTICLE}</article>", f"<div id='comments'><ol>{thread}</ol></div>")) == WANT


def test_captions_labels_and_formulas_stay():
    inside = "<p>Before.</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn></math> shows.</p><p><label>A label.</label></p><object><p>Instead.</p></object>"
    assert text(page(f"<article>{inside}</article>")) == "Before.\nA caption.\nAs x=1 shows.\nA label.\nInstead."
