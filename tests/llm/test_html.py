from arrears.llm import html_extraction
from arrears.llm.html_extraction import Page, main_text

SHELL = ('<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{{}}</style></head><body>'
         '<header>Site name</header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy {n}</div>'
         '<div id="sidebar">Side {n}</div>{article}<section class="comments"><article>Nice {n}</article></section>'
         '<form>Search <input name=q></form><footer>&copy; site {n}</footer></body></html>')
ARTICLE = ("<article><header><h1>Head &amp;amp; {n}</h1></header><p><b>First   line\n of {n}.<br><p>A&nbsp;&lt;tag&gt; &#233; x<i>y</i>z"
           "<ul><li>one<li>two</ul><p>1 < 2 <!-- gone --> done<div class=share>Share</div></article>")
WANT = "Head &amp; {n}\nFirst line of {n}.\nA <tag> é xyz\none\ntwo\n1 < 2 done"
PAGE = "page_id long, url string, html string, text string, host string, n_chars int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", 1) for i, u, h in rows], PAGE)


def page(n):
    return SHELL.format(n=n, article=ARTICLE.format(n=n))


def test_articles_of_a_host(spark):
    rows = [(n, f"https://user@News.example.com:80/{n}?q#f", page(n)) for n in range(12)]
    got = {r.page_id: r for r in html_extraction.extract(pages(spark, rows)).collect()}
    assert len(got) == 12
    for n in range(12):
        assert got[n].text == WANT.format(n=n) and got[n].n_chars == len(got[n].text)
        assert got[n].url == rows[n][1]


def test_template_text_goes_where_a_host_has_no_article(spark):
    rows = [(n, "http://a.example/", f"<body><div class=top>Welcome</div><div class=body><h1>T{n}</h1><p>Body {n}</p></div></body>")
            for n in range(5)]
    got = {r.page_id: r.text for r in html_extraction.extract(pages(spark, rows)).collect()}
    assert got == {n: f"T{n}\nBody {n}" for n in range(5)}


def test_equal_pages_keep_their_article(spark):
    rows = [(n, "http://b.example/", page(1)) for n in range(9)] + [(1, "http://b.example/", page(1))]
    assert [r.text for r in html_extraction.extract(pages(spark, rows)).collect()] == [WANT.format(n=1)] * 10


def test_odd_pages(spark):
    long_text = "word " * 60_000
    rows = [(1, None, None), (None, "no url", ""), (2, "http://c/", "plain text"), (3, "http://c/", "<p>cut <b"),
            (4, "http://d/", f"<article><p>{long_text}</article>"), (5, "http://d/", "<" * 50 + "a" + "'\"" * 9),
            (6, None, "<article>x</article>"), (6, None, "<article>x</article>"), (7, "http://e/", "<script>never closed"),
            (8, "http://e/", "<nav>menu"), (9, "http://f/", "<ARTICLE>Up &unknown; &amp</ARTICLE>after")]
    got = html_extraction.extract(pages(spark, rows)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[1] == text[None] == text[7] == text[8] == ""
    assert text[2] == "plain text" and text[3].startswith("cut") and text[6] == "x"
    assert text[4] == long_text.strip() and text[9] == "Up &unknown; &"
    assert all(r.n_chars == len(r.text) for r in got)


def test_no_pages(spark):
    assert html_extraction.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_classes_share_an_occurrence_vector(spark):
    from pyspark.sql import functions as F
    rows = pages(spark, [(n, "http://h/", f"<body><ul>{'<li><a>x</a></li>' * (n + 1)}</ul><article><p>t{n}</article></body>")
                         for n in range(4)])
    known = html_extraction.templates(rows.select(F.lit("h").alias("host"), F.xxhash64("html").alias("page_key"), "html")).first()
    classes = {}
    for t in known.tokens:
        classes.setdefault(t["class"], []).append(t["token"])
    # body, ul, article, p stand once on every page; li and a as often as each other
    sizes = sorted(len(v) for v in classes.values())
    assert sizes[-2:] == [2, 4] or sizes[-1] == 4


def test_nested_main_elements_count_once():
    assert main_text(Page("<main>a<article><p>b</p></article>c</main>d"), set()) == "a\nb\nc"


def test_copies_of_a_page_are_not_its_hosts_template(spark):
    def plain_page(n):
        return f"<body><div class=body><h1>T{n}</h1><p>Body {n}</p></div></body>"

    rows = [(n, f"http://i.example/{n}", plain_page(0 if n < 6 else n)) for n in range(10)]
    got = {r.page_id: r.text for r in html_extraction.extract(pages(spark, rows)).collect()}
    assert got == {n: f"T{0 if n < 6 else n}\nBody {0 if n < 6 else n}" for n in range(10)}


def test_furniture_words_do_not_hide_the_article():
    side = "<div class=sidebar>side</div>"
    for page_html in (f"<article class='post no-comments'><p>Text</p>{side}</article>",
                      f"<main class='content with-sidebar'><p>Text</p>{side}</main>",
                      f"<div class='entry has-sidebar'><article><p>Text</p></article>{side}</div>",
                      f"<div class='entry has-sidebar'><main class=no-comments><p>Text</p></main>{side}</div>",
                      f"<div class='entry has-sidebar'><h1>Text</h1>{side}</div><nav>menu</nav>",
                      f"<div class='entry has-sidebar'><p>Text</p>{side}</div>"):
        assert main_text(Page(f"<html><body>{page_html}</body></html>"), set()) == "Text"
    # comments stay out beside an article, longer ones in all as well
    comments = "<article class=comment>nice</article><div class=comments>" + "<article>good</article>" * 9 + "</div>"
    assert main_text(Page(f"<article>The text</article>{comments}"), set()) == "The text"


def test_classes_decide_which_shared_texts_are_template(spark):
    def plain_page(n):
        quoted = "<p>A sentence many quote.</p><p>And its second half.</p>" if n < 4 else ""
        banner = "<div class=teaser-box>Buy now!</div>" if n % 3 else ""
        return f"<body><div class=top>Welcome</div>{banner}<div class=body><h1>T{n}</h1>{quoted}<p>Body {n}</p></div></body>"

    rows = [(n, f"http://j.example/{n}", plain_page(n)) for n in range(7)]
    got = {r.page_id: r.text for r in html_extraction.extract(pages(spark, rows)).collect()}
    # "Welcome" stands with the body on every page and the teaser with its own box; the quotation with no element
    quoted = "A sentence many quote.\nAnd its second half.\n"
    assert got == {n: f"T{n}\n{quoted if n < 4 else ''}Body {n}" for n in range(7)}
