import html
import re

from passagelab.llm.html_template import extract, main_text, parse, report, templates
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, host string, token string, text string"


def by_hand(page):
    """For the tables' pages: the blocks of the article."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|br|article|div)\b[^>]*>", body)
    blocks = [" ".join(html.unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", b)).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {r.page_id: by_hand(r.html) for r in pages.collect()}
    found = {r.page_id: (r.text, r.n_chars) for r in report(pages).collect()}
    assert found == {k: (t, len(t)) for k, t in wanted.items()}


CASES = [
    ("<p>One <b>bo</b>ld<br>two</p>  <p>A &amp; B &lt;x&gt; &eacute;</p>", "One bold two A & B <x> é"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><article><h1>H</h1><p>text<p>more</article><footer>f</footer></body>", "H text more"),
    ("<body><header>top</header><div class='sidebar'>s</div><div id=cookie-notice>c</div><div>body text</div><form>f<input></form></body>", "body text"),
    ("<article><header><h1>Title</h1></header><p>x</p><aside>a</aside><div class='comments'><article class='comment'>reader</article></div><p>y</p></article>", "Title x y"),
    ("<script>var t='</p><article>';</script><article>a<script>x</script>b<!-- <p>no</p> -->c</article>", "abc"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>end</article>", "one two c1 c2 end"),
    ("<article>unclosed <p>text", "unclosed text"),
    ('<article data-x="a>b">q < 5 and <a href=\'x>y\'>link</a></article>', "q < 5 and link"),
    ("<article>a<span class=\"ad\">buy</span>b</article>", "ab"),
    ("<main><p>in main</p></main><p>outside</p>", "in main"),
    ("", ""),
    (None, ""),
    ("no markup   at\nall", "no markup at all"),
    ("<article><a href=\"x", ""),
    ("<nav>only menu</nav>", ""),
]


def test_cases():
    for page, text in CASES:
        assert main_text(page) == text, page


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(main_text("<article>" + "<p>word word</p>" * 50_000 + "</article>")) == 500_000 - 1
    assert main_text("<" * 20_000).startswith("<")


def site(k):
    return f"<body><div>Welcome to our site</div><div><p>Own words of page {k} here.</p><p>Second block {k * k}.</p></div><div>All about us</div></body>"


def test_fixed_texts_outside_an_article_are_the_template(spark):
    rows = [(k, f"https://a.example/{k}", site(k)) for k in range(12)] + [(100 + k, f"https://copies.example/{k}", site(1)) for k in range(6)]
    rows += [(200, "https://single.example/x", site(3))]
    pages = spark.createDataFrame([(*r, "h", "t", "x") for r in rows], PAGES)
    found = {r.page_id: r.text for r in extract(pages).collect()}
    assert found[3] == "Own words of page 3 here. Second block 9."
    assert found[100] == "Welcome to our site Own words of page 1 here. Second block 1. All about us"  # all is fixed: all stays
    assert found[200].startswith("Welcome")
    salted = {r.page_id: r.text for r in extract(pages, most_bytes=0).collect()}
    assert salted == found


def test_classes_nest(spark):
    rows = [(k, "a", f"<body><div class=w><ul>{'<li>x</li>' * (k + 1)}</ul></div><p>{k}</p></body>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page long, host string, html string")
    found = templates(pages).collect()
    assert len(found) >= 2 and {r.parent for r in found} >= {-1}
    outer = next(r for r in found if r.parent == -1)
    assert any(r.parent == outer["class"] for r in found)


def test_odd_rows(spark):
    rows = [(1, None, "<article>a</article>"), (1, None, "<article>a</article>"), (None, "x", None), (2, "http://h/", ""), (3, "not a url", "<p>t</p>")]
    pages = spark.createDataFrame([(*r, "h", "t", "x") for r in rows], PAGES)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in report(pages).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "t", 1)]
    assert report(spark.createDataFrame([], PAGES)).count() == 0


def test_tokens_carry_their_path():
    tokens, blocks = parse("<body><div class=a><p>x</p>yz</div></body>")
    assert ["/body/div.a/p", "x", 0] in [t[:3] for t in tokens] and blocks[0].path == "/body/div.a/p"
    assert {t[1]: t[4] for t in tokens if t[2] == 1} == {"<body>": 3, "<div.a>": 3, "<p>": 1}


def nameless(page):
    """The page with nothing in its tags' names that tells the article from the rest."""
    page = page.replace('<div class="ad">', '<div class="k1">').replace("<nav>", '<div class="k2">').replace("</nav>", "</div>")
    return page.replace("<article>", '<div class="k3">').replace("</article>", "</div>").replace("<footer>", '<div class="k4">').replace("</footer>", "</div>")


def test_the_template_decides_where_names_do_not(spark, monkeypatch):
    from passagelab.llm import html_template

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages.withColumn("host", html_template.host_of(F.col("url"))).groupBy("host").count().where("count >= 4").select("host")
    held = pages.withColumn("host", html_template.host_of(F.col("url"))).join(hosts, "host").select("page_id", "url", "html").collect()
    assert len(held) > 100
    wanted = {r.page_id: by_hand(r.html) for r in held}
    renamed = spark.createDataFrame([(r.page_id, r.url, nameless(r.html)) for r in held], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(renamed).collect()} == wanted
    whole = templates
    monkeypatch.setattr(html_template, "templates", lambda pages: whole(pages).limit(0))
    without = {r.page_id: r.text for r in extract(renamed).collect()}
    assert all(without[k] != t for k, t in wanted.items())


def test_renamed_articles_give_the_same_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {r.page_id: by_hand(r.html) for r in pages.collect()}
    renamed = pages.withColumn("html", F.expr("replace(replace(html, '<article>', '<div>'), '</article>', '</div>')"))
    assert {r.page_id: r.text for r in extract(renamed).collect()} == wanted


def test_several_templates_and_texts_in_the_main_slot(spark):
    body = "<body><form id=f><div class=t1>Top of {k}</div><div class=t2><h1>Title {k}</h1><div class=t3><p>Share this story</p><p>Words {long} of {k}.</p><div class=comments>reader {k}</div></div></div><div class=t4>© us</div></form></body>"
    other = "<body><div class=x1>Menu</div><div class=x2>List {k} of {long} things</div><div class=x3>Foot</div></body>"
    rows = [(k, "http://a.example/", body.format(k=k, long=f"own{k} " * 30)) for k in range(6)] + [(10 + k, "http://a.example/", other.format(k=k, long=f"item{k} " * 20)) for k in range(5)]
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == f"Title 2 Words {('own2 ' * 30).strip()} of 2." and found[12] == f"List 2 of {('item2 ' * 20).strip()} things"


def test_unclosed_and_nested_elements():
    assert main_text('<article>a<span class="ad"><span>x</span>buy</span>b</article>') == "ab"
    for name in ("select", "svg", "object", "noscript"):
        assert main_text(f"<article>a<{name}><p>b</p></article>") == "a b"
