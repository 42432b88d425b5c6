import re

from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import markup
from webloom.plans import markup_queries


def test_malformed_markup():
    d = markup.scan("<html><title>T &amp; t</title><p>one<p>two <b>bold <i>x</b> y<script>if (a<b) {'</p>'}</script><a href=/u class=k>link <a href='/v'>next</ul></div> end<img src=i.png alt=A")
    assert d["text"] == "T & tonetwo bold x ylink next end"
    assert [(x["href"], x["anchor"]) for x in d["links"]] == [("/u", "link"), ("/v", "next end")]
    assert d["images"] == [{"src": "i.png", "alt": "A", "link": "/v"}] and d["scripts"] == [{"type": "", "body": "if (a<b) {'</p>'}"}]
    assert markup.scan("plain  text\n < 3")["text"] == "plain text < 3" and markup.scan(None)["text"] == "" and markup.scan("<")["text"] == "<"
    assert markup.scan("<!-- a <p> --><nav>menu</nav><header>h</header>x<style>p{}</style><footer>f")["text"] == "x"
    assert markup.scan("<p>a < b and <3 c</p>")["text"] == "a < b and <3 c"
    assert markup.scan("<div " + "x" * 50_000 + "<p>" * 20_000)["posts"] == []


def test_posts_images_and_metas():
    d = markup.scan(
        "<meta property=og:description content='About me'><meta name=description content=Other><h1>Head <i>er</i></h1><article>A post of some length <a href='/p/1'><b><img data-src='/i/1.jpg'></b></a>"
        "<div class='x post'>inner post</div></article><div data-testid=tweet>words</div><img src='/logo.svg'><span class=p-name>Name</span>"
    )
    assert d["posts"] == ["A post of some length inner post", "inner post", "words"] and d["heading"] == "Head er" and d["names"] == ["Name"]
    assert d["images"] == [{"src": "/i/1.jpg", "alt": None, "link": "/p/1"}, {"src": "/logo.svg", "alt": None, "link": None}]
    assert [m["name"] for m in d["metas"]] == ["og:description", "description"]


def test_over_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in markup.scanned(pages).join(pages.select("page_id", "html"), "page_id").collect():
        bare = re.sub(r"(?is)<(script|style|nav|footer)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", "", r.html)
        assert "".join(r.dom["text"].split()) == "".join(__import__("html").unescape(bare).split())


def test_images_and_posts(spark):
    rows = [(1, "http://h.net/a/b", "<meta name='og:image' content='http://h.net/av.jpg?x'><a href='../p'><img src='c.jpg' alt='my selfie'></a><img src='//o.net/pixel.gif'><img src='http://h.net/av.jpg'>"),
            (2, "http://h.net/", "<meta name=description content='A description #Tag by @some_one'><article>RT @x this is a repost</article>"),
            (3, None, None), (4, "http://h.net/", "<article>A post with #One #one and @Two in it</article>" * 30)]
    dom = markup.scanned(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r.page_id, r.pos, r.image, r.post, r.self_reason) for r in markup.images(dom).collect()}
    assert got == {(1, 0, "http://h.net/a/c.jpg", "http://h.net/p", r"\bselfie\b"), (1, 2, "http://h.net/av.jpg", "http://h.net/a/b", "matches profile avatar")}
    p = markup.posts(dom).collect()
    assert [(r.text, r.hashtags, r.mentions) for r in p if r.page_id == 2] == [("A description #Tag by @some_one", ["tag"], ["some_one"])]
    assert sum(r.page_id == 4 for r in p) == 25 and p[-1].hashtags == ["one"]
    assert markup.profiles(dom).filter("page_id = 1").first().avatar == "http://h.net/av.jpg?x"
    assert {(r.page_id, r.target, r.pos) for r in markup.links(dom).collect()} == {(1, "http://h.net/p", 0)}
    assert markup.scanned(spark.createDataFrame([], "page_id long, url string, html string")).select(F.size("dom.links")).count() == 0


def test_all_posts_of_a_page(spark, tmp_path):
    """The query has every post of a page, as its SQL, and not those among the first 25 only."""
    articles = "".join(f"<article>The post of the page numbered {n}</article>" for n in range(40)) + "<article>short</article>"
    spark.createDataFrame([(1, "http://h.net/", articles), (2, "http://h.net/2", "<article>RT @x a repost of some length</article>" * 30 + "<article>Behind thirty reposts a post</article>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in markup_queries.page_posts(spark, str(tmp_path)).collect())
    assert got == [(1, n, f"The post of the page numbered {n}") for n in range(40)] + [(2, 0, "Behind thirty reposts a post")]


def test_scripts_alone(spark, sf):
    odd = ["<a title='<script>x</script>'>y<script>1</script>", "<!-- <script>a</script> --><SCRIPT type=x>b</Script ><script>", "<p><style><script>a</script></style><script type='t'>c", "<title><script>q</script></title><scripty>z</scripty><script/>x</script> <b", "x<script>1</script>", None]
    for page in odd + [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]:
        assert markup.scripts(page) == markup.scan(page)["scripts"]


def test_plain_links_are_placed_as_others(spark):
    bases = ["http://h.net", "HTTP://H.net:80/", "https://u@h.net:8443/a/b?x#y", "http://h.net/a//b/c", "http://h.net/a/../b/c", "http://h.net/é/x", "http://h.net/a/.b/c", "http://h.net/a/b/", "nothing", "", None, "http://h.net/-/x", "https://h.net:443/a"]
    links = ["/i/1.png", "i.png", "../p", "../p/q.r", "../../p", "./p", "/", "//o.net/x", "/a/", "a/", "/a/../b", "a/./b", "a/.b", "/.b", "?q", "#f", "a?x", "a#f", "a b", " /a ", "/a\n", "mailto:x", "a:b", "tel", "http://O.net/", "HTTPS://o.net/a/../b", "", None, "é", "/%2e/x", "..", ".", "../", "a..b/c.", "~u/-x_y"]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, l string").select("b", "l", urls.base(F.col("b")).alias("at"))
    for r in rows.select("b", "l", urls.placed_on(F.col("at"), F.col("l")).alias("quick"), urls.resolved(F.col("b"), F.col("l")).alias("whole")).collect():
        assert r.quick == r.whole, r


def test_an_address_of_a_picture_is_reckoned_once(spark):
    """The step that tells a post's pictures stands once in the plan, not again in each filter and column that uses the address."""
    dom = spark.createDataFrame([], "page_id long, url string, dom struct<images array<struct<src string, alt string, link string>>, metas array<struct<name string, content string>>>")
    plan = markup.images(dom).select("page_id", "pos", "image", "post", "alt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mailto") == 2  # of the picture and of its link; eight before
