import json

from webloom.operators import embedded, markup
from webloom.plans import markup_queries

DEEP = {"a": [[{"b": {"text": "deep words", "c": [{"display_url": "https://h.net/1.jpg", "alt_text": "one"}], "permalink": "https://h.net/p"}}]], "url": "https://h.net/2.png", "text": 7}


def page(*scripts, kind="application/ld+json"):
    return "<html>" + "".join(f'<script type="{kind}">{s}</script>' for s in scripts)


def nested(n):
    return {"text": f"level {n} text", "url": f"https://h.net/{n}.jpg", **({"in": [nested(n - 1)]} if n else {})}


def test_walk(spark):
    rows = [
        (1, "http://p.net/", page(json.dumps(DEEP), "{broken")),
        (2, "http://p.net/2", page(json.dumps([{"@type": "SocialMediaPosting", "description": "described #Tag"}, {"description": "not described"}, {"caption": "RT @who said"}, {"caption": "a caption", "created_at": "2024"}]))),
        (3, "http://p.net/3", page(json.dumps({"text": "short plain"}), kind="application/json") + page(json.dumps({"text": "long plain", "pad": "x" * 60}), kind="application/json")),
        (4, "http://p.net/4", page(json.dumps(nested(12)))), (5, None, None),
    ]
    dom = markup.scanned(spark.createDataFrame(rows, "page_id long, url string, html string"))
    nodes = embedded.walked(embedded.blocks(dom))
    posts = embedded.posts(nodes).collect()
    assert {(r.page_id, r.text, r.link, r.published) for r in posts if r.page_id < 4} == {
        (1, "deep words", "https://h.net/p", None), (2, "described #Tag", "http://p.net/2", None), (2, "a caption", "http://p.net/2", "2024"), (3, "long plain", "http://p.net/3", None)}
    assert sum(r.page_id == 4 for r in posts) == 13 and [r.hashtags for r in posts if r.text.startswith("described")] == [["tag"]]
    images = embedded.images(nodes).collect()
    assert {(r.image, r.alt, r.post) for r in images if r.page_id == 1} == {("https://h.net/1.jpg", "one", "https://h.net/p")}
    assert sum(r.page_id == 4 for r in images) == sum(range(1, 14))


def test_content(spark):
    rows = [
        (1, "http://p.net/", page(json.dumps({"text": "embedded post"})) + "<meta name=description content='A page about it'>"),
        (2, "http://p.net/2", "<meta name=description content='A page about it'>"),
        (3, "http://p.net/3", 'x {"full_text": "first\\nline \\"quoted\\""} <article>An article of length</article>'),
        (4, "http://p.net/4", '{"full_text": "some post"} {"is_retweet": true}'),
    ]
    got = {(r.page_id, r.origin, r.text) for r in embedded.content(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "embedded", "embedded post"), (2, "description", "A page about it"), (3, "full_text", 'first\nline "quoted"')}
    assert embedded.content(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_content_has_all_posts(spark):
    """More than twenty full texts and 25 posts by markup, long ones too, all count."""
    full = " ".join(json.dumps({"full_text": f"full text {n} \n"}) for n in range(45)) + json.dumps({"full_text": "long \n" * 50_000})
    posts = "".join(f"<div class=post>Post {n} by its markup</div>" for n in range(60))
    rows = [(1, "http://p.net/", f"<p>{full}</p>{posts}"), (2, "http://p.net/2", "x" + full + '{"reposted": true}')]
    got = [tuple(r) for r in embedded.content(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = [(1, "full_text", f"full text {n} \n", "http://p.net/") for n in range(45)] + [(1, "full_text", "long \n" * 50_000, "http://p.net/")]
    want += [(1, "markup", f"Post {n} by its markup", "http://p.net/") for n in range(60)]
    assert sorted(got) == sorted(want)


def test_odd_data(spark):
    """Data of thousands of levels is read, which ended the JVM when levels were tables; malformed data and keys twice are left out, marks behind escapes are found."""
    deep = '{"in":' * 3000 + '{"text": "deep words", "display_url": "https://h.net/1.jpg"}' + "}" * 3000
    texts = {1: deep, 2: '{"text": "one words", "n": NaN}', 3: '{"text": "two words", "k": 1, "k": 2}', 4: '{"text": "three words"} behind', 5: '{"text": "four words", "x": "\\u0072epost"}', 6: '{"text": "half \\ud800 pair"}',
             7: '{"text": "five words", "is_retweet": true, "in": {"text": "six words"}}', 8: '{"text": "seven words", "in": ' + '{"a":' * 3000 + '{"is_retweet": true}' + "}" * 3001, 9: "\n [" + '{"text": "eight words", "n": ' + "9" * 5000 + "}]"}
    rows = [(k, "http://p.net/", 0, body) for k, body in texts.items()]
    nodes = embedded.walked(spark.createDataFrame(rows, "page_id long, url string, block int, body string"))
    assert {(r.page_id, r.text) for r in embedded.posts(nodes).collect()} == {(1, "deep words"), (4, "three words"), (6, "half ? pair"), (7, "six words"), (9, "eight words")}
    assert [(r.page_id, r.image, r.path) for r in embedded.images(nodes).collect()] == [(1, "https://h.net/1.jpg", "$" + ".in" * 3000)]


def test_pages_are_read_in_one_pass(spark, sf):
    """No level of the data and no page is kept in the checkpoint folder; what is shuffled are numbers, before pages are written."""
    for name in ("embedded_posts", "embedded_images", "social_content"):
        plan = markup_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and plan.count("MapInArrow") == 1
        assert "l_partkey" in plan and plan.count("Exchange hashpartitioning(page_id") == 2
