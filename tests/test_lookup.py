from pyspark.sql import functions as F

from webloom.operators import facets, gates, topic
from webloom.plans import lookup


def test_from_a_topic_to_its_report(spark):
    page = lambda title, links, lang="en": f"<html lang='{lang}'><title>{title}</title><body>" + "".join(f"<a href='{u}'>{t}</a>" for u, t in links) + "red kite survey text of some length</body>"
    rows = [
        (1, "http://birds.net/red-kite", page("Red kite survey of the west", [("/red-kite/north", "red kite north"), ("/other", "shop")])), (2, "http://birds.net/red-kite/north", page("Red kite survey of the north", [])),
        (3, "http://birds.net/other", page("A shop with nothing", [])), (4, "http://x.de/milan", page("Rotmilan und red kite survey", [], "de")), (5, "http://far.net/z", page("Far away", [])),
    ]
    found = lookup.lookup(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), "red kite survey", batch=1)
    visited = {r.url: r.runner for r in found.outcome.visited.collect()}
    assert visited["http://birds.net/red-kite"] == "graph" and visited["http://birds.net/red-kite/north"] == "graph" and visited["http://x.de/milan"] == "global" and "http://birds.net/other" not in visited
    assert found.outcome.saturated == {"graph", "global"} and {r.page_id for r in found.pages.collect()} >= {1, 2, 4}
    text = found.text()
    assert "Red kite survey of the west" in text and "| Saturated | yes |" in text and "DE" in text


def test_gate_order_and_places(spark):
    yes, no = F.lit(True), F.lit(False)
    none = F.lit(None).cast("array<string>")
    ask = lambda path, *x: gates.decision(F.lit(path), F.lit("GET"), *x)
    told = spark.range(1).select(
        ask("/health?x", no, no, no, none), ask("/v1/jobs", no, no, no, none), ask("/v1/jobs", yes, no, no, none), ask("/v1/jobs", yes, yes, no, none), ask("/v1/jobs", yes, yes, yes, none),
        ask("/v1/audit", yes, yes, yes, F.array(F.lit("viewer"))), ask("/v1/jobs?a", yes, yes, yes, F.array(F.lit("admin"))),
    ).first()
    assert list(told) == ["ok", "RATE_LIMITED", "ORGANISM_LOCKDOWN", "CLIENT_NOT_ALLOWLISTED", "UNAUTHORIZED", "FORBIDDEN", "ok"]
    texts = ["Salt Lake City, Utah and Main ST", "at 12 Main St, Reno NV", "lives in Porto", "none here"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(facets.current_places(F.col("t")).alias("p")).collect()
    assert [list(r.p) for r in rows] == [["Salt Lake City, Utah"], ["Main St, Reno NV"], ["Porto"], []] or rows[2].p == ["Porto"]


def test_profile_links(spark):
    about = topic.Topic.parse("red kite")
    rows = [(1, i, f"https://x.com/red-kite{i % 25}", "x.com", "red kite") for i in range(50)] + [(1, 60, "https://plain.net/red-kite", "plain.net", "red kite"), (1, 61, "https://x.com/login", "x.com", "red kite")]
    got = topic.profile_links(spark.createDataFrame(rows, "page_id long, pos int, target string, host string, anchor string"), about).collect()
    assert len(got) == 20 and len({r.target for r in got}) == 20 and all("x.com/red" in r.target for r in got)


def test_answers_from_pages(spark):
    from webloom.plans import answers

    text = "A red kite is a large bird of prey that lives in the valleys of the west. It was rare for a hundred years and is common again today."
    pages = spark.createDataFrame([(1, "http://birds.net/red-kite", f"<title>Red kite</title><p>{text}</p>"), (2, "http://localhost/x", f"<title>No</title><p>{text * 2}</p>"), (3, "http://birds.net/short", "<p>a red kite</p>")], "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 1, "what is a red kite?"), (1, 2, "tell me more"), (2, 1, "Hello there")], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): (r["mode"], r.reply) for r in answers.answers(turns, pages).collect()}
    assert got[1, 1][0] == "retrieval" and got[1, 1][1].endswith("A red kite is a large bird of prey that lives in the valleys of the west.") and got[1, 2][0] == "continuation" and got[2, 1][0] == "reflect"
    small = {(r.conv_id, r.turn): r["mode"] for r in answers.answers(turns, pages.filter("page_id > 1")).collect()}
    assert small[2, 1] == "eliza"
    one = answers.looked_up(spark, "what is a red kite?", pages, batch=1).first()
    assert one["mode"] == "retrieval" and "A red kite is" in one.reply
