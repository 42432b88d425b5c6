import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import social
from webloom.functions import urls as U
from webloom.operators import entities, frontier, gates, ordered, profiles
from webloom.sources import archive, sinks
from webloom.streaming import guards

from .test_streams import drained


@pytest.mark.parametrize("key", [b"", b"short", b"k" * 64, b"long" * 40])
def test_keyed_hash(spark, key):
    texts = ["", "a|b|c", "é中🙂", "x" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gates.mac(key, F.col("t")).alias("m")).collect()
    assert all(r.m == hmac.new(key, r.t.encode(), hashlib.sha256).hexdigest() for r in rows)


def chain(n):
    return [(i, f"e{i}", f"2024-01-01 00:00:{i % 60:02}", "view", None if i % 5 == 0 else f"d{i}") for i in range(n)]


def test_chain_and_its_faults(spark):
    entries = spark.createDataFrame(chain(200), "seq long, id string, at string, kind string, detail string").repartition(5)
    signed = gates.chained(entries, b"key", "seq")
    rows = {r.seq: r for r in signed.collect()}
    assert rows[0].prev == "" and all(rows[i].prev == f"e{i - 1}" for i in range(1, 200))
    assert rows[7].mac == hmac.new(b"key", b"e7|2024-01-01 00:00:07|view|e6|d7", hashlib.sha256).hexdigest()
    assert rows[0].mac == hmac.new(b"key", b"e0|2024-01-01 00:00:00|view|GENESIS|", hashlib.sha256).hexdigest()
    assert gates.chain_faults(signed, b"key", "seq").count() == 0 and gates.vital(gates.chain_faults(signed, b"key", "seq"), False, "seq").first().vital
    hurt = signed.filter("seq <> 50").withColumn("detail", F.when(F.col("seq") == 120, "forged").otherwise(F.col("detail")))
    faults = gates.chain_faults(hurt, b"key", "seq")
    assert {(r.seq, r.fault) for r in faults.collect()} == {(51, "link"), (120, "mac")}
    told = gates.vital(faults, False, "seq").first()
    assert not told.vital and told.reason == "e51 link" and gates.vital(faults, True, "seq").first().vital
    assert {r.fault for r in gates.chain_faults(signed, b"other", "seq").collect()} == {"mac"}


def test_stream_of_entries_equals_the_batch(spark, tmp_path):
    schema = "seq long, id string, at string, kind string, detail string"
    entries = spark.createDataFrame(chain(60), schema).withColumn("chain", F.lit("c"))
    for part in range(3):
        entries.filter(f"seq div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.id: (r.prev, r["mac"]) for r in drained(guards.chained(source, b"key"), "entries").collect()}
    assert got == {r.id: (r.prev, r["mac"]) for r in gates.chained(entries, b"key", "seq").collect()}


def plainly(requests, per_window, at_once, window):
    out, times, ends = {}, [], []
    for k, at, until in sorted(requests, key=lambda r: (r[1], r[0])):
        times, ends = [t for t in times if t >= at - window], [e for e in ends if e > at]
        out[k] = len(times) < per_window and len(ends) < at_once
        if out[k]:
            times.append(at)
            ends.append(until)
    return out


@pytest.mark.parametrize("seed, spread", [(1, 300), (2, 4000), (3, 30_000)])
def test_limiter(spark, seed, spread):
    r = random.Random(seed)
    requests = [(i, float(r.randrange(spread)), 0.0) for i in range(400)]
    requests = [(i, at, at + r.choice([0, 5, 50, 200])) for i, at, _ in requests]
    df = spark.createDataFrame(requests, "id long, at double, until double").repartition(7)
    assert {x.id: x.admitted for x in gates.admitted(df, 5, 3).collect()} == plainly(requests, 5, 3, 60)


def test_before_over_partitions(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(500)], "i long, v long").repartition(9)
    got = {r.i: (r.last, r.top) for r in ordered.before(ordered.before(ordered.in_order(rows, "i"), "last", F.col("v")), "top", F.col("v"), greatest=True).collect()}
    v = [(i * 7919) % 1000 for i in range(500)]
    assert got == {i: (v[i - 1] if i else None, max(v[:i]) if i else None) for i in range(500)}


def test_fingerprints(spark):
    rows = [("a", k) for k in ("x", " Y ", "x", "")] + [("b", k) for k in ("y", "X")] + [("c", "x")] + [("d", "xy")]
    got = {r.who: (r.n_keys, r.fingerprint) for r in frontier.fingerprints(spark.createDataFrame(rows, "who string, key string"), ["who"]).collect()}
    assert got["a"] == got["b"] and len({got[k] for k in "acd"}) == 3


def test_robots_take_the_longest_rule(spark):
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/q", False), ("h", "/q", True), ("h", "/a.b[", False)], "host string, prefix string, allow boolean")
    urls = spark.createDataFrame([("1", "h", "/a/b/c"), ("2", "h", "/a/c"), ("3", "g", "/"), ("4", "h", "/z"), ("5", "h", "/q"), ("6", "h", "/a.b[x")], "url string, host string, path string")
    assert {r.url: r.allowed for r in gates.robots_allowed(urls, rules).collect()} == {"1": True, "2": False, "3": True, "4": True, "5": True, "6": False}


def test_links_of_any_form(spark):
    base = "https://Host.net:443/a/b/c.html?x=1"
    forms = {
        "../d": "https://host.net/a/d", "./e/./f": "https://host.net/a/b/e/f", "../../../../g": "https://host.net/g", "/h/../i/": "https://host.net/i", ".": "https://host.net/a/b", "..": "https://host.net/a",
        "?y": "https://host.net/a/b/c.html?y", "//O.net/p/..": "https://o.net/", "q/%2E%2e/r": "https://host.net/a/b/r", "é x": "https://host.net/a/b/%C3%A9%20x", "http://u.net:80": "http://u.net/", "#z": None, "tel:1": None,
        "ftp://x/": None, "": None, "https://v.net/a.b/..c/...": "https://v.net/a.b/..c/...",
    }
    rows = spark.createDataFrame([(f,) for f in forms], "l string").select("l", U.resolved(F.lit(base), F.col("l")).alias("t")).collect()
    assert {r.l: r.t for r in rows} == forms
    assert spark.range(1).select(archive.archive_url("https://web.net/web", F.lit("2024"), F.lit("http://a/"))).first()[0] == "https://web.net/web/2024/http://a/"


def test_instances_and_two_letter_fields(spark):
    urls = ["https://fosstodon.social/@Bob", "https://mastodon.social/@bob", "https://www.linkedin.com/in/Jane", "https://instagram.com/pat", "https://none.net/@x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(social.profile_url(F.col("u")).alias("p")).collect()
    assert [r.p for r in rows] == ["https://fosstodon.social/@bob", "https://mastodon.social/@bob", "https://linkedin.com/in/jane", None, None]
    texts = ["the air aimed aid", "AI here", "use ml now", "html", "LLMs", "call\t(415)\n555 0199 now"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(entities.domains(F.col("t")).alias("d"), entities.phones(F.col("t")).alias("p")).collect()
    assert [len(r.d) for r in rows] == [0, 1, 1, 0, 1, 0] and rows[5].p == ["(415)\n555 0199"]


def test_profiles_merge(spark):
    found = spark.createDataFrame([("https://x.com/Ann", "p1", 0.4), ("https://twitter.com/ann/", "p2", 0.7), ("https://x.com/Ann", "p1", 0.5), ("https://nowhere.net/ann", "p3", 0.9)], "url string, source string, confidence double")
    pages = spark.createDataFrame([(1, "https://x.com/ANN", "Old", "bio", None), (2, "https://x.com/ann", "New", None, "http://a/i.png"), (3, "https://github.com/bob", None, "b", None)], "page_id long, url string, display string, bio string, avatar string")
    got = {r.profile_url: r for r in profiles.updated(profiles.discovered(found), pages).collect()}
    ann, bob = got["https://x.com/ann"], got["https://github.com/bob"]
    assert (ann.platform, ann.confidence, ann.sources, ann.display, ann.bio, ann.avatar) == ("twitter", 0.7, ["p1", "p2"], "New", "bio", "http://a/i.png") and len(got) == 2
    assert (bob.confidence, bob.sources, bob.display, bob.bio, bob.username) == (0.55, ["https://github.com/bob"], None, "b", "bob")
    posts = spark.createDataFrame([(1, "x", "l", "a" * 80 + "1"), (2, "x", "l", "a" * 80 + "2"), (3, "x", "m", "a" * 80)], "seq long, platform string, link string, text string")
    assert {r.seq for r in profiles.posts_once(posts).collect()} == {1, 3}


def test_reports_are_written_as_lines(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(1, "x")], "n long, line string"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"n":1,"line":"x"}']


def test_only_the_first_of_a_time_enter_the_sequence(spark, monkeypatch):
    """A hundred requests a second: 5 of each may be admitted, so no more of them are put in one order."""
    requests = [(i, float(i // 100), float(i // 100 + i % 3)) for i in range(3000)]
    df = spark.createDataFrame(requests, "id long, at double, until double")
    seen, in_order = [], gates.ordered.in_order
    monkeypatch.setattr(gates.ordered, "in_order", lambda rows, *order: seen.append(rows.count()) or in_order(rows, *order))
    got = {x.id: x.admitted for x in gates.admitted(df, 5, 3, 4.0).collect()}
    assert seen == [150] and got == plainly(requests, 5, 3, 4)
