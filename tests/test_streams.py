import datetime

from pyspark.sql import functions as F

from webloom.sources import sinks
from webloom.streaming import guards

START = datetime.datetime(2024, 1, 1)


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drained(df, name, mode="append"):
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_denied_requests_do_not_count(spark, tmp_path):
    seconds = [0, 1, 2, 3, 59, 61, 62, 63, 200]
    rows = [(k, k, "c" if k < 9 else "d", START + datetime.timedelta(seconds=s)) for k, s in enumerate(seconds)]
    requests = stream(spark, str(tmp_path / "in"), [(k, c, t) for k, _, c, t in rows], "event_id long, client string, ts timestamp")
    found = {r["id"]: r["admitted"] for r in drained(guards.admitted(requests, "client", "ts", most=2), "admitted").collect()}
    held, told = [], {}
    for k, s in enumerate(seconds):
        held = [h for h in held if h >= s - 60]
        told[k] = len(held) < 2
        if told[k]:
            held.append(s)
    assert found == told


def test_a_nonce_counts_once(spark, tmp_path):
    rows = [("a", START), ("a", START + datetime.timedelta(seconds=5)), ("b", START)]
    requests = stream(spark, str(tmp_path / "in"), rows, "nonce string, ts timestamp")
    found = drained(guards.first_seen(requests, ["nonce"], "ts"), "nonces")
    assert sorted(r["nonce"] for r in found.collect()) == ["a", "b"]


def test_clock_skew(spark):
    rows = spark.createDataFrame([(START, START + datetime.timedelta(seconds=60)), (START, START + datetime.timedelta(seconds=61))], "sent timestamp, got timestamp")
    assert guards.on_time(rows, "sent", "got").count() == 1


def test_content_store_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>a</p>"), (3, "<p>b</p>")], "page_id long, html string")
    sinks.store_content(pages, str(tmp_path / "store"))
    hashed = pages.select("page_id", F.sha2("html", 256).alias("content_hash"))
    found = sinks.with_content(hashed, str(tmp_path / "store")).orderBy("page_id")
    assert [r["html"] for r in found.collect()] == ["<p>a</p>", "<p>a</p>", "<p>b</p>"]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_audit_lines(spark, tmp_path):
    sinks.append_audit(spark.createDataFrame([(1, "x")], "seq long, id string"), str(tmp_path / "audit"))
    (tmp_path / "audit" / "more.json").write_text('{"seq": 2, "id": "y"}\nnot json\n')
    assert sorted(r["id"] for r in sinks.read_audit(spark, str(tmp_path / "audit"), "seq long, id string").collect()) == ["x", "y"]
