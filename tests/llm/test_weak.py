import random
import re
from collections import Counter

from pyspark.sql import functions as F

from webloom.llm import registry, weak

from .data import empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in weak.base(docs).collect())
    assert got == want


def test_long_texts_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(weak, "_POSITIONS", 4)
    docs = frame(spark).filter("doc_id in (1, 2, 3, 4, 13, 11)")
    want = Counter((r.doc_id, brute(r.text)[4]) for r in docs.collect())
    assert Counter((r.doc_id, r.n_repeat_words) for r in weak.base(docs).collect()) == want


def test_hashes_that_share_their_upper_bits(spark, monkeypatch):
    monkeypatch.setattr(weak, "_POSITIONS", 60)  # four bits of a hash are left
    r = random.Random(5)
    docs = frame(spark).filter("doc_id in (1, 2, 3, 4, 13, 11)").select("doc_id", "text").union(spark.createDataFrame([(100 + i, " ".join(r.choice("abcdef") for _ in range(120))) for i in range(20)], "doc_id long, text string"))
    want = Counter((r.doc_id, brute(r.text)[4]) for r in docs.collect())
    assert Counter((r.doc_id, r.n_repeat_words) for r in weak.base(docs).collect()) == want


def test_expectation_maximisation_finds_accuracies():
    # two honest rules and one that votes against everything a tenth of the time
    patterns = [((1, 1, None), 700), ((0, 0, None), 180), ((1, 1, 0), 80), ((0, 0, 0), 20), ((None, None, None), 20)]
    prior, table, post = weak.expect(patterns)
    assert 0.7 < prior < 0.9 and post[(1, 1, 0)] > 0.9 > 0.1 > post[(0, 0, None)]
    assert table[0][0][0] > 0.9 and table[0][1][1] > 0.9
    assert weak.expect([])[2] == {}


def test_query_keeps_good_documents(spark):
    got = registry.op4_weak_supervision(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = {(r.quality, r.kept): r["count"] for r in got.filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert table.get((1, False), 0) <= 0.02 * table[(1, True)] and table.get((0, True), 0) <= 0.2 * table[(0, False)]


def test_empty(spark):
    judged = weak.judge(weak.base(empty(spark)), weak.rules())
    assert judged.count() == 0 and "kept" in judged.columns


def test_no_python_in_plan(spark, sf):
    plan = weak.base(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("x", F.lit(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_posteriors(votes, rounds=500):
    """Expectation-maximisation document by document: votes is a list of rows."""
    k, n, prior = len(votes[0]), len(votes), 0.8
    chance = {(y, r, v): c for y, side in ((1, weak._GOOD), (0, weak._BAD)) for r in range(k) for v, c in ((1, side[0] / 10), (0, side[1] / 10))}
    for _ in range(rounds):
        post = []
        for row in votes:
            like = {1: prior, 0: 1 - prior}
            for y in (0, 1):
                for r, v in enumerate(row):
                    like[y] *= 1 if v is None else chance[y, r, v]
            post.append(like[1] / (like[0] + like[1]))
        prior = min(0.999, max(0.001, (sum(post) + 8) / (n + 10)))
        for r in range(k):
            for y, side in ((1, weak._GOOD), (0, weak._BAD)):
                p = [x if y else 1 - x for x in post]
                for v in (1, 0):
                    chance[y, r, v] = (side[1 - v] + sum(x for x, row in zip(p, votes) if row[r] == v)) / (sum(p) + sum(side))
            chance[1, r, 0] = min(chance[1, r, 0], chance[0, r, 0])
            chance[0, r, 1] = min(chance[0, r, 1], chance[1, r, 1])
    return prior, post


def test_posteriors_against_plain_fitting(spark):
    features = weak.base(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    judged = weak.judge(features, weak.rules())
    rows = judged.select(*(v.alias(n) for n, v in weak.rules().items()), "posterior", "kept", "base_failed").collect()
    prior, want = plain_posteriors([tuple(r[n] for n in weak.rules()) for r in rows], rounds=200)
    assert all(abs(r.posterior - p) < 1e-6 and r.kept == (not r.base_failed and r.posterior >= 0.5) for r, p in zip(rows, want))


def test_abstaining_is_no_evidence():
    patterns = [((1, 1, None), 700), ((0, 0, None), 180), ((None, None, None), 120), ((1, None, None), 50)]
    prior, _, post = weak.expect(patterns)
    assert abs(post[(None, None, None)] - prior) < 1e-6 and post[(1, None, None)] > prior
