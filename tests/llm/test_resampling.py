import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from webloom.llm import registry, resampling, sql

from .data import empty, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *runs(t, longest)) for i, t in docs]
    s, t = Counter(bucket(f) for *_, fs in found for f in fs), Counter(bucket(f) for x in target for f in runs(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, n, fs in found:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    chosen = best[: percent * len(best) // 100]
    ranks = {}
    for k, r in enumerate(chosen, 1):
        ranks.setdefault(r, []).append(k)
    return Counter((*r, ranks[r].pop() if ranks.get(r) else None) for r in rows)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("percent, least, buckets, longest", [(10, 20, 10_000, 1), (50, 1, 97, 3), (100, 0, 10, 2), (0, 20, 100, 1)])
def test_against_brute_force(spark, percent, least, buckets, longest):
    docs, target = frame(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, least, buckets, longest)
    assert got(resampling.resample(docs, target, percent, least, buckets, longest)) == want


def test_ties_and_repeated_rows(spark):
    text = "same words again " * 10
    docs = frame(spark, [(i, text, None, None, None, "w", "k", 1, "v", "o", "t", "h") for i in [None] * 5 + [3] * 40 + list(range(60))])
    target = spark.createDataFrame([("same",), (None,)], "text string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ["same", None], 37)
    assert got(resampling.resample(docs, target, 37)) == want


def test_empty_tables(spark, sf):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert resampling.resample(empty(spark), target).count() == 0
    want = brute([(r.doc_id, r.text) for r in frame(spark).collect()], [])
    assert got(resampling.resample(frame(spark), target.limit(0))) == want


def test_long_texts_are_cut_between_words():
    f = resampling.Features(1000, 1)
    text = "été de0 x\x00" * 5000 + "y" * 50_000 + " é" * 3
    assert list(f.words(text)) == WORD.findall(text)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf_dir):
    found = registry.op12_resampling(spark, sf_dir)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    told = db.execute(sql.RESAMPLING)
    columns = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(told.fetchall(), key=repr) == sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
