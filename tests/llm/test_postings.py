import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from webloom.llm import postings, registry, sql

from .data import empty, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, part string, w string, n int"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10, slack=1):
    """Rows (doc_id, n_words, n_hit, items, n_near) by trying every window at every place."""
    often = Counter(w for _, t in docs for w in words(t))
    cut = {("" if i is None else str(i), tuple(w[k : k + size])) for i, t in items if (w := words(t)) for k in range(max(len(w) - size, 0) + 1)}
    out = []
    for doc_id, text in docs:
        w, hit, exact, near = words(text), set(), set(), set()
        for item, win in cut:
            if any(x not in often for x in win):
                continue
            o = min(range(len(win)), key=lambda k: (often[win[k]], win[k].encode(), k))
            for p in (p for p, x in enumerate(w) if x == win[o]):
                s = p - o
                if s >= 0 and tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    exact.add(item)
                if all(x in w[max(s + k - slack, 0) : max(s + k + slack + 1, 0)] for k, x in enumerate(win)):
                    near.add(item)
        out.append((doc_id, len(w), len(hit), sorted(exact), len(near)))
    return Counter(map(repr, out))


def made(spark, docs, items):
    d = frame(spark, [(i, t, None, None, None, "w", "k", 1, "v", "o", "t", "h") for i, t in docs])
    return d, spark.createDataFrame([(i, t, 1, "p", "w", 2) for i, t in items], ITEMS)


def got(df):
    return Counter(repr((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.n_near)) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(7)
    text = lambda n, k: " ".join(r.choice("abcdefghij"[:k]) + r.choice("xyz") for _ in range(n))
    items = [(1, text(14, 4)), (2, text(11, 4)), (3, "ax"), (4, "Ax, ay az"), (4, "bx by"), (5, None), (6, "?!"), (None, "cx cy cz"), (7, "ax ax ax"), (8, text(14, 10)), (9, "gone gone")]
    items.append((10, items[0][1]))
    docs = [(i, text(60, 4)) for i in range(30)]
    docs += [(40, f"{text(20, 10)} {items[0][1]} {text(5, 10)} {items[7][1]}"), (40, "other text bx BY!"), (41, None), (41, None), (42, ""), (None, items[9][1]), (43, "é中文 AX\x85ay"), (44, "ax " * 300)]
    w = items[9][1].split()
    docs += [(45, " ".join([*w[:5], "inserted", *w[5:]])), (46, " ".join([*w[:3], *w[4:]])), (47, " ".join([*w[:4], w[5], w[4], *w[6:]])), docs[30], docs[30]]
    for size, slack in ((10, 1), (3, 0), (4, 2)):
        assert got(postings.contamination(*made(spark, docs, items), size, slack)) == brute(docs, items, size, slack)


def test_odd_rows_and_empty_tables(spark):
    docs = frame(spark)
    items = spark.createDataFrame([(1, "x" * 100_000, 1, "p", "w", 2), (2, "a b c a", 1, "p", "w", 2)], ITEMS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(postings.contamination(docs, items)) == brute(rows, [(1, "x" * 100_000), (2, "a b c a")])
    none = items.limit(0)
    assert {(r.n_hit, r.n_near, tuple(r["items"])) for r in postings.contamination(docs, none).collect()} == {(0, 0, ())}
    assert postings.contamination(empty(spark), items).count() == 0
    with pytest.raises(ValueError):
        postings.contamination(docs, items, size=61)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, sf_dir):
    found = registry.op13_inverted_index(spark, sf_dir)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    told = db.execute(sql.CONTAMINATION)
    columns = [c[0] for c in told.description]
    rows = sorted(told.fetchall(), key=repr)
    assert sorted(found.columns) == sorted(columns)
    assert rows == sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert os.path.basename(sf_dir) == "sf0.001" or sum(r[columns.index("contaminated")] for r in rows) > 5
    assert hashlib.sha256(b"").hexdigest() in {r[columns.index("items_sha256")] for r in rows}


def test_no_python_in_plan(spark, sf):
    df = registry.op13_inverted_index(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
