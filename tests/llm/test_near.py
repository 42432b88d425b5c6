import random
from collections import Counter

import numpy as np

from webloom.llm import near

from .data import SCHEMA, empty, frame, sentence


def brute_similarity(a, b):
    def weights(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    x, y = weights(a), weights(b)
    every = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in set(x) & set(y))


def test_similarity_is_probability_jaccard():
    s, r = near.Shingles(), random.Random(2)
    for k in range(30):
        a = [r.choice("abcd") for _ in range(60)]
        b = list(a)
        for _ in range(k % 7):
            b[r.randrange(60)] = r.choice("abcdx")
        a, b = " ".join(a), " ".join(b)
        assert abs(near.similarity(s(a), s(b)) - brute_similarity(a, b)) < 1e-9


def test_registers_estimate_it():
    s = near.Shingles()
    a = sentence(5, 400)
    w = a.split()
    b = " ".join(w[:300] + sentence(6, 100).split())
    sig = near.signatures([s(a), s(b), s("one two three")], 4000)
    assert abs((sig[0] == sig[1]).mean() - near.similarity(s(a), s(b))) < 0.04
    assert (sig[2] == sig[2][0]).all()


def edited(words, r, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_classes_are_components(spark):
    r = random.Random(7)
    texts = []
    for g in range(12):
        base = sentence(100 + g, 200).split()
        texts += [edited(base, r, r.choice((0, 1, 2, 4, 6, 9, 30))) for _ in range(r.choice((1, 2, 5, 40)))]
    r.shuffle(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = near.Shingles()
    sets = [s(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if near.similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for settings in ({}, {"large": 1, "rare": 3}):
        got = {x.doc_id: x.class_id for x in near.classes(docs, **settings).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def test_odd_rows(spark):
    docs = frame(spark)
    got = sorted(((x.doc_id, x.class_id) for x in near.classes(docs).select("doc_id", "class_id").collect()), key=str)
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), *((i, i) for i in range(5, 14)), (None, None)]
    assert got == sorted(want, key=str)
    kept = near.representatives(docs)
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted([x.doc_id for x in kept.collect()], key=str) == sorted([1, 4, *range(5, 14), None], key=str)
    assert near.classes(empty(spark)).count() == 0 and near.representatives(empty(spark)).count() == 0
    twin = [(i, "a b c d e f g", None, None, 1, *"wk", 1, *"voth") for i in (None, None)]
    assert near.representatives(spark.createDataFrame(twin, SCHEMA)).count() == 1


def test_band_keys_differ_by_band():
    keys = near.band_keys(np.zeros((1, 20), np.uint64), 4)
    assert len(set(keys[0].tolist())) == 4


def test_one_row_of_each_class_with_null_and_shared_ids(spark):
    base = sentence(1)
    near_copy = base.replace(base.split()[50], "changed", 1)
    texts = [(None, base), (None, near_copy), (None, sentence(2)), (7, sentence(3)), (7, sentence(4)), (None, None), (None, "")]
    for repeat in ([], [(8, sentence(5))] * 2):
        rows = [(i, t, None, None, 1, *"wk", 1, *"voth") for i, t in texts + repeat]
        kept = [(r.doc_id, r.text) for r in near.representatives(spark.createDataFrame(rows, SCHEMA)).collect()]
        first = next(t for i, t in kept if t in (base, near_copy))
        assert sorted(kept, key=str) == sorted([(None, first), *texts[2:], *repeat[:1]], key=str)
