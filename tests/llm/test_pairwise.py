import numpy as np

from webloom.llm import pairwise, registry

from .data import empty, frame


def test_learns_held_out_labels(spark):
    got = registry.op2_pairwise_quality(spark, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in got.collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_preferences_order_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, pairwise.BUCKETS + pairwise.SURFACE))
    y = (x[:, 3] > 0).astype(int)
    model = pairwise.fit(x, y)
    assert np.mean((model.score(x) >= 0.3) == y) > 0.95
    assert 0 < model.quantile < 1 and abs(model.score(x)[np.argsort(model.raw(x))] - np.sort(model.score(x))).max() < 1e-12


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    docs = frame(spark)
    model = pairwise.train(docs, labels)
    got = pairwise.score(docs, model)
    assert got.count() == docs.count() and got.filter("score is null or isnan(score)").count() == 0
    assert pairwise.score(empty(spark), model).count() == 0
    none = pairwise.train(docs, labels.limit(0))
    assert {r.score for r in pairwise.score(docs, none).collect()} == {0.5}
    assert {r.score for r in pairwise.score(docs, pairwise.train(docs, labels.filter("quality = 1"))).collect()} == {0.5}


def test_texts_of_other_white_space(spark):
    texts = [" ", "\u0085", "　　", " \n\u0085 　", "\x1c"]
    assert all(np.isfinite(pairwise.surface(t)).all() and pairwise.surface(t)[0] > 0 for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = pairwise.score(docs, pairwise.train(docs, labels)).collect()
    assert len(got) == 5 and all(np.isfinite(r.score) for r in got)


def test_texts_of_one_labelled_id(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = [(1, "good words here"), (1, "other words"), (1, None), (2, "bad %%% words")]
    fits = [pairwise.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels).w for x, n in ((rows, 1), (rows[::-1], 4))]
    assert (fits[0] == fits[1]).all()


def test_loss_is_near_its_least():
    # against plain gradient descent over every pair
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=60) > 0).astype(int)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = (x[good][:, None] - x[bad][None]).reshape(-1, 4)
    loss = lambda w: np.log1p(np.exp(-pairs @ w)).mean() + 5e-4 * w @ w
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.5 * (-(1 / (1 + np.exp(pairs @ w))) @ pairs / len(pairs) + 1e-3 * w)
    mine = pairwise._descend(x, good, bad, rounds=2000, rate=0.3)
    assert loss(mine) < loss(w) + 0.01 and loss(w) <= loss(mine) + 1e-9


def test_cut_is_the_best_quantile():
    rng = np.random.default_rng(5)
    for _ in range(20):
        y = rng.integers(0, 2, 30)
        y[:2] = 0, 1
        s = np.round(rng.normal(size=30) + y, 1)
        balanced = lambda c: np.mean(s[y == 1] >= c) + np.mean(s[y == 0] < c)
        quantile, cut = pairwise._cut(s, y)
        assert abs(balanced(cut) - max(balanced(c) for c in np.unique(s)[1:])) < 1e-12 and abs(np.mean(s < cut) - quantile) < 1e-12
