import numpy as np

from webloom.llm import language, registry

from .data import empty, frame


def test_held_out_languages(spark):
    got = registry.op7_language_mixture(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    one = {r.lang: r.text for r in docs.filter("n_chars between 1500 and 4000 and doc_id > 900").collect()}
    grams = language.Trigrams(model.buckets, letters_only=True)
    shares = model.proportions(grams.counts(one["en"][:1400] + " " + one["fr"][:600]))
    assert set(shares) == {"en", "fr"} and 0.55 < shares["en"] < 0.85
    assert set(model.proportions(grams.counts(one["de"]))) == {"de"}


def test_counts_do_not_depend_on_slices(monkeypatch):
    from webloom.llm import ngrams

    text = "Straße und Öl, 12 " * 50
    whole = ngrams.Trigrams(512, letters_only=True).counts(text)
    monkeypatch.setattr(ngrams, "_SLICE", 7)
    assert (ngrams.Trigrams(512, letters_only=True).counts(text) == whole).all()


def test_odd_rows(spark):
    docs = frame(spark)
    model = language.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs.selectExpr("doc_id", "false held_out", "text"), model).collect()}
    assert {(5, "und"), (6, "und"), (7, "und"), (8, "und"), (9, "xx")} <= got
    kept = language.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4 and kept.filter("lang is null").count() == 0
    nothing = language.fit(empty(spark))
    assert {r.lang_pred for r in language.predict(docs.selectExpr("doc_id", "false held_out", "text"), nothing).collect()} == {"und"}
    assert language.identified(empty(spark), model).count() == 0


def test_shares_maximise_the_likelihood():
    # against all mixtures of a fine grid
    rng = np.random.default_rng(2)
    rows = [(name, b, int(n)) for name in ("a", "b", "c") for b, n in enumerate(rng.integers(1, 60, 40))]
    table = language.pa.table({"lang": [r[0] for r in rows], "bucket": [r[1] for r in rows], "n": [r[2] for r in rows]})
    model = language.Mixture(table, 40, penalty=0.0, rounds=5000, nearness=1e-7)
    for mix in ((0.7, 0.3, 0.0), (0.2, 0.3, 0.5), (1.0, 0.0, 0.0)):
        counts = rng.multinomial(4000, np.array(mix) @ model.p)
        likelihood = lambda w: counts @ np.log(np.array(w) @ model.p)
        grid = [(i / 50, j / 50, 1 - i / 50 - j / 50) for i in range(51) for j in range(51 - i)]
        best = max(grid, key=likelihood)
        found, full = model.inferred(counts)
        assert max(abs(found.get(n, 0) - w) for n, w in zip("abc", best)) < 0.05
        assert max(abs(full[n] - w) for n, w in zip("abc", best)) < 0.05


def test_score_tells_how_sure_a_prediction_is(spark):
    got = [r.score for r in registry.op7_language_mixture(spark, "/root/testdata/sf0.001").collect()]
    assert len({round(s, 6) for s in got}) > len(got) / 2


def test_labels_beyond_a_models_size(spark):
    texts = [("a", "some words of the first language " * 9), ("b", "altri vocaboli della seconda lingua " * 9), *((f"stray{i}", "zz") for i in range(3)), ("c", "noch mehr Worte der dritten Sprache " * 9)]
    model = language.fit(spark.createDataFrame(texts, "lang string, text string"), most_languages=3)
    assert model.names == ["a", "b", "c"] and model.left_out == 3
    docs = spark.createDataFrame([(1, True, "vocaboli della lingua"), (2, True, "zz")], "doc_id long, held_out boolean, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}[1] == "b"
    assert language.fit(spark.createDataFrame(texts, "lang string, text string")).left_out == 0
