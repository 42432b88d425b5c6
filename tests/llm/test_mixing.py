from collections import defaultdict

from webloom.llm import mixing

from .data import empty, frame


def test_raked_cells_meet_goals(spark):
    cells = spark.createDataFrame([("a", "x", "p", 800), ("a", "y", "p", 100), ("b", "x", "p", 50), ("b", "y", "q", 50), ("b", "y", "p", 0)], "source string, lang string, topic string, tokens long")
    goal = lambda side, **x: spark.createDataFrame(list(x.items()), f"{side} string, goal double")
    goals = {"source": goal("source", a=0.5, b=0.5, none=0.0), "lang": goal("lang", x=0.6, y=0.4), "topic": goal("topic", p=0.9, q=0.1)}
    got = mixing.rake(cells, goals, rounds=40).collect()
    sums = defaultdict(float)
    for r in got:
        for side in mixing.SIDES:
            sums[side, r[side]] += r.weight
    want = {("source", "a"): 0.5, ("source", "b"): 0.5, ("lang", "x"): 0.6, ("lang", "y"): 0.4, ("topic", "p"): 0.9, ("topic", "q"): 0.1}
    assert all(abs(sums[k] - v) < 1e-3 for k, v in want.items())
    assert mixing.away(mixing.rake(cells, goals), goals) <= 1e-4
    fitted = mixing.calibrated(mixing.rake(cells, goals), share=0.3).collect()
    assert all(0 < r.probability <= 1 for r in fitted) and abs(sum(r.tokens * r.probability for r in fitted) - 300) < 0.1
    assert [r.probability for r in fitted if (r.source, r.lang, r.topic) == ("b", "y", "p")] == [1]
    assert {r.source: round(r.weight, 3) for r in mixing.report(mixing.calibrated(mixing.rake(cells, goals)), "source").collect()} == {"a": 0.5, "b": 0.5}


def test_stated_targets(spark):
    cells = spark.createDataFrame([("a", "x", "p", 800), ("b", "y", "p", 100), ("c", "z", "p", 300)], "source string, lang string, topic string, tokens long")
    goal = lambda **w: {r.lang: round(r.goal, 9) for r in mixing.stated(cells, "lang", w).collect()}
    assert goal(x=0.4, none=0.2) == {"x": 0.4, "y": 0.15, "z": 0.45}
    assert goal(x=0.2, y=0.2, z=0.4) == {"x": 0.25, "y": 0.25, "z": 0.5}


def test_a_stray_row_does_not_shrink_the_sample(spark):
    rows = [("hot", "x", "p", 1_000_000), ("stray", "x", "p", 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    fitted = {r.source: r.probability for r in mixing.fit(cells, power={"source": 0.5}, share=0.9).collect()}
    assert fitted["stray"] == 1 and abs(fitted["hot"] - 0.9) < 1e-3


def test_matches_plain_fitting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs, rounds=8, tolerance=0.0, share=0.6).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.source, r.lang, r.topic] += r.tokens
    weight = {c: t / sum(tokens.values()) for c, t in tokens.items()}
    goals = []
    for side in range(3):
        s = defaultdict(int)
        for c, t in tokens.items():
            s[c[side]] += t
        s = {k: v**0.9 for k, v in s.items() if v}
        goals.append({k: v / sum(s.values()) for k, v in s.items()})
    for _ in range(8):
        for side in range(3):
            s = defaultdict(float)
            for c, w in weight.items():
                s[c[side]] += w
            weight = {c: w * (goals[side].get(c[side], 0) / s[c[side]] if s[c[side]] else 0) for c, w in weight.items()}
    rate = {c: weight[c] / t for c, t in tokens.items() if t}
    all_tokens, low, high = sum(tokens.values()), 0.0, 1 / min(rate.values())
    for _ in range(200):
        scale = (low + high) / 2
        low, high = (low, scale) if sum(t * min(1, rate[c] * scale) for c, t in tokens.items() if t) >= 0.6 * all_tokens else (scale, high)
    assert len(got) == docs.count()
    for r in got:
        c = r.source, r.lang, r.topic
        assert abs(r.probability - (min(1, rate[c] * high) if c in rate else 1)) < 1e-5
    kept = sum(r.sampled for r in got) / len(got)
    assert abs(kept - sum(r.probability for r in got) / len(got)) < 0.05


def test_odd_rows(spark):
    docs = frame(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count() and got.filter("probability is null or sampled is null").count() == 0
    assert got.select("doc_id", "sampled").distinct().count() == docs.select("doc_id").distinct().count()
    kept = mixing.sample(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got.filter("sampled").collect())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0
