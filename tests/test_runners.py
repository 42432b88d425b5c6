from pyspark.sql import functions as F

from webloom.plans import runners


def plain(edges, first, others, initial):
    """The same by sets: (url, runner, wave, round) and the waves of each."""
    seen, waves, done, out = set(), {}, set(), set()

    def wave(r, number, given=None):
        n = waves.get(r["name"], 0)
        if n >= r["max"]:
            done.add(r["name"])
            return False
        before = {x for x in seen if x in r["keys"]}
        seeds = [u for u in (given if given is not None else r["seeds"](seen)) if u not in seen]
        if not seeds:
            done.add(r["name"])
            return False
        level, got = set(seeds), set()
        for _ in range(r["depth"] + 1):
            got |= level
            level = {b for a, b in edges if a in level} - got - seen
        out.update((u, r["name"], n, number) for u in got)
        seen.update(got)
        waves[r["name"]] = n + 1
        if n and before == {x for x in seen if x in r["keys"]} or n + 1 >= r["max"]:
            done.add(r["name"])
        return True

    given = initial
    while first["name"] not in done:
        wave(first, 0, given)
        given = None
    for number in range(1, max(r["max"] for r in others) + 1):
        if not any([wave(r, number) for r in others if r["name"] not in done]):
            break
    return out, waves, done


def test_runners_equal_sets(spark):
    url = "http://h.net/{}".format
    edges = [(url(i), url(j)) for i in range(60) for j in ((i * 7 + 3) % 60, (i * i + 1) % 60)]
    every = [url(i) for i in range(60)]
    specs = [("a", 3, 1, 2, every), ("b", 4, 0, 1, every[:5]), ("c", 2, 2, 50, every)]
    plain_ones = [{"name": n, "max": m, "depth": d, "keys": set(k), "seeds": lambda seen, c=c: sorted(set(every) - seen)[:c]} for n, m, d, c, k in specs]
    pages = spark.createDataFrame([(u,) for u in every], "url string")
    seeds = lambda c: lambda visited: pages.join(visited.select("url"), "url", "left_anti").orderBy("url").limit(c)
    keys = lambda k: lambda visited: visited.filter(F.col("url").isin(k)).select(F.col("url").alias("key"))
    real = [runners.Runner(n, seeds(c), keys(k), m, d) for n, m, d, c, k in specs]
    graph = {"name": "graph", "max": 1, "depth": 1, "keys": set(), "seeds": lambda seen: []}
    want = plain(edges, graph, plain_ones, [url(0), url(1)])
    initial = spark.createDataFrame([(url(0),), (url(1),), ("http://localhost/x",), ("https://github.com/features",)], "url string")
    got = runners.run(spark, spark.createDataFrame([(a, b, 50) for a, b in edges], "parent string, child string, priority int"), runners.Runner("graph", seeds(0), keys([]), 1, 1), real, initial)
    assert {(r.url, r.runner, r.wave, r["round"]) for r in got.visited.collect()} == want[0]
    assert got.waves == want[1] and got.saturated == want[2] and got.total_waves == sum(want[1].values())


def test_initial_seeds(spark):
    seeds = {r.url for r in runners.initial_seeds(spark, "red kite", ["http://a.net/", "https://github.com/features/x", "http://a.net/"]).collect()}
    assert "http://a.net/" in seeds and len(seeds) == 11 and "https://en.wikipedia.org/wiki/Special:Search?search=red%20kite&fulltext=1" in seeds
