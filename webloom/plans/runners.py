"""Several crawls by turns over what all of them have visited: each from seeds of its own, with a budget of its own, until it learns nothing new."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import frontier, reports
from ..sources.tables import kept
from .crawl import CrawlSpec, crawl


@dataclass(frozen=True)
class Runner:
    """What one crawl does. seeds: from what is visited (url, ...) to the addresses (url) to go on from; keys: to what is known by now (key); budget: pages by number of seeds."""

    name: str
    seeds: Callable[[DataFrame], DataFrame]
    keys: Callable[[DataFrame], DataFrame]
    max_waves: int = 1
    depth: int = 2
    budget: Callable[[int], int] = lambda n: max(1000, n)


@dataclass
class Outcome:
    """What runners came to: visited (url, depth, runner, wave, round), waves by runner, and which of them are saturated."""

    visited: DataFrame
    waves: dict[str, int] = field(default_factory=dict)
    saturated: set[str] = field(default_factory=set)

    @property
    def total_waves(self) -> int:
        return sum(self.waves.values())


def initial_seeds(spark: SparkSession, topic: str, more: list[str] = ()) -> DataFrame:
    """The addresses (url) that a topic's crawl begins with: each region's search, then more; no chrome, each once."""
    first = spark.createDataFrame([(topic,)], "topic string").select(F.explode(reports.regional_seeds(F.col("topic"))).alias("url"))
    rest = spark.createDataFrame([(u,) for u in more], "url string")
    return first.union(rest).filter(~U.is_noise(F.col("url"))).distinct()


def _known(runner: Runner, visited: DataFrame) -> str | None:
    """A fingerprint of the runner's keys; null where there is none."""
    row = frontier.fingerprints(runner.keys(visited).select(F.lit(0).alias("all"), "key"), ["all"]).first()
    return row and row["fingerprint"]


def _wave(runner: Runner, state: Outcome, edges: DataFrame, number: int, given: DataFrame | None = None) -> bool:
    """One wave of a runner that isn't saturated; whether it crawled. It is saturated where no new seed is left, where its keys stay the same, or after its last wave."""
    wave = state.waves.get(runner.name, 0)
    if wave >= runner.max_waves:
        state.saturated.add(runner.name)
        return False
    before = _known(runner, state.visited) if wave else None
    wanted = (given if given is not None else runner.seeds(state.visited)).select("url").distinct()
    fine = wanted.filter(~U.is_noise(F.col("url")) & U.blocked_reason(F.col("url")).isNull())
    seen = state.visited.select(F.lower("url").alias("seen"))
    seeds = kept(fine.join(seen, F.lower("url") == F.col("seen"), "left_anti"))
    n = seeds.count()
    if not n:
        state.saturated.add(runner.name)
        return False
    ahead = edges.join(seen, F.lower("child") == F.col("seen"), "left_anti")
    got = crawl(seeds.sparkSession, seeds.withColumn("priority", F.lit(100)), ahead, CrawlSpec(max_depth=runner.depth, max_pages=runner.budget(n)))
    told = got.select("url", "depth", F.lit(runner.name).alias("runner"), F.lit(wave).alias("wave"), F.lit(number).alias("round"))
    state.visited = kept(state.visited.unionByName(told))
    state.waves[runner.name] = wave + 1
    same = wave > 0 and before == _known(runner, state.visited)
    if same or wave + 1 >= runner.max_waves:
        state.saturated.add(runner.name)
    return True


def run(spark: SparkSession, edges: DataFrame, first: Runner, others: list[Runner], initial: DataFrame) -> Outcome:
    """The first runner from initial seeds (url) until it is saturated, then the others by turns, a wave each, until a round in which none crawls.

    edges: parent, child, priority. No page is visited twice, whichever runner comes first. The driver only counts seeds and compares fingerprints.
    """
    state = Outcome(spark.createDataFrame([], "url string, depth int, runner string, wave int, round int"))
    given: DataFrame | None = initial
    while first.name not in state.saturated:
        _wave(first, state, edges, 0, given)
        given = None
    for number in range(1, max((r.max_waves for r in others), default=0) + 1):
        if not any([_wave(r, state, edges, number) for r in others if r.name not in state.saturated]):
            break
    return state


def waves(state: Outcome) -> DataFrame:
    """(runner, wave, round, n_pages, deepest) of an outcome."""
    return state.visited.groupBy("runner", "wave", "round").agg(F.count(F.lit(1)).alias("n_pages"), F.max("depth").alias("deepest"))


def keys_of(*columns: DataFrame) -> DataFrame:
    """(key) of all values of one-column tables."""
    return reduce(DataFrame.union, (c.toDF("key") for c in columns))
