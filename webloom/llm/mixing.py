"""Samples documents so that tokens meet target shares of source, language and topic. DataFrame functions only.

Tokens are summed by cell (source, lang, topic); iterative proportional fitting rakes the cells to one marginal after
the other until no marginal is further than a tolerance from its goal. A topic is what a Column tells; where none is given, it
is a text's form (table, markup, data, list, prose), for nothing else about the topic is known without a model.

A document's probability is its cell's raked weight over its tokens, times a scale. The scale is that at which the expected tokens of
the sample are the stated `share` of all; a cell whose rate would pass 1 is kept whole and the others make up for it, so a
cell of a few tokens that its goals favour does not shrink the sample. The document stays if a hash of its id falls below its probability.
Cells never pass through the driver: each step is a grouping that combines on the map side and a join on the marginal's key.

Nulls in source, lang or text are values of their own ('(null)'; the empty text). Cells without tokens keep all their
documents. Repeated rows share the fate of their id, as do rows whose ids are null; ties in probability have no effect. Very long
texts count with all their words. An empty table gives no rows. sample() returns all columns of docs, whatever their names;
mix() reads only id, text, source and lang.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, stored, whole

NULL = "(null)"
SIDES = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic of form: table (bars), data (digits), list (short lines) or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    return F.when(share("|") > 0.02, "table").when(share("#*$%&<>") > 0.02, "markup").when(share("0123456789") > 0.05, "data").when(share("\n") > 0.02, "list").otherwise("prose")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) and what keep names; tokens are words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    return docs.select(F.col(id_col).alias("doc_id"), key("source").alias("source"), key("lang").alias("lang"), (topic_of(text) if topic is None else topic).alias("topic"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), *keep)


def tempered(cells: DataFrame, side: str, power: float) -> DataFrame:
    """(side, goal): shares of tokens raised to power, in all 1. power 1 keeps the shares, 0 makes them equal."""
    sums = cells.filter("tokens > 0").groupBy(side).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("x"))
    total = sums.agg(F.sum("x")).first()[0]
    return stored(sums.select(side, (F.col("x") / F.lit(total)).alias("goal")), "goals")


def stated(cells: DataFrame, side: str, weights: dict[str, float]) -> DataFrame:
    """(side, goal) with the stated shares for the values that weights names and cells have; all others share what is left of 1 by their tokens."""
    sums = cells.filter("tokens > 0").groupBy(side).agg(F.sum("tokens").alias("x"))
    named = F.lit(None).cast("double")
    for value, weight in weights.items():
        named = F.when(F.col(side) == value, float(weight)).otherwise(named)
    sums = stored(sums.withColumn("goal", named), "goals")
    given, others = sums.agg(F.coalesce(F.sum("goal"), F.lit(0.0)), F.sum(F.when(F.col("goal").isNull(), F.col("x")))).first()
    if given > 1:
        raise ValueError(f"the weights of {side} exceed 1")
    # without other values the named ones share all
    scale = 1.0 if others else 1.0 / (given or 1.0)
    return stored(sums.select(side, F.coalesce(F.col("goal") * scale, F.col("x") / F.lit(float(others or 1)) * (1 - given)).alias("goal")), "goals")


def away(cells: DataFrame, goals: dict[str, DataFrame]) -> float:
    """How far the worst marginal of cells is from its goal, of the goals that have cells."""
    worst = [0.0]
    for side, goal in goals.items():
        sums = cells.groupBy(side).agg(F.sum("weight").alias("sum")).join(goal, side)
        worst.append(sums.agg(F.max(F.abs(F.col("sum") - F.col("goal")))).first()[0] or 0.0)
    return max(worst)


def rake(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: raked to goals (side, goal), one side after another, until all are
    within tolerance or a round brings them less than a hundredth nearer; at most rounds times. away() tells what is left.

    A value of a side that has no goal gets weight zero; goals without cells have no effect.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0]
    now, left = cells.withColumn("weight", F.col("tokens") / F.lit(total or 1.0)), math.inf
    for _ in range(rounds):
        for side in goals:
            sums = now.groupBy(side).agg(F.sum("weight").alias("sum"))
            factor = sums.join(goals[side], side).select(side, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
            before, now = now, now.join(factor, side, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
            now = stored(now, "rake")  # each step reads the table twice, so plans that span steps would double with each
            discard(before)
        was, left = left, away(now, goals)
        if left <= tolerance or left > 0.99 * was:
            break
    return now


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def calibrated(cells: DataFrame, share: float = 0.5, steps: int = 64, rounds: int = 4) -> DataFrame:
    """cells with probability: min(1, scale x weight / tokens), with the scale at which the tokens expected to stay are `share` of all; 1 where there are no tokens."""
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    total, weight, least = cells.agg(F.sum("tokens").cast("double"), F.sum("weight"), F.min(F.when(rate > 0, rate))).first()
    low = high = 1.0
    if weight:
        # expected tokens grow with the scale, and are at most scale x weight
        low = share * total / weight
        high = max(low, 1 / least)
        for _ in range(rounds):
            scales = [low * (high / low) ** (i / steps) for i in range(steps + 1)]
            expected = cells.agg(*(F.sum(F.col("tokens") * F.coalesce(F.least(F.lit(1.0), rate * s), F.lit(0.0))) for s in scales)).first()
            at = next((i for i, x in enumerate(expected) if x >= share * total), steps)
            low, high = scales[max(0, at - 1)], scales[at]
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), rate * F.lit(high)), F.lit(1.0)))


def fit(rows: DataFrame, power: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, goals: dict[str, DataFrame] | None = None, share: float = 0.5, **raking) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) of the cells of measured rows, stored.

    goals: shares to meet for each side, as a table; targets: the same for some values of a side, see stated(); sides with
    neither get tempered shares by power (0.9 unless given).
    """
    cells = stored(rows.groupBy(*SIDES).agg(F.sum("tokens").alias("tokens")), "cells")
    power = {s: 0.9 for s in SIDES} | (power or {})
    aims = dict(goals or {})
    for side in SIDES:
        if side not in aims:
            aims[side] = stated(cells, side, targets[side]) if side in (targets or {}) else tempered(cells, side, power[side])
    return stored(calibrated(rake(cells, {s: aims[s] for s in SIDES}, **raking), share).select(*SIDES, "tokens", "weight", "probability"), "probabilities")


def report(fitted: DataFrame, side: str) -> DataFrame:
    """(side, tokens, had, weight, kept): of each value of a side of fit()'s cells its share of all tokens, its raked share and the expected share of the sample."""
    part = lambda c: (F.sum(c) / F.sum(F.sum(c)).over(Window.partitionBy())).alias
    return fitted.groupBy(side).agg(F.sum("tokens").alias("tokens"), part(F.col("tokens"))("had"), part(F.col("weight"))("weight"), part(F.col("tokens") * F.col("probability"))("kept"))


def mix(docs: DataFrame, seed: int = 11, topic: Column | None = None, **fitting) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled) of every row. Texts are read once. fitting: see fit()."""
    rows = stored(measured(docs, topic=topic), "measured")
    return rows.join(fit(rows, **fitting).select(*SIDES, "probability"), list(SIDES)).withColumn("sampled", uniform("doc_id", seed) < F.col("probability")).select("doc_id", *SIDES, "tokens", "probability", "sampled")


def sample(docs: DataFrame, seed: int = 11, topic: Column | None = None, **fitting) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    rows = measured(docs.select(whole(docs), "doc_id", "text", "source", "lang"), topic=topic, keep=["row"])
    fitted = fit(measured(docs, topic=topic), **fitting).select(*SIDES, "probability")
    return rows.join(fitted, list(SIDES)).filter(uniform("doc_id", seed) < F.col("probability")).select("row.*")
