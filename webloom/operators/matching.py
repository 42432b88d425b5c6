"""Many names or terms looked for in many texts at once, and groups of what is linked. No name meets a text that has none of its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept, spread

_SIGN, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_WORD = rf"{_SIGN}+"


def small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """rows, computed before, sent to all tasks where they are at most that many; more of them are joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def holding(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, form, ...): which forms each word holds anywhere, by an equal join on its parts of the forms' lengths. words (word) are distinct; forms (form, ...) were computed before."""
    sizes = [r["n"] for r in forms.select(F.length("form").alias("n")).distinct().collect()]  # some dozens
    none = F.array().cast("array<int>")
    parts = lambda n: F.transform(F.when(F.length("word") >= n, F.sequence(F.lit(1), F.length("word") - n + 1)).otherwise(none), lambda i: F.substring("word", i, F.lit(n)))
    every = F.array_distinct(F.concat(*map(parts, sizes))) if sizes else none.cast("array<string>")
    return words.select("word", F.explode(every).alias("form")).join(small(forms), "form")


def _keys(needles: DataFrame) -> DataFrame:
    """(needle, kind, form) of the words of needles (needle): a word within a needle is a whole word of a text that holds it, the first one an end of a word, the last one a start, the only one any part."""
    cut = F.split("needle", rf"(?<={_SIGN})(?={_GAP})|(?<={_GAP})(?={_SIGN})")
    at = lambda x, i: F.struct(F.concat(F.when(i == 0, "l").otherwise(""), F.when(i == F.size(cut) - 1, "r").otherwise("")).alias("kind"), x.alias("form"))
    return needles.select("needle", F.explode(F.array_distinct(F.filter(F.transform(cut, at), lambda k: k["form"].rlike(f"^{_SIGN}")))).alias("k")).select("needle", "k.*")


def _led(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(word, kind, form): which keys (kind, form) each of words (word) fits, by equal joins."""
    sizes: dict[str, list[int]] = {}
    for r in keys.select("kind", F.length("form").alias("n")).distinct().collect():  # some dozens
        sizes.setdefault(r["kind"], []).append(r["n"])
    size = F.length("word")
    parts = {
        "": lambda n: F.when(size == n, F.array("word")), "l": lambda n: F.when(size >= n, F.array(F.substring("word", -n, n))), "r": lambda n: F.when(size >= n, F.array(F.substring("word", 1, n))),
        "lr": lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("word", i, F.lit(n)))),
    }
    none = F.array().cast("array<struct<kind: string, form: string>>")
    every = (F.coalesce(F.transform(parts[kind](n), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("form"))), none) for kind, ns in sizes.items() for n in ns)  # noqa: B023
    return words.select("word", F.explode(F.array_distinct(F.concat(none, *every))).alias("k")).select("word", "k.*").join(keys, ["kind", "form"])


def candidates(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, needles): what may be held by each text (id, text). Of a needle's words the one that the fewest texts have where the needle needs it leads to these texts."""
    keys = kept(_keys(needles.select("needle").distinct()))
    places = kept(spread(texts.select("id", "text")).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word")))
    words = kept(places.groupBy("word").agg(F.count(F.lit(1)).alias("n_texts")))
    led = kept(_led(words.select("word"), keys.select("kind", "form").distinct()))
    often = led.join(words, "word").groupBy("kind", "form").agg(F.sum("n_texts").alias("n_texts"))
    wanted = keys.join(often, ["kind", "form"]).groupBy("needle").agg(F.min(F.struct("n_texts", "kind", "form")).alias("k")).select("needle", "k.kind", "k.form")
    return places.join(led.join(wanted, ["kind", "form"]).select("word", "needle"), "word").groupBy("id").agg(F.collect_set("needle").alias("needles"))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, needles): of each text (id, text) that holds some of needles (needle) as they are, which. Needles without a letter or digit are not looked for.

    The candidates of each text are verified, each text once.
    """
    held = texts.join(candidates(needles, texts), "id").select("id", F.filter("needles", lambda n: F.col("text").contains(n)).alias("needles"))
    return held.filter(F.size("needles") > 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of edges (a, b) is linked to, itself included.

    Each round takes the least label among a node's neighbours and then the label of that label, so long chains shrink fast; it ends when a round changes nothing.
    """
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = least.alias("x").join(least.alias("y"), F.col("x.component") == F.col("y.node"), "left")
        after = kept(jump.select("x.node", F.least("x.component", "y.component").alias("component"), "x.before"))
        labels = after.select("node", "component")
        if after.filter("component <> before").isEmpty():
            return labels
