"""Weak supervision of quality by rules that vote or abstain. DataFrame functions only.

Each rule votes 1 (good), 0 (bad) or null (abstains). Expectation-maximisation over the counts of vote patterns, of
which there are at most 3 to the number of rules whatever the input, estimates the share of good documents and each
rule's accuracy on either side; from these, each document has a posterior probability of being good. Abstaining is no evidence.

A null or empty text has no words: its counts are zero and base_failed holds. An empty table gives no rows. Equal
rows are judged once each. Other columns, whatever their names, are kept out of the result unless asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, let

#: Fixed values of the contract.
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_POSITIONS = 24


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def repeated_words(w: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are hashed to 64 bits, sorted with their places, and those equal to a neighbour are kept. Hash and place
    share one long where places fit 24 bits: the upper hash bits sort, the full hashes decide. Where different hashes share their upper
    bits, equal ones may not be neighbours; such texts, and longer ones, sort pairs of the full hash and the place.
    """
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        """Size of the union of [p, p + 3) over the sorted places."""
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).cast("long").alias("n"), (p + 3).alias("end")), lambda s: s["n"])

    def pairs(h: Column) -> Column:
        def repeats(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), repeats)

    def packed(h: Column) -> Column:
        mask = (1 << _POSITIONS) - 1
        place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
        full = lambda x: F.get(h, place(x))

        def repeats(s: Column) -> Column:
            top = lambda x, j: F.coalesce(F.shiftright(x, _POSITIONS) == F.shiftright(F.get(s, j), _POSITIONS), F.lit(False))
            same = lambda x, j: F.coalesce(top(x, j) & (full(x) == full(F.get(s, j))), F.lit(False))
            clash = F.size(F.filter(s, lambda x, i: top(x, i + 1) & (full(x) != full(F.get(s, i + 1))))) > 0
            found = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), place))
            return F.when(clash, pairs(h)).otherwise(found)

        return let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))), repeats)

    return F.when(n < 4, F.lit(0).cast("long")).when(n < (1 << _POSITIONS), covered(let(hashes, packed))).otherwise(covered(let(hashes, pairs)))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) and what the rules read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.length(F.translate("text", _BLANKS, "")).cast("long")
    rows = rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), bare.alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (F.length("text") - F.length(F.translate("text", "|{}[]=_\\~^", ""))).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.d").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), F.col("lines.n").alias("n_lines"), "n_distinct", "n_marks", "n_letters")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, 0)
    return vote if good is None else vote.when(good, 1)


def rules() -> dict[str, Column]:
    """Votes over the columns of base(). Outside its bounds a rule abstains; most rules only ever vote against."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    symbols, length, dups, repeats, distinct, marks, letters = F.col("n_symbols") / n, chars / n, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("n_distinct") / n, F.col("n_marks") / n, F.col("n_letters") / chars
    return {
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "letters": _vote(letters < 0.8, letters > 0.94),
        "marks": _vote(marks > 0.1),
        "word_length": _vote((length < 2) | (length > 14)),
        "dup_lines": _vote((dups > 0.3) & (F.col("n_dup_lines") >= 3)),
        "repeats": _vote(repeats > 0.35),
        "distinct": _vote(distinct < 0.1),
        "enough": _vote(F.col("n_words") < 20, F.col("n_words") >= 100),
    }


#: What each rule is taken to do before anything is seen, in documents: votes good, votes bad, abstains.
_GOOD, _BAD = (6.0, 0.3, 3.7), (1.5, 6.0, 2.5)


def weights(prior: float, table: list[tuple[tuple, tuple]]) -> tuple[float, list[tuple[float, float]]]:
    """(log odds of good before any vote, for each rule what a vote for good and one for bad add to them)."""
    return math.log(prior / (1 - prior)), [(math.log(good[0] / bad[0]), math.log(good[1] / bad[1])) for good, bad in table]


def posterior(votes: tuple[int | None, ...], start: float, adds: list[tuple[float, float]]) -> float:
    odds = start + sum(a[1 - v] for v, a in zip(votes, adds) if v is not None)
    return 1 / (1 + math.exp(max(-700.0, min(700.0, -odds))))


def expect(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 500) -> tuple[float, list[tuple[tuple, tuple]], dict[tuple, float]]:
    """(share of good, each rule's chance to vote good and to vote bad on a good and on a bad document, posterior of each pattern).

    Expectation-maximisation over patterns and their counts. A vote weighs as much as it is likelier on the one side than
    on the other; a rule that abstains is taken as not asked, so it leaves the posterior where it is, and a document on
    which all abstain has the share of good as its own. The starting beliefs stay as pseudo-counts. A rule's vote against is never taken to
    be likelier for good documents than for bad ones, nor the reverse, lest the sides change places.
    """
    k = len(patterns[0][0]) if patterns else 0
    prior = 0.8
    table = [tuple(tuple(x / sum(side) for x in side[:2]) for side in (_GOOD, _BAD))] * k
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        start, adds = weights(prior, table)
        post = [(v, n, n * posterior(v, start, adds)) for v, n in patterns]
        share = (sum(p for *_, p in post) + 8) / (total + 10)
        new = []
        for r in range(k):
            good, bad = list(_GOOD[:2]), list(_BAD[:2])
            for v, n, p in post:
                if v[r] is not None:
                    good[1 - v[r]] += p
                    bad[1 - v[r]] += n - p
            on_good, on_bad = sum(p for *_, p in post) + sum(_GOOD), sum(n - p for _, n, p in post) + sum(_BAD)
            good, bad = [x / on_good for x in good], [x / on_bad for x in bad]
            good[1], bad[0] = min(good[1], bad[1]), min(bad[0], good[0])
            new.append((tuple(good), tuple(bad)))
        moved = max([abs(share - prior), *(abs(x - y) for p, q in zip(new, table) for one, two in zip(p, q) for x, y in zip(one, two))])
        prior, table = min(0.999, max(0.001, share)), new
        if moved < 1e-9:
            break
    return prior, table, {v: posterior(v, *weights(prior, table)) for v, _ in patterns}


def judge(features: DataFrame, votes: dict[str, Column], threshold: float = 0.5) -> DataFrame:
    """features with posterior and kept: not base_failed and a posterior of at least threshold.

    features is read twice, so callers store it: once to count vote patterns, of which the driver gets at most
    3 ** rules, and once to add up what the votes of each row weigh.
    """
    cast = {name: F.coalesce(v.cast("string"), F.lit("-")) for name, v in votes.items()}
    counted = features.groupBy(F.concat(*cast.values()).alias("votes")).count().orderBy("votes").collect()
    read = lambda s: tuple(None if c == "-" else int(c) for c in s)
    prior, table, _ = expect([(read(r["votes"]), r["count"]) for r in counted])
    if not counted:
        return features.withColumns({"posterior": F.lit(None).cast("double"), "kept": F.lit(False)})
    odds, adds = weights(prior, table)
    total = F.lit(odds)
    for vote, (good, bad) in zip(votes.values(), adds):
        total = total + F.when(vote == 1, good).when(vote == 0, bad).otherwise(0.0)
    judged = features.withColumn("posterior", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -total)))))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
