"""Repair of conversation structure by a cheapest-edit search.

A conversation's rows and the states of the role grammar `(s?(ua)+)?` span a lattice: an edge keeps, reroles or deletes a row, or inserts an empty
one. A bidirectional Dijkstra search, forward from the start and backward from the accepting ends, goes on until no crossing of
the same cost can be missing; among all cheapest paths the one with the least audit (the edits' initials) is walked from the start:
the edges that leave a node have different initials, so the first difference decides.

A row's faults: blank (no character but ASCII white space), else duplicate (role and text stood earlier in the conversation), else truncated (its last other
character is none of `.!?`). Blank and duplicate rows must be deleted; a truncated row that stays costs 5.

Rows are ordered by turn, nulls first, then by role and text; equal rows follow each other. A conversation goes through one task as a stream of blocks of
rows and is never held whole: a block's end costs, for each state, come from the blocks behind it, and these from the blocks' own state-to-state
costs, so the search of a block sees its whole conversation. Whether a row repeats an earlier one is told by grouping, before.

A null text or role is one blank, so it is blank or has no legal role; an empty role counts as a blank. A null conv_id is a conversation of its own.
Empty tables give no rows. Texts of any length are taken whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import stored

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: 0 at the start, 1 after system, 2 after user, 3 after assistant. NEXT[state][initial] is the state behind a row of that role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What a row inserted or reroled in a state becomes.
FILLS = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0.0, inf, inf, 0.0)
#: Costs of edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5

Row = tuple[int, str]
Node = tuple[int, int]


def edges(rows: list[Row], node: Node) -> list[tuple[str, float, Node]]:
    """(initial, cost, node behind) of the edits that a node offers, by initial."""
    at, state = node
    out = [("I", INSERT, (at, NEXT[state][FILLS[state]]))]
    if at < len(rows):
        fault, role = rows[at]
        out.insert(0, ("D", DELETE, (at + 1, state)))
        if fault not in (BLANK, DUPLICATE):
            more = LEFT_TRUNCATED * (fault == TRUNCATED)
            if role in NEXT[state]:
                out.append(("K", more, (at + 1, NEXT[state][role])))
            out.append(("R", REROLE + more, (at + 1, NEXT[state][FILLS[state]])))
    return out


def reverse_edges(rows: list[Row], node: Node) -> list[tuple[float, Node]]:
    """(cost, node before) of the edits that lead to a node."""
    at, state = node
    before = [(a, p) for a in ((at, at - 1) if at else (at,)) for p in range(4)]
    return [(cost, n) for n in before for _, cost, behind in edges(rows, n) if behind == node]


def cheapest(rows: list[Row], start: int = 0, ends: tuple[float, ...] = ENDS) -> tuple[float, str, int]:
    """(cost, audit, end state) of the cheapest edits of rows from a state, `ends` being what each end state costs; ties to the least audit.

    A cost of infinity, an empty audit and the start's state where no path exists.
    """
    n = len(rows)
    forward, backward = {(0, start): 0.0}, {(n, q): c for q, c in enumerate(ends) if c < inf}
    heaps = [(0.0, (0, start))], [(c, v) for v, c in backward.items()]
    heapq.heapify(heaps[1])
    settled: tuple[set[Node], set[Node]] = (set(), set())
    best = inf
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        own, other = (forward, backward)[side], (backward, forward)[side]
        if node in other:
            best = min(best, cost + other[node])
        for step, behind in ((c, v) for _, c, v in edges(rows, node)) if side == 0 else reverse_edges(rows, node):
            if cost + step < own.get(behind, inf):
                own[behind] = cost + step
                heapq.heappush(heaps[side], (cost + step, behind))
                if behind in other:
                    best = min(best, cost + step + other[behind])
    if best == inf:
        return inf, "", start
    # nodes of the forward side from which the rest of a cheapest path is known, found from the crossings backward
    good = {v for v, c in forward.items() if v in backward and c + backward[v] == best}
    todo = list(good)
    while todo:
        node = todo.pop()
        for step, v in reverse_edges(rows, node):
            if v not in good and forward.get(v, inf) + step == forward[node]:
                good.add(v)
                todo.append(v)
    audit, node, cost = [], (0, start), 0.0
    while cost + (ends[node[1]] if node[0] == n else inf) != best:
        for initial, step, behind in edges(rows, node):
            if behind in good and forward.get(behind, inf) == cost + step or cost + step + backward.get(behind, inf) == best:
                audit.append(initial)
                node, cost = behind, cost + step
                break
    return best, "".join(audit), node[1]


def repaired(rows: list[Row], audit: str, state: int) -> Iterator[tuple[int | None, str | None]]:
    """(row or None, role or None): which rows stay, in order; a role where it is new."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        initial = rows[at][1] if edit == "K" else FILLS[state]
        yield (None, ROLES[initial]) if edit == "I" else (at, None if edit == "K" else ROLES[initial])
        at += edit != "I"
        state = NEXT[state][initial]


_COLUMNS = ("conv_id", "turn", "role", "text", "copy", "fault", "block", "ends")
RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """What is told of one conversation, a block of its rows at a time."""

    def __init__(self):
        self.faults, self.illegal, self.turns, self.first, self.last = [0, 0, 0, 0], 0, 0, None, None
        self.role, self.before, self.state, self.cost, self.audit = None, None, 0, 0, []
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, block: list[tuple], ends: tuple[float, ...]) -> None:
        """block: (turn, role, text, fault) in order; a row equal to the one before is a duplicate."""
        rows: list[Row] = []
        for turn, role, text, fault in block:
            initial = role[:1] or " "
            if self.before == (turn, role, text) and fault != BLANK:
                fault = DUPLICATE
            self.before = turn, role, text
            if turn is not None and turn != self.last:
                self.turns, self.last = self.turns + 1, turn
                self.first = turn if self.first is None else self.first
            self.faults[fault] += 1
            self.illegal += self.role is not None and self.role + initial not in ("su", "ua", "au")
            self.role = initial
            rows.append((fault, initial))
        cost, audit, end = cheapest(rows, self.state, ends)
        for at, role in repaired(rows, audit, self.state):
            line = f"{role or block[at][1]}:{'' if at is None else block[at][2]}"
            self.sha.update((line if self.empty else f"\n{line}").encode())
            self.empty = False
        self.cost, self.state = self.cost + int(cost - ends[end]), end
        self.audit.append(audit)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def damaged(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows dropped, emptied, stripped of sentence ends, repeated or made the user's by a CRC of conversation and turn. A dropped row stays with a null copy, as the sign of its conversation."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = talks.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def faulty(rows: DataFrame) -> DataFrame:
    """rows with fault. Of a conversation's rows of equal role and text, those after the least (turn, copy) are duplicates; equal rows of that very place are left to the stream."""
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    own = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    there = keyed.filter(F.col("copy").isNotNull()).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "copy")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = stored(there.filter("n > 1").select("conv_id", "role", "digest", F.col("first.turn").alias("turn"), F.col("first.copy").alias("copy")), "said-again")
    later = F.expr("r.conv_id <=> a.conv_id AND r.role = a.role AND r.digest = a.digest")
    both = keyed.alias("r").join(again.alias("a"), later, "left")
    repeats = F.col("a.digest").isNotNull() & ~(F.col("r.turn").eqNullSafe(F.col("a.turn")) & F.col("r.copy").eqNullSafe(F.col("a.copy")))
    own = F.when(F.col("r.copy").isNull(), 0).otherwise(F.when((own != BLANK) & repeats, DUPLICATE).otherwise(own))
    return both.select(*(F.col(f"r.{c}") for c in _COLUMNS[:5]), own.cast("int").alias("fault"))


def _given(value: object) -> object:
    return None if pd.isna(value) else value


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows with block and ends: 0 and null for conversations of up to `block` rows; longer ones in blocks, each with what its end states cost from there on."""
    long_ = stored(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "long-conversations")
    same = F.expr("r.conv_id <=> l.conv_id")
    few = rows.alias("r").join(long_.alias("l"), same, "left_anti").select("*", F.lit(0).cast("long").alias("block"), F.lit(None).cast("array<double>").alias("ends"))
    if long_.isEmpty():
        return few
    order = ["conv_id", "turn", "role", "text", "copy"]
    many = rows.alias("r").join(long_.alias("l"), same, "left_semi").filter(F.col("copy").isNotNull()).orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    many = stored(many.withColumn("block", F.floor(F.col("at") / block)), "long-rows")
    # equal rows lie in one partition of the sort, whose number the upper bits of `at` are
    whole = F.struct(*order[:4])
    twin = F.lag(whole).over(Window.partitionBy(F.shiftright("at", 33)).orderBy("at")).eqNullSafe(whole)
    many = many.withColumn("fault", F.when((F.col("fault") != BLANK) & twin, DUPLICATE).otherwise(F.col("fault")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    unit = [tuple(0.0 if r == q else inf for r in range(4)) for q in range(4)]

    def costs(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Of each start state, what each end state costs, row by row."""
        part = part.sort_values("at")
        found = [(int(f), role[:1] or " ") for f, role in zip(part["fault"], part["role"])]
        return pd.DataFrame({"conv_id": [_given(key[0])], "block": [key[1]], "costs": [[cheapest(found, q, unit[r])[0] for q in range(4) for r in range(4)]]})

    def behind(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ends, out = list(ENDS), []
        for b, c in sorted(zip(part["block"], part["costs"]), key=lambda x: -x[0]):
            out.append((_given(key[0]), b, list(ends)))
            ends = [min(c[4 * q + r] + ends[r] for r in range(4)) for q in range(4)]
        return pd.DataFrame(out, columns=["conv_id", "block", "ends"])

    own = many.select("conv_id", "block", "at", "role", "fault").groupBy("conv_id", "block").applyInPandas(costs, f"conv_id {kind}, block long, costs array<double>")
    after = stored(own.groupBy("conv_id").applyInPandas(behind, f"conv_id {kind}, block long, ends array<double>"), "end-costs")
    told = many.alias("r").join(after.alias("l"), F.expr("r.conv_id <=> l.conv_id AND r.block = l.block")).select("r.*", "l.ends").drop("at")
    gone = rows.alias("r").join(long_.alias("l"), same, "left_semi").filter(F.col("copy").isNull()).select("*", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("array<double>").alias("ends"))
    return few.unionByName(told).unionByName(gone)


def mended(rows: DataFrame) -> DataFrame:
    """What in_blocks() gives, a row for each conversation. A conversation streams through one task, as its audit and digest are sequences."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in RESULT.split(", ")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in _COLUMNS)))
        out: list[tuple] = []
        for conv, group in groupby(each, key=lambda r: r[0]):
            talk = Conversation()
            for (_, ends), part in groupby((r for r in group if r[4] is not None), key=lambda r: (r[6], r[7])):
                talk.add([(r[1], r[2], r[3], r[5]) for r in part], tuple(ends or ENDS))
            out.append((conv, *talk.row()))
            if len(out) == 1024:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ids if k == 0 else pa.int64() if k < 7 else pa.string()) for k, c in enumerate(zip(*out))], names)

    ids = to_arrow_type(rows.schema["conv_id"].dataType)
    order = rows.select(*_COLUMNS).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    return order.mapInArrow(told, RESULT.format(kind))


def repair(talks: DataFrame, block: int = 4096) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id of talks (conv_id, turn, role, text), after damage."""
    return mended(in_blocks(stored(faulty(damaged(talks)), "faults"), block))
