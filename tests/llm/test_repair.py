import hashlib
import random
import sys
import zlib
from functools import cache
from itertools import product

import pytest

from webloom.llm import registry, repair

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, copy string, fault int, block string, ends string, at int, kind string"
BLANKS = "\x20\t\n\x0b\x0c\r"


def damage(rows):
    """The damaged rows of a conversation: (turn, role, text) in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows, found):
    """(cost, audit, repaired lines) by trying all edits from each place and state, the rest of a path as a whole."""

    @cache
    def best(at, state, inserts=4):
        ends = [(0, "", ())] if at == len(rows) and state in "0a" else []
        wants = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[wants]
        if inserts:
            ends += [(c + 5, "I" + a, (f"{name}:", *x)) for c, a, x in best(at, wants, inserts - 1)]
        if at < len(rows):
            _, role, text = rows[at]
            initial, more = role[:1] or " ", 5 * (found[at] == "truncated")
            ends += [(c + 2, "D" + a, x) for c, a, x in best(at + 1, state)]
            if found[at] not in ("blank", "duplicate"):
                if initial == wants or initial == "s" and state == "0":
                    ends += [(c + more, "K" + a, (f"{role}:{text}", *x)) for c, a, x in best(at + 1, initial)]
                ends += [(c + 1 + more, "R" + a, (f"{name}:{text}", *x)) for c, a, x in best(at + 1, wants)]
        return [min(ends)] if ends else []

    return best(0, "0")[0]


def want(rows):
    rows = damage(rows)
    found = faults(rows)
    cost, audit, lines = plain(rows, found)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] or " " for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def held(df, rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = [(r[0], tuple(r)[1:]) for r in df.collect()]
    assert len(got) == len(by) and {c: v for c, v in got} == {c: want(v) for c, v in by.items()}


def made(seed, n, turns=9):
    r = random.Random(seed)
    texts = ["Fine.", "Well!", "no end", "", " \t\n", "Is it?", "x…", "é. ", None]
    return [(c, None if r.random() < 0.1 else r.randrange(turns), r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "umpire"]), r.choice(texts)) for c in [*range(n), None] for _ in range(r.randrange(1, turns))]


@pytest.mark.parametrize("block", [4096, 3])
def test_against_brute_force(spark, block):
    rows = made(1, 150)
    talks = spark.createDataFrame([(*r, "c", 1, "b", "e", 1, "k") for r in rows], SCHEMA)
    held(repair.repair(talks, block), rows)


def test_long_conversation_in_blocks(spark):
    rows = [(5, i // 2, *x[2:]) for i, x in enumerate(made(2, 60))] + [(6, 1, "user", "Same.")] * 40 + [(7, 1, "user", "x" * 200_000)]
    talks = spark.createDataFrame([(*r, "c", 1, "b", "e", 1, "k") for r in rows], SCHEMA)
    whole, parts = repair.repair(talks).collect(), repair.repair(talks, 7).collect()
    assert sorted(map(str, whole)) == sorted(map(str, parts))
    held(repair.repair(talks, 7), rows)


def test_every_small_lattice():
    for n in range(4):
        for rows in product(product((0, 1, 3), "sua"), repeat=n):
            names = {"s": "system", "u": "user", "a": "assistant"}
            told = plain([(0, names[r], f) for f, r in rows], [("", "blank", "", "truncated")[f] for f, _ in rows])
            assert repair.cheapest(list(rows))[:2] == told[:2]


def test_ends_by_state():
    rows = [(0, "u"), (3, "a"), (0, "u")]
    assert repair.cheapest(rows, 0, (0.0, 9.0, 3.0, 0.0))[0] <= repair.cheapest(rows)[0]
    assert repair.cheapest([], 2, (0.0,) * 4) == (0, "", 2) and repair.cheapest([], 1)[:2] == (10, "II")
    assert repair.cheapest([], 3, (0.0, float("inf"), float("inf"), float("inf")))[0] == float("inf")


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held(registry.op11_repair(spark, sf_dir), rows)


def test_empty(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
