"""Language-model scores of texts: a word unigram base and a causal self-attention model on subword ids.

The base needs every training word's count. Counts are combined per task and summed by word; the words that are frequent
enough for at most `hot` of them to be so go to the tasks as a table of that proven size, and each text's other words are
joined with the counts by word, so no vocabulary passes through the driver and no frequent word meets in one task.

Each text is cut into subwords once, by words that a task has numbered, each cut when it is first met; its ids are stored and read by all later passes. The first counts, for every id, what
stands before it: `buckets` numbers an id, by a hash of the id before, summed over all training texts. They are of the
tokenizer's size, whatever the input's, so the driver gets them. From them come the classes of the output: the most
frequent ids are classes of their own, and the others are clustered by what stands before them (k-means on square roots of
shares, weighted by counts).

The model has one causal self-attention layer with a bias per distance and a two-step output: the class of the next
id given the context, then the id within its class by its share there. Windows of `window` ids overlap, so each id
is scored once with at least `overlap` ids before it (as far as the text has them); many windows form one masked batch.
It is trained in numpy by tasks on windows that tile every whole training text, so that each id and each text's end is
learned once. Training goes by rounds over disjoint parts of the texts; after each, the tasks' parameters and step sizes are
averaged by weight in a tree. So the model depends on how the rows lie in partitions (their order and number), within what
the average of tasks leaves; the base does not.

A null text counts as empty: one end token. Empty training data give every token the same base probability and the model its
starting weights. Rows that repeat are scored once each, and have equal scores; an id that is null or repeats is kept as it
is, for rows are numbered inside. Very long texts are windows like others, some at a time, so only their own ids are held at once.
Frequencies that tie are ranked by id. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored
from .subwords import Subwords, subwords

END = b""
_FLUSH = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, as bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c) over the texts of train, the end of each as the empty word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > _FLUSH:
                    yield out()
                    counts.clear()
            counts[END] += batch.num_rows
        if counts:
            yield out()

    return train.select("text").mapInArrow(task, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, hot: int, most_bytes: int = 8 << 20) -> list[tuple[bytes, int]]:
    """The words of at least some count, the least for which there are at most `hot` of them, of at most `most_bytes` in all."""
    level = F.floor(F.log2("c") * 16).cast("int")
    total, size, cut = 0, 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("bytes")).collect(), reverse=True):  # a few hundred rows at most
        total, size = total + r["n"], size + r["bytes"]
        if total > hot or size > most_bytes:
            break
        cut = r["level"]
    return [] if cut is None else [tuple(r) for r in counts.filter(level >= cut).select("word", "c").collect()]


@dataclass
class Vocabulary:
    """For each subword id: input row (its rank), class, and log10 share within its class."""

    row: np.ndarray
    of: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    end: int

    @property
    def start(self) -> int:
        return len(self.row) - 1

    @property
    def pad(self) -> int:
        return int(self.row.max()) + 1


def numbers(raw: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    """Ids from their stored bytes: two each where the tokenizer has at most 65,536 ids, else four."""
    return np.frombuffer(raw, "<u2" if size <= 1 << 16 else "<u4").astype(kind)


def contexts(ids: DataFrame, size: int, buckets: int = 64) -> np.ndarray:
    """(size + 1, buckets) over ids (ids): how often each id, or the end, which comes last, follows an id of each bucket. The start has a bucket as any id has."""
    names = [f"b{i}" for i in range(buckets)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 2) * buckets, np.int64)  # the last row: the start, which follows nothing
        bucket = ((np.arange(size + 2) * 2654435761 % 2**32 >> 7) % buckets).astype(np.int32)
        held: list[np.ndarray] = []
        first, last, n = np.array([size + 1], np.int32), np.array([size], np.int32), 0

        def add() -> None:
            x = np.concatenate(held)
            total[:] += np.bincount(x[1:] * np.int32(buckets) + bucket.take(x[:-1]), minlength=len(total))
            held.clear()

        for batch in batches:
            for raw in batch.column(0):
                held += [first, numbers(raw.as_py(), size, np.int32), last]
                n += len(held[-2])
                if n > 4_000_000:
                    add()
                    n = 0
        if held:
            add()
        table = total.reshape(-1, buckets)[:-1]
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(table[at, i]) for i in range(buckets))], ["id", *names])

    summed = ids.select("ids").mapInArrow(task, "id int, " + ", ".join(f"{x} long" for x in names)).groupBy("id").agg(*(F.sum(x).alias(x) for x in names))
    got = summed.toArrow()  # at most a row for each id of the tokenizer
    out = np.zeros((size + 1, buckets), np.int64)
    if got.num_rows:
        out[got["id"].to_numpy()] = np.stack([got[x].to_numpy() for x in names], 1)
    return out


def clusters(table: np.ndarray, n: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """A cluster, of n, for each row of counts: k-means of the square roots of their smoothed shares, weighted by counts."""
    total = table.sum(1, keepdims=True)
    x = np.sqrt((table + 20 * (table.sum(0) + 1) / (table.sum() + table.shape[1])) / (total + 20))
    weight = total[:, 0] + 0.5
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        of = (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in range(n):
            mine = of == c
            centres[c] = np.average(x[mine], 0, weight[mine]) if mine.any() else x[rng.choice(len(x), p=weight / weight.sum())]
    return of


def vocabulary(table: np.ndarray, rows: int | None = None, single: int = 8, grouped: int = 32) -> Vocabulary:
    """Ids of the tokenizer, then the end, then the start; table: counts by what stands before, as contexts() gives them.

    Every id has an input row of its own, or, with `rows`, the rarest share the last but one; the start has the last.
    """
    end = len(table) - 1
    rows = rows or end + 2
    n = table.sum(1)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(end + 2, np.int64)
    rank[order] = np.arange(end + 1)
    smooth = n + 0.5
    of = np.zeros(end + 2, np.int64)
    of[order[:single]] = np.arange(single)
    of[order[single:]] = single + clusters(table[order[single:]], grouped)
    per = np.bincount(of[:-1], smooth, single + grouped) + 1e-9
    share = np.append(np.log10(smooth / per[of[:-1]]), 0.0).astype(np.float32)
    return Vocabulary(np.append(np.minimum(rank[:-1], rows - 2), rows - 1), of, share, np.log(per / per.sum()).astype(np.float32), end)


WIDTH = 8
_FAR = np.float32(-1e9)


def shapes(vocab: Vocabulary, window: int) -> dict[str, tuple[int, ...]]:
    return {"e": (vocab.pad + 1, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "d": (window,), "o": (WIDTH, len(vocab.prior)), "b": (len(vocab.prior),)}


class Model:
    """Parameters and the forward and backward passes."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None, window: int = 16, overlap: int = 3):
        self.vocab, self.pad, self.window, self.overlap = vocab, vocab.pad, window, overlap
        self.shapes = shapes(vocab, window)
        if flat is None:
            rng = np.random.default_rng(3)
            flat = np.concatenate([vocab.prior if k == "b" else rng.normal(0, 0.0 if k == "d" else 0.3 if k == "e" else 0.25, s).ravel() for k, s in self.shapes.items()]).astype(np.float32)
        self.flat = flat.astype(np.float32).copy()
        self.p, at = {}, 0
        for k, s in self.shapes.items():
            self.p[k] = self.flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        i = np.arange(window)
        self.back = np.clip(i[:, None] - i[None, :], 0, None)
        self.later = np.where(i[None, :] > i[:, None], _FAR, np.float32(0))
        self.room: dict[str, np.ndarray] = {}

    def space(self, name: str, *shape: int) -> np.ndarray:
        """An array that is used again by every batch, for what is large."""
        n = math.prod(shape)
        if name not in self.room or len(self.room[name]) < n:
            self.room[name] = np.empty(n, np.float32)
        return self.room[name][:n].reshape(shape)

    def table(self) -> np.ndarray:
        """All input rows, and their q, k and v, side by side."""
        return np.concatenate([self.p["e"], *(self.p["e"] @ self.p[n] for n in "qkv")], 1)

    def attend(self, rows: np.ndarray, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights, what they are to be multiplied by to add up to 1, what the values give) of windows of input rows for their last queries."""
        first = rows.shape[1] - q.shape[1]
        s = np.matmul(q, k.transpose(0, 2, 1), out=self.space("s", *q.shape[:2], rows.shape[1]))
        s += (self.p["d"][self.back] + self.later)[first:]
        window, place = np.divmod(np.flatnonzero(rows == self.pad), rows.shape[1])
        s[window, :, place] = _FAR
        if s.max() > 60:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        sums = s.reshape(-1, s.shape[2]) @ np.ones(s.shape[2], np.float32)
        part = (1 / (sums + np.float32(1e-30))).reshape(*q.shape[:2], 1)
        given = np.matmul(s, v)
        given *= part
        return s, part, given

    def odds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds of the classes for hidden values (n, WIDTH), and what each class's are to be multiplied by."""
        o, b = self.p["o"], self.p["b"]
        z = np.matmul(h, o, out=self.space("z", len(h), len(b)))
        if (np.abs(o).sum(0) + np.abs(b)).max() > 60:  # hidden values lie in -1..1
            z += b
            z -= z.max(1, keepdims=True)
            b = np.zeros_like(b)
        return np.exp(z, out=z), np.exp(b)

    def windows(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input rows and next ids (-1: none) of texts one after the other, where their windows start, and each window's text."""
        vocab, step = self.vocab, self.window - self.overlap
        lengths = np.array([len(i) + 1 for i in ids])
        windows = -(-lengths // step)
        # inputs with `overlap` pads before each text, padded at the end to whole steps
        room = windows * step + self.overlap
        base = np.concatenate([[0], np.cumsum(room)])
        x = np.full(base[-1], vocab.pad, np.int32)
        y = np.full(base[-1], -1, np.int32)
        # each text's ids, and the end, lie together from its base on; its inputs from `overlap` places later on
        flat = np.concatenate([*ids, np.empty(0, np.int64)])
        before = np.cumsum(lengths - 1) - (lengths - 1)
        at = np.arange(len(flat)) + np.repeat(base[:-1] + self.overlap - before, lengths - 1)
        y[at], x[at + 1] = flat, vocab.row[flat]
        x[base[:-1] + self.overlap] = vocab.row[vocab.start]
        y[base[:-1] + self.overlap + lengths - 1] = vocab.end
        starts = np.repeat(base[:-1], windows) + step * (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
        return x, y, starts, np.repeat(np.arange(len(ids)), windows)

    def log_scores(self, ids: list[np.ndarray], table: np.ndarray | None = None, batch: int = 384) -> np.ndarray:
        """log10 probability of each text of ids (its subwords, without start and end), batches of windows at a time."""
        vocab = self.vocab
        table = self.table() if table is None else table
        out = np.zeros(len(ids))
        x, y, starts, owner = self.windows(ids)
        span = np.arange(self.window)
        for at in range(0, len(starts), batch):
            s = starts[at : at + batch, None] + span
            rows, target = x.take(s), y.take(s[:, self.overlap :])
            e, q, k, v = (part[..., i : i + WIDTH] for part in [table.take(rows, 0)] for i in range(0, 4 * WIDTH, WIDTH))
            h = self.attend(rows, q[:, self.overlap :], k, v)[-1]
            h += e[:, self.overlap :]
            z, scale = self.odds(np.tanh(h, out=h).reshape(-1, WIDTH))
            t = target.ravel()
            of = vocab.of.take(t)
            share = z.ravel().take(np.arange(0, z.size, z.shape[1]) + of) * scale.take(of) / (z @ scale)
            logp = np.log10(share + np.float32(1e-37)) + vocab.share.take(t)
            logp[t < 0] = 0
            out += np.bincount(owner[at : at + batch], logp.reshape(target.shape).sum(1, dtype=float), len(ids))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of windows: input rows x and target classes y (both (B, window); -1 targets don't count), and its gradient."""
        chances, g, rows, sums = self.slopes(x, y, 0)
        loss = -float(np.log(chances[y.ravel() >= 0] + np.float32(1e-37)).sum()) / max(1, int((y >= 0).sum()))
        table = np.zeros_like(self.p["e"])
        table[rows] = sums
        return loss, np.concatenate([table.ravel(), g])

    def slopes(self, x: np.ndarray, y: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each target's probability, and the gradient of the mean loss as in gradient(), with targets y of the places from `first` on.

        The gradient of e is given as rows and theirs, that of the others flat, in the order of the parameters.
        """
        p, (n, w) = self.p, x.shape
        e = p["e"].take(x, 0)
        flat, own = e.reshape(-1, WIDTH), np.ascontiguousarray(e[:, first:])
        q = (own.reshape(-1, WIDTH) @ p["q"]).reshape(own.shape)
        both = np.concatenate([p["k"], p["v"]], 1)
        kv = (flat @ both).reshape(n, w, 2 * WIDTH)
        k, v = kv[..., :WIDTH], kv[..., WIDTH:]
        a, part, given = self.attend(x, q, k, v)
        h = np.tanh(own + given).reshape(-1, WIDTH)
        z, scale = self.odds(h)
        t = y.ravel()
        on = t >= 0
        of = np.maximum(t, 0)
        total, cells, at = z @ scale, z.ravel(), np.arange(0, z.size, z.shape[1]) + of
        one = scale.take(of)
        chances = cells.take(at) * one / total
        # the odds' slopes are z * scale * share
        cells[at] -= total / one
        share = on / (np.float32(max(1, np.count_nonzero(on))) * total)
        go, gb = (h * share[:, None]).T @ z * scale, share @ z * scale
        dx = z @ (p["o"] * scale).T
        dx *= share[:, None]
        dx *= 1 - h * h
        dx = dx.reshape(own.shape)
        dg = dx * part
        ds = np.matmul(dg, v.transpose(0, 2, 1), out=self.space("ds", *a.shape))
        given *= dg
        ds -= (given.reshape(-1, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(part.shape)
        ds *= a
        dkv = self.space("dkv", *kv.shape)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dg, out=dkv[..., WIDTH:])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        dq = np.matmul(ds, k).reshape(-1, WIDTH)
        gkv = flat.T @ dkv
        gd = np.bincount(self.back[first:].ravel(), (np.ones(n, np.float32) @ ds.reshape(n, -1)) * (self.later[first:] == 0).ravel(), self.window)
        g = np.concatenate([(own.reshape(-1, WIDTH).T @ dq).ravel(), gkv[:, :WIDTH].ravel(), gkv[:, WIDTH:].ravel(), gd.astype(np.float32), go.ravel(), gb])
        de = (dkv @ both.T).reshape(e.shape)
        dx += (dq @ p["q"].T).reshape(dx.shape)
        de[:, first:] += dx
        places = x.ravel().astype(np.uint16 if self.pad < 1 << 16 else np.int32)  # short numbers sort by radix
        order = np.argsort(places, kind="stable")
        places = places[order]
        begins = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        return chances, g, places[begins].astype(np.int64), np.add.reduceat(de.reshape(-1, WIDTH).take(order, 0), begins)


class Steps:
    """AdaGrad for a model's parameters, with one rate for each input row. state: what has been summed, as flat numbers."""

    def __init__(self, model: Model, rate: float, state: np.ndarray | None = None):
        self.model, self.rate = model, np.float32(rate)
        sizes = {k: (s[0], 1) if k == "e" else s for k, s in model.shapes.items()}
        self.state = np.full(sum(map(math.prod, sizes.values())), 1e-8, np.float32) if state is None else state.astype(np.float32).copy()
        rows = sizes["e"][0]
        self.rows, self.others = self.state[:rows], self.state[rows:]

    def step(self, g: np.ndarray, rows: np.ndarray, sums: np.ndarray) -> None:
        """One step by slopes()."""
        self.others += g * g
        self.model.flat[-len(g) :] -= self.rate * g / np.sqrt(self.others)
        seen = self.rows.take(rows) + (sums * sums) @ np.full(WIDTH, 1 / WIDTH, np.float32)
        self.rows[rows] = seen
        e = self.model.p["e"]
        e[rows] = e.take(rows, 0) - sums * (self.rate / np.sqrt(seen))[:, None]


#: Rounds of training: each learns from the texts whose hash mod 8 is named, so that every text is learned once.
ROUNDS = ((0,), (1, 2, 3), (4, 5, 6, 7))


def train(encoded: DataFrame, vocab: Vocabulary, rounds: tuple[tuple[int, ...], ...] = ROUNDS, batch: int = 128, rate: float = 0.1) -> np.ndarray:
    """Parameters after training by tasks and averaging, a round after another. encoded: ids, as encode() gives them."""
    context = encoded.sparkSession.sparkContext
    flat = Model(vocab).flat
    size, state = len(flat), None
    for number, part in enumerate(rounds):
        shared = context.broadcast((vocab, flat, state))  # of the model's size, which the input does not change

        def task(batches: Iterator[pa.RecordBatch], shared=shared, speed=rate / (1 + number)) -> Iterator[pa.RecordBatch]:
            vocab, flat, state = shared.value
            model = Model(vocab, flat)
            steps, rng = Steps(model, speed, state), np.random.default_rng(5)
            seen, held, size = 0, [], 0
            span = np.arange(model.window)

            def learn() -> int:
                """Steps on all windows of the held texts, in any order, so that a batch isn't one text's."""
                x, y, starts, _ = model.windows(held)
                of = np.where(y < 0, -1, vocab.of[y])
                for s in np.array_split(rng.permutation(starts), -(-len(starts) // batch)):
                    s = s[:, None] + span
                    steps.step(*model.slopes(x.take(s), of.take(s[:, model.overlap :]), model.overlap)[1:])
                held.clear()
                return int((y >= 0).sum())

            for b in batches:
                for ids in b.column(0):
                    held.append(numbers(ids.as_py(), vocab.end))
                    size += len(held[-1]) + 1
                    if size >= 64 * batch * (model.window - model.overlap):
                        seen, size = seen + learn(), 0
            if held:
                seen += learn()
            if seen:
                yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "weight": [float(seen)], "flat": pa.array([np.concatenate([model.flat, steps.state]).tobytes()], pa.binary())})

        texts = encoded.filter(F.pmod(F.xxhash64("ids"), F.lit(8)).isin(*part)).select("ids")
        trained = stored(texts.mapInArrow(task, "task long, weight double, flat binary"), "attention")
        total = averaged(trained)
        discard(trained)
        if total is not None:
            flat, state = total[:size], total[size:]
    return flat


def averaged(rows: DataFrame, fan: int = 24) -> np.ndarray | None:
    """The weighted mean of the rows' parameters; each merging task takes about `fan` of them."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        weight = group["weight"].sum()
        mean = sum(w / weight * np.frombuffer(f, np.float32) for w, f in zip(group["weight"], group["flat"]))
        return pd.DataFrame({"task": [int(group["task"].iloc[0])], "weight": [weight], "flat": [mean.astype(np.float32).tobytes()]})

    n = rows.count()
    while n > 1:
        parts = math.ceil(n / fan)
        rows = stored(rows.groupBy(F.pmod("task", F.lit(parts))).applyInPandas(merge, "task long, weight double, flat binary"), "attention")
        before, n = n, rows.count()
        if n == before:
            rows, n = stored(rows.groupBy(F.lit(0)).applyInPandas(merge, "task long, weight double, flat binary"), "attention"), 1
    last = rows.first()
    return None if last is None else np.frombuffer(last["flat"], np.float32)


class _Numbers(dict):
    """Numbers of words, from 0 on: a new word gets the next and is listed."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Words:
    """Numbers for words as words_of() gives them, with the subword ids of each, which are cut once.

    The first numbers are those of `known` words. Others start anew once there are more than `most` or they have more than `most_bytes`.
    """

    def __init__(self, cut: Subwords, known: list[bytes], most: int = 250_000, most_bytes: int = 8 << 20):
        self.cut, self.known, self.most, self.most_bytes = cut, known, most, most_bytes
        self._anew()

    def _anew(self) -> None:
        self.numbers, self.bytes = _Numbers(self.known[:]), 0
        self.length = np.full(len(self.known) + self.most, -1, np.int32)  # -1: not cut yet
        self.start = np.zeros(len(self.length), np.int64)
        self.pool, self.filled = np.empty(1 << 20, np.uint16 if self.cut.size <= 1 << 16 else np.uint32), 0

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words of texts, which hold until the next call."""
        words = self.numbers.words
        if len(words) > len(self.known) + self.most or self.bytes > self.most_bytes:
            self._anew()
            words = self.numbers.words
        before = len(words)
        out = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64)
        self.bytes += sum(map(len, words[before:]))
        if (more := len(words) - len(self.length)) > 0:
            self.length = np.concatenate([self.length, np.full(more, -1, np.int32)])
            self.start = np.concatenate([self.start, np.zeros(more, np.int64)])
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of plain words one after the other, and how many each word has."""
        new = np.unique(numbers[self.length[numbers] < 0])
        if len(new):
            ids, n = self.cut.many([self.numbers.words[i].decode().lower() for i in new.tolist()])
            self.length[new], self.start[new] = n, self.filled + np.cumsum(n) - n
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.filled], np.empty(len(self.pool) + len(ids), self.pool.dtype)])
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
        n = self.length[numbers].astype(np.int64)
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.start[numbers] - ends + n, n) + np.arange(n.sum())], n


#: The words of the last table that this process met, under its name: its next tasks know them.
_met: dict[str, Words] = {}


def _words(name: str, tokenizer: str, known: list[bytes]) -> Words:
    if name not in _met:
        _met.clear()
        _met[name] = Words(subwords(tokenizer), known)
    return _met[name]


def encode(docs: DataFrame, train_on: str, tokenizer: str, words: list[tuple[bytes, int]], floor: int, ends: int | None) -> DataFrame:
    """A row for each of docs, numbered, stored: its ids, and what the base needs: the sum over the end and the known `words`, and the other words.

    floor: what counts are divided by; ends: how many training texts there are, None for no training words at all.
    """
    name = uuid.uuid4().hex
    known = [(bytes(w), c) for w, c in words if w != END]
    shared = docs.sparkSession.sparkContext.broadcast(([w for w, _ in known], np.array([c for _, c in known], np.int64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = shared.value
        words, cut, first = _words(name, tokenizer, listed), subwords(tokenizer), len(listed)
        logs = np.log10((counts + 1) / floor)
        row = TaskContext.get().partitionId() << 36
        end = math.log10(((ends or 0) + 1) / floor)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column("text").to_pylist()
                said = [words_of(text) for text in texts]
                n = np.array(list(map(len, said)))
                numbers, text = words.of(said), np.repeat(np.arange(len(said)), n)
                old = numbers < first
                sums = np.bincount(text[old], logs[numbers[old]], len(said)) + end
                known = np.bincount(text[old], minlength=len(said)) + (ends is not None)
                others, often = np.unique(text[~old] << 32 | numbers[~old], return_counts=True)
                stops = np.searchsorted(others >> 32, np.arange(len(said) + 1))
                others = list(map(words.numbers.words.__getitem__, (others & 0xFFFFFFFF).tolist()))
                rest = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays([pa.array(others, pa.binary()), pa.array(often, pa.int64())], ["word", "n"]))
                plain = np.array([cut.plain(text or "") for text in texts], bool)
                flat, lengths = words.ids(numbers[plain[text]])
                stops = np.concatenate([[0], np.cumsum(np.bincount(text[plain[text]], lengths, len(said)).astype(np.int64))])
                ids = [flat[stops[i] : stops[i + 1]] if plain[i] else np.frombuffer(cut.encode(texts[i]), "<u4").astype(flat.dtype) for i in range(len(said))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + part.num_rows), pa.int64()), part.column("doc_id"), part.column("learned"), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), rest, pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["row", "doc_id", "learned", "n", "known", "sum", "rest", "ids"],
                )
                row += part.num_rows

    rows = docs.select(F.col("doc_id").cast("long"), F.col(train_on).alias("learned"), "text")
    return stored(rows.mapInArrow(task, "row long, doc_id long, learned boolean, n long, known long, sum double, rest array<struct<word:binary,n:long>>, ids binary"), "encoded")


def modelled(encoded: DataFrame, vocab: Vocabulary, flat: np.ndarray) -> DataFrame:
    """(row, doc_id, learned, n, known, sum, score) of encode()'s rows: the model's log10 probability of each."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocab, flat))
    kept = ["row", "doc_id", "learned", "n", "known", "sum"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        model = Model(vocab, flat)
        table = model.table()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [numbers(x.as_py(), vocab.end) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(model.log_scores(ids, table), pa.float64())], [*kept, "score"])

    return encoded.select(*kept, "ids").mapInArrow(task, "row long, doc_id long, learned boolean, n long, known long, sum double, score double")


def score(docs: DataFrame, train_on: str, tokenizer: str, hot: int = 200_000, **training) -> DataFrame:
    """docs (doc_id, text, flag train_on) to (doc_id, learned, n_tokens, n_known, train_tokens, base_score, score)."""
    counts = stored(word_counts(docs.filter(train_on).select("text")), "word-counts")
    total, distinct, ends = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    total = total or 0
    floor = total + distinct + 1
    encoded = encode(docs, train_on, tokenizer, frequent(counts, hot), floor, ends)
    ids = encoded.filter("learned").select("ids")
    vocab = vocabulary(contexts(ids, subwords(tokenizer).size))
    scored = stored(modelled(encoded, vocab, train(ids, vocab, **training)), "scored")
    others = encoded.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("n")).join(counts, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(floor))
    more = others.groupBy("row").agg(F.sum(F.col("n") * log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("also"))
    both = scored.join(more, "row", "left")
    return both.select("doc_id", "learned", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
