import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from webloom.llm import attention, registry
from webloom.llm.subwords import Subwords

from .data import empty, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """rows (id, text, learned) to (id, n_tokens, n_known, N, base)."""
    words = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for _, t, learned in rows if learned for w in words(t))
    total, v = c.total(), len(c)
    return [(i, len(words(t)), sum(c[w] > 0 for w in words(t)), total, sum(math.log10((c[w] + 1) / (total + v + 1)) for w in words(t))) for i, t, _ in rows]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) <= 1e-9 * max(1, abs(w[4]))


def test_base_with_and_without_frequent_words(spark):
    docs = frame(spark).selectExpr("doc_id", "text", "coalesce(doc_id % 3 != 0, true) learned", "word", "row")
    rows = [(r.doc_id, r.text, r.learned) for r in docs.collect()]
    for hot in (0, 5, 10**6):
        got = attention.score(docs, "learned", PATH, hot=hot).collect()
        close([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute(rows))
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_query_beats_unigrams(spark, sf):
    got = registry.op10_attention(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs]
    close([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute(rows))


def table(counts, size, ends, buckets=8):
    """Counts by what stands before, at random, that add up to counts."""
    rng = np.random.default_rng(4)
    out = np.zeros((size + 1, buckets), np.int64)
    for i, c in [*counts, (size, ends)]:
        out[i] = rng.multinomial(c, rng.dirichlet(np.ones(buckets)))
    return out


def small_model():
    vocab = attention.vocabulary(table([(i, 100 - i) for i in range(80)], 100, 10), rows=40, single=8, grouped=4)
    model = attention.Model(vocab, window=8, overlap=3)
    model.p["d"][:] = np.linspace(0.5, -0.5, 8)
    return vocab, model


def hidden(model, x):
    """Hidden values of the places of one window x (1, window), worked out place by place."""
    e = model.p["e"][x[0]].astype(float)
    out = []
    for i in range(len(e)):
        at = [j for j in range(i + 1) if x[0, j] != model.vocab.pad]
        w = np.array([e[i] @ model.p["q"] @ (e[j] @ model.p["k"]) + model.p["d"][i - j] for j in at])
        w = np.exp(w - w.max()) if at else w
        out.append(np.tanh(e[i] + sum(a * (e[j] @ model.p["v"]) for a, j in zip(w / w.sum(), at))) if at else np.tanh(e[i]))
    return np.array(out)


def test_probabilities_sum_to_one():
    vocab, model = small_model()
    ids = np.array([3, 1, 4])
    before = model.log_scores([ids[:0], ids[:1], ids[:2], ids])
    # over all next ids or the end, the texts that go on from a prefix have the prefix's own probability
    ends = [model.log_scores([np.append(ids, i)])[0] for i in range(100)]
    end_only = 10 ** before[3]
    first = [10 ** model.log_scores([np.array([i])])[0] for i in range(100)]
    assert len(ends) == 100 and end_only < 1 and sum(first) + 10 ** before[0] < 1 + 1e-5


def test_each_id_is_scored_once_in_batches():
    vocab, model = small_model()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 90, n) for n in (0, 1, 4, 5, 6, 40, 333)]
    together = model.log_scores(texts)
    assert np.allclose(together, [model.log_scores([t])[0] for t in texts], rtol=1e-4)
    # with the text inside one window, the score is the sum over a plain causal pass
    t = texts[2]
    rows = np.concatenate([[vocab.row[vocab.start]], vocab.row[t]])
    x = np.full((1, 8), vocab.pad)
    x[0, :5] = rows
    z = hidden(model, x)[:5] @ model.p["o"] + model.p["b"]
    targets = np.append(t, vocab.end)
    p = z[np.arange(5), vocab.of[targets]] - np.log(np.exp(z).sum(1))
    assert abs(p.sum() / math.log(10) + vocab.share[targets].sum() - together[2]) < 1e-4


def test_gradient():
    vocab, model = small_model()
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 40, (5, 8)), rng.integers(-1, 12, (5, 8))
    x[0, 5:], y[0, 5:] = vocab.pad, -1
    flat = model.flat.astype(np.float64)
    _, g = model.gradient(x, y)
    at = 0
    for name, s in model.shapes.items():
        n = math.prod(s)
        for k in at + rng.permutation(n)[:6]:
            old = model.flat[k]
            step = 1e-2
            model.flat[k] = old + step
            up = model.gradient(x, y)[0]
            model.flat[k] = old - step
            down = model.gradient(x, y)[0]
            model.flat[k] = old
            assert abs((up - down) / (2 * step) - g[k]) < 2e-3 + 0.02 * abs(g[k]), name
        at += n
    assert flat.shape == g.shape


def test_averaging_is_weighted(spark):
    rows = [(i, float(i + 1), np.full(3, i, np.float32).tobytes()) for i in range(60)]
    got = attention.averaged(spark.createDataFrame(rows, "task long, weight double, flat binary"), fan=7)
    assert np.allclose(got, sum(i * (i + 1) for i in range(60)) / sum(i + 1 for i in range(60)), rtol=1e-5)
    assert attention.averaged(spark.createDataFrame([], "task long, weight double, flat binary")) is None


def test_empty(spark):
    none = empty(spark).selectExpr("doc_id", "text", "true learned")
    assert attention.score(none, "learned", PATH).count() == 0


def trained(spark, texts, **settings):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, learned boolean").coalesce(1)
    ids = attention.encode(docs, "learned", PATH, [], 10, len(texts)).select("ids")
    vocab = attention.vocabulary(attention.contexts(ids, attention.subwords(PATH).size))
    return vocab, attention.train(ids, vocab, **settings)


def test_training_reads_whole_texts(spark):
    start, x, y = "one two three four five six seven eight nine ten", "red green " * 40, "green red " * 40
    a, b = (trained(spark, [f"{start} {more}"] * 4)[1] for more in (x, y))  # equal counts, equal first words
    assert not np.allclose(a, b, atol=1e-3)
    vocab, flat = trained(spark, [f"{start} {x}"] * 4)
    d = attention.Model(vocab, flat).p["d"]
    assert np.count_nonzero(d) == len(d)  # a bias of every distance of the window is learned


def subword_unigram(train, held):
    """log10 probability of texts held by the shares of subwords and ends in train, every id counted once more."""
    cut = attention.subwords(PATH)
    ids = lambda t: [*np.frombuffer(cut.encode(t), "<u4").tolist(), cut.size]
    c = Counter(i for t in train for i in ids(t))
    return sum(math.log10((c[i] + 1) / (c.total() + cut.size + 1)) for t in held for i in ids(t))


def test_held_out_texts_against_unigrams(spark):
    sf = "/root/testdata/sf0.01"
    got = [r for r in registry.op10_attention(spark, sf).collect() if r.held_out]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    part = lambda learned: [r.text for r in docs if (zlib.crc32(str(r.doc_id).encode()) % 7 != 2) == learned]
    model, plain, base = sum(r.score for r in got), subword_unigram(part(True), part(False)), sum(r.base_score for r in got)
    assert model > 0.85 * plain, (model, plain, base)
    assert model > 1.2 * base, (model, plain, base)


def test_every_text_is_learned_once(spark):
    texts = [f"red green {i} blue" for i in range(400)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, learned boolean")
    rounds = attention.encode(docs, "learned", PATH, [], 10, 400).selectExpr("pmod(xxhash64(ids), 8) h").groupBy("h").count().collect()
    assert sum(r["count"] for r in rounds) == 400
    assert sorted(h for part in attention.ROUNDS for h in part) == list(range(8))


def test_clusters_follow_what_stands_before():
    rows = np.array([[90, 5, 5], [900, 40, 60], [5, 90, 5], [40, 900, 60], [5, 5, 90], [50, 60, 900]])
    of = attention.clusters(np.repeat(rows, 5, 0), 3)
    assert len(set(of[:10])) == len(set(of[10:20])) == len(set(of[20:])) == 1 and len(set(of)) == 3


def test_every_id_has_its_own_row():
    for rows in (None, 40):
        vocab = attention.vocabulary(table([(i, 10_000 - i) for i in range(6000)], 6000, 10), rows=rows)
        assert (vocab.row == vocab.row[vocab.start]).sum() == 1 and vocab.pad == vocab.row.max() + 1
        assert len(set(vocab.row.tolist())) == (rows or 6002)


def test_ends_are_learned(spark):
    texts = ["red green blue"] * 6000
    vocab, flat = trained(spark, texts)
    before, after = attention.Model(vocab), attention.Model(vocab, flat)
    ids = np.frombuffer(attention.subwords(PATH).encode(texts[0]), "<u4").astype(np.int64)
    x, y, starts, _ = after.windows([ids])
    assert y[y >= 0].tolist() == [*ids, vocab.end]
    h = [hidden(m, x[starts[:1, None] + np.arange(m.window)])[m.overlap + len(ids)] @ m.p["o"] + m.p["b"] for m in (before, after)]
    end = [v[vocab.of[vocab.end]] - np.log(np.exp(v).sum()) for v in h]
    assert end[1] > end[0] and end[1] > math.log(0.5)


def test_table_of_frequent_words_is_bounded_by_bytes(spark):
    counts = spark.createDataFrame([(bytearray(b"a"), 100), (bytearray(b"b" * 50), 90), (bytearray(b"c" * 900), 10), (bytearray(b"d"), 1)], "word binary, c long")
    assert sorted(bytes(w)[:1] for w, _ in attention.frequent(counts, 10, 500)) == [b"a", b"b"]
    assert len(attention.frequent(counts, 10)) == 4 and len(attention.frequent(counts, 2)) == 2 and attention.frequent(counts, 10, 0) == []


def by_tokenizer(words):
    cut = attention.subwords(PATH)
    return [cut.tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_words_are_cut_together_as_the_tokenizer_cuts_them():
    cut, r = Subwords(PATH), random.Random(3)
    letters = ["etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzéüßñ'.,-!?0123456789", "aeé'sdtrvm½ªº²"]
    words = ["a" * 900, "the" * 300, "don't", "'s", "x.", "x's.", "..'ll", "1²½", "é", "ªa", "naïve—".removesuffix("—")]
    words += ["".join(r.choices(r.choice(letters), k=r.randint(1, 30))) for _ in range(5000)]
    assert cut.merges is not None and all(map(cut.plain, words))
    ids, n = cut.many(words)
    want = by_tokenizer(words)
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))
    cut.merges = None  # as without tiktoken
    assert [x.tolist() for x in cut.many(words)] == [ids.tolist(), n.tolist()]
    assert [len(x) for x in cut.many([])] == [0, 0]


def test_each_piece_is_joined_to_itself_only():
    """Joining any neighbours that make up a known piece, as tiktoken does, equals the listed pairs where each piece is what its own letters become."""
    model = json.loads(Subwords(PATH).tokenizer.to_str())["model"]
    rank = {tuple(p): i for i, p in enumerate(model["merges"])}
    for piece in model["vocab"]:
        parts = list(piece.removesuffix("</w>"))
        if piece.endswith("</w>"):
            parts[-1] += "</w>"
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [piece]


def test_a_word_is_cut_once_and_tables_are_bounded():
    cut, asked = Subwords(PATH), []
    many = cut.many
    cut.many = lambda words: asked.extend(words) or many(words)
    words = attention.Words(cut, [b"red", b"green"], most=5, most_bytes=1000)
    for text in ("red blue red", "blue green red blue", "green"):
        said = attention.words_of(text)
        ids, n = words.ids(words.of([said]))
        assert ids.tolist() == np.frombuffer(cut.encode(text), "<u4").tolist() and len(n) == len(said)
    assert sorted(asked) == ["blue", "green", "red"]
    for at in range(0, 60, 3):  # more others than it keeps, in number and then in bytes
        text = f"red w{at} W{at + 1} {'x' * 40 * at} green"
        ids, _ = words.ids(words.of([attention.words_of(text), []]))
        assert ids.tolist() == np.frombuffer(cut.encode(text), "<u4").tolist()
        assert len(words.numbers.words) <= 2 + 5 + 4


def test_ids_of_all_kinds_of_texts(spark):
    texts = ["Red  GREEN\tblue's", None, "", " \n", "J̌ T̈ red", "日本 red Red", "a<|endoftext|>b red", "É é Ünder red", "red\x00 x\x1cy", "İı"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, learned boolean").coalesce(1)
    got = {r.doc_id: r for r in attention.encode(docs, "learned", PATH, [(b"red", 7), (b"\xc3\x89", 1), (b"", 10)], 100, 10).collect()}
    cut = attention.subwords(PATH)
    for i, text in enumerate(texts):
        assert attention.numbers(got[i].ids, cut.size).tolist() == cut.tokenizer.encode(text or "", add_special_tokens=False).ids, text
        words = attention.words_of(text)
        logs = {b"red": math.log10(8 / 100), "É".encode(): math.log10(2 / 100)}
        assert (got[i].n, got[i].known) == (len(words) + 1, sum(w in logs for w in words) + 1)
        assert abs(got[i]["sum"] - sum(logs.get(w, 0) for w in words) - math.log10(11 / 100)) < 1e-9
        assert {bytes(x.word): x.n for x in got[i].rest} == Counter(w for w in words if w not in logs)
