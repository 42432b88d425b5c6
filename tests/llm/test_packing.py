import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webloom.llm import packing
from webloom.llm.subwords import Subwords

from .data import empty, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def packed(bins, documents):
    return [x for i, n in enumerate(documents) for x in bins.add(i, np.full(n, i, "<u4").tobytes())] + list(bins.rest())


@given(st.lists(st.integers(1, 300), max_size=80), st.sampled_from([16, 64, 128]))
def test_bins_cover_documents_without_padding(documents, capacity):
    bins = packing.Bins(capacity, classes=5)
    got, filled, at = packed(bins, documents), {}, {}
    for sequence, offset, (key, start, ids) in got:
        assert filled.get(sequence, 0) == offset and ids == np.full(len(ids) // 4, key, "<u4").tobytes() and ids
        filled[sequence] = offset + len(ids) // 4
    for _, _, (key, start, ids) in sorted(got, key=lambda x: x[2][:2]):
        assert at.get(key, 0) == start
        at[key] = start + len(ids) // 4
    assert at == dict(enumerate(documents))
    assert all(n == capacity or n & (n - 1) == 0 for n in filled.values())
    assert sum(n < capacity for n in filled.values()) <= capacity.bit_length()


def test_bins_take_a_fixed_count_of_their_class():
    # 2048 // 600 = 3 in each bin; the next document's head fills what is left
    bins = packing.Bins(2048)
    got = packed(bins, [600, 600, 600, 700])
    first = [(key, start, len(ids) // 4) for sequence, _, (key, start, ids) in got if sequence == 0]
    assert first == [(0, 0, 600), (1, 0, 600), (2, 0, 600), (3, 0, 248)]


def test_few_documents_are_cut():
    r = random.Random(2)
    documents = [r.randrange(1, 6000) for _ in range(3000)]
    got = packed(packing.Bins(2048), documents)
    assert len(got) < 2 * len(documents) + sum(documents) // 2048


def test_ids_are_the_tokenizers():
    tokenizer, subwords, r = Tokenizer.from_file(PATH), Subwords(PATH, most=50), random.Random(1)
    letters = [chr(c) for c in range(0x2FF)] + list(" \n'stremld  ") * 20 + ["é", "中", "🙂", "<|endoftext|>", "　", "ſ", "ﬁ", "Σ", "İ", "́"] * 3
    for k in range(3000):
        text = "".join(r.choice(letters[: 127 if k % 2 else None]) for _ in range(r.randrange(40)))
        assert np.frombuffer(subwords.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    docs = frame(spark).repartition(3)
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH).collect()
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in got) == want
    ids = tokenizer.encode(docs.filter("doc_id = 10").first().text, add_special_tokens=False).ids + [1]
    at = 0
    for r in sorted((r for r in got if r.doc_id == 10), key=lambda r: r.start):
        assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
        at += r.length
    assert at == len(ids)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    assert [(r.start, r.length) for r in got if r.doc_id == 5] == [(0, 1)]
    assert packing.pack(empty(spark), PATH).count() == 0
