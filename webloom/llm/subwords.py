"""Ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np

#: White space on which the tokenizer never joins: its pre-tokenizer splits there too.
_chunks = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall
#: Latin text, on which NFC is the identity and lower case is the same everywhere, and which holds no special token.
_other = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ž]").search
_special = "<|"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: The tokenizer's pre-tokenizer, over Latin letters (L) and numbers (N).
_run = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")
_runs = _run.findall
#: What ends a run, where many are cut at once; plain words don't hold it.
_END = "\x01"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """Ids by piece: what is asked for first is learned, and kept while there is room for short pieces; a full table starts anew."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        self.learn, self.most = learn, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if len(piece) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Subwords:
    """Encodes word by word; ids of short words are kept, at most `most` of them, so memory is bounded.

    White space always divides. Words of Latin texts are divided here as the tokenizer's own rules do and go straight to
    its merges; those of all other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        # parts of words are kept too, as words come with many marks around them
        self.runs, self.words, self.chunks = _Kept(self._run, most), _Kept(self._word, most), _Kept(self._chunk, most)
        parts = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.latin = steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.latin and _special not in text and not _other(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return b"".join(map(self.chunks.__getitem__, _chunks(text)))

    def plain(self, text: str) -> bool:
        """Whether a text's words, in lower case, may go to many()."""
        return self.latin and _special not in text and not _other(text)

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain, lower-case words one after the other, and how many each has. Nothing is kept."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.merges is None:
            ids = [self._word(w) for w in words]
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids])
        # most words are letters, or letters and a mark
        runs = [w if w.isalpha() else f"{w[:-1]}{_END}{w[-1]}" if w[:-1].isalpha() else _END.join(_runs(w)) for w in words]
        ids = self.merges.encode_to_numpy(f"{_END} ".join(runs) + f"{_END} ", disallowed_special=())
        ends = ids == self.blank
        places = np.flatnonzero(ends)
        return ids[~ends], np.diff(places, prepend=-1) - 1

    @cached_property
    def merges(self):
        """The tokenizer's merges in tiktoken, or None where they would not be the same there.

        tiktoken joins whichever neighbours make up a known piece, the tokenizer only pairs that it lists. The two agree where each
        piece is made in one way, of pieces that are known before it, and the order of ids is the order of merges.
        The end of a word is a byte of its own that joins first.
        """
        try:
            import tiktoken
        except ImportError:
            return None
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        suffix = model.get("end_of_word_suffix")
        if not self.latin or not suffix or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return None
        made = [vocab[a + b] for a, b in pairs]
        single = [vocab.get(x) for x in self.letters] + [vocab.get(x + suffix) for x in self.letters]
        if None in single or any(a >= b for a, b in zip([max(single), *made], made)) or len(vocab) != len(made) + len(single) or any(max(vocab[a], vocab[b]) >= m for (a, b), m in zip(pairs, made)):
            return None
        byte = {x: i for i, x in enumerate(self.letters)}
        ranks = {}
        for piece, i in vocab.items():
            last = len(piece) > len(suffix) and piece.endswith(suffix)
            raw = bytes(map(byte.__getitem__, piece.removesuffix(suffix) if last else piece))
            if raw == _END.encode() or _END.encode() not in raw:
                if (raw := raw + _END.encode() * last) in ranks:
                    return None
                ranks[raw] = i
        return tiktoken.Encoding("merges", pat_str=f"[^{_END} ]+{_END}| ", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def blank(self) -> int:
        """The id of a blank alone, which no word holds."""
        return self.tokenizer.get_vocab()[self.letters[0x20]]

    def _word(self, word: str) -> bytes:
        runs = _runs(word)
        return self._run(word) if len(runs) == 1 else b"".join(map(self.runs.__getitem__, runs))

    def _run(self, run: str) -> bytes:
        text = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        return _pack([t.id for t in self.model.tokenize(text)])

    def _chunk(self, chunk: str) -> bytes:
        return _pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """The encoder of a tokenizer file: one for all tasks that a worker process runs, so that words seen before are known."""
    return Subwords(path)
