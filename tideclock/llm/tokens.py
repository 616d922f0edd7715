"""Token ids of whole texts, with a memory of the words already encoded.

The public word-level vocabulary never joins characters over a blank, so the
ids of a text are those of its blank-separated words in order. Each Python
worker remembers the ids of words it has met, up to a bound, and sends only
new words to the tokenizer.
"""

from __future__ import annotations

from itertools import chain
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tideclock.llm import worker

END_ID = 1
#: Words, and pieces of words, that a worker remembers before it starts afresh.
MEMORY_WORDS = 400_000

# Fixed values of the public vocabulary: how its file normalizes and splits texts.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The same rule for words of printable ASCII and Latin-1 letters, which NFC leaves alone.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """word -> number; unknown words get the next number and wait in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()


class Encoder:
    """Encodes lists of texts with one tokenizer file.

    Words of common characters are split here, by the file's own rule, and
    their pieces go to the file's model; all other words, all texts that hold
    an added token of the file, and all texts of files with other rules, go
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        normalizers = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.added = [t["content"].lower() for t in rules["added_tokens"]]
        self.by_word = normalizers == NORMALIZERS and splits[:1] == [SPLIT]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are remembered here
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)

    def _learn(self) -> None:
        new, known = self.words.new, len(self.words) - len(self.words.new)
        if not new:
            return
        self.words.new = []
        got: list = [None] * len(new)
        rare, pieces, tokenize = [], self.pieces, self.model.tokenize
        for i, word in enumerate(new):
            if word.isascii():
                if word.isalpha():  # a piece by itself
                    got[i] = [t.id for t in tokenize(word)]
                    continue
                if not word.isprintable():
                    rare.append(i)
                    continue
            elif not _SIMPLE(word):
                rare.append(i)
                continue
            ids = []
            for piece in _SPLIT(word.lower()):
                known_ids = pieces.get(piece)
                if known_ids is None:
                    n = self.words.get(piece, known)
                    if n < known:
                        known_ids = self.ids[self.starts[n] : self.starts[n] + self.lengths[n]].tolist()
                    else:
                        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
                        known_ids = pieces[piece] = tuple(t.id for t in tokenize(letters))
                ids += known_ids
            got[i] = ids
        for i, x in zip(rare, self.tokenizer.encode_batch_fast([new[i] for i in rare], add_special_tokens=False), strict=True):
            got[i] = x.ids
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(new) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=total)
        self.lengths[known : known + len(new)] = lengths
        self.starts[known : known + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has.

        Arrow splits the texts and numbers the words among them, so that only
        the different words of a call are looked up here. A-Z are folded first,
        as the tokenizer would; other letters are left to it.
        """
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if not self.by_word:
            return self._whole(texts)
        if len(self.words) + len(self.pieces) > MEMORY_WORDS:
            self._forget()
        folded = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        odd = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            odd |= pc.match_substring(folded, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_word(folded)
        # Texts with added tokens are few: they are encoded apart and put back in their places.
        parts = {True: self._whole(texts.filter(pa.array(odd))), False: self._by_word(folded.filter(pa.array(~odd)))}
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[odd], counts[~odd] = parts[True][1], parts[False][1]
        ids, from_odd = np.zeros(int(counts.sum()), dtype=np.uint32), np.repeat(odd, counts)
        ids[from_odd], ids[~from_odd] = parts[True][0], parts[False][0]
        return ids, counts

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.array([len(ids) for ids in got], dtype=np.int64)

    def _by_word(self, folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(folded):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        split = pc.split_pattern(folded, " ")
        numbered = split.flatten().dictionary_encode()
        known = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        numbers = np.fromiter(map(self.words.__getitem__, known), dtype=np.int64, count=len(known))[numbered.indices.to_numpy()]
        self._learn()
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        where = np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
        bounds = np.cumsum(pc.list_value_length(split).to_numpy())
        return self.ids[where], np.diff(np.concatenate([[0], ends[bounds - 1]]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    worker.claim("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs(texts: pa.Array, size: int = 1 << 22) -> list[slice]:
    """Slices of the array with about ``size`` bytes each, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out, first = [], 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        out.append(slice(first, last))
        first = last
    return out


def documents(texts: pa.Array, path: str):
    """The ids of each text with the end id, as arrays, text by text; null texts are empty."""
    end = np.array([END_ID], dtype=np.uint32)
    texts = pc.fill_null(texts, "")
    for part in runs(texts):
        ids, counts = encoder(path).encode(texts[part])
        at = 0
        for n in counts.tolist():
            yield np.concatenate([ids[at : at + n], end])
            at += n
