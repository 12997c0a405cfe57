"""Whole-text encoding with a public tokenizer file, on executors, one word at a time.

The tokenizer of ``word_bpe_49k.json`` works on each white-space-separated word alone: it lower-cases,
splits a word into letter, digit and sign runs and codes each run by byte-pair merges. A word's ids thus
never depend on its neighbours, so a worker encodes every distinct word once and looks the rest up.
Words outside Latin-1, words with control characters and texts that hold the string of a special token
go to the library's own ``encode``.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import regex

#: Words that a worker holds in one generation, of which it keeps two: a bound on memory that never changes an id.
MAX_WORDS = 200_000

_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLANKS = re.compile(r"[ \t\n\r\x0b\x0c]+")
_ODD = re.compile(r"[^\x21-\x7e\xa1-\xac\xae-\xff]")  # in a word: what the short way does not take
#: Latin-1 characters that the short way does not take, white space apart.
_CONTROLS = bytes([*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA1), 0xAD])


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """The ids of words and of the runs in them, as bytes; what is not yet here comes from the generation before, or is coded."""

    def __init__(self, code, before: _Words | None = None):
        super().__init__()
        self.code = code
        self.before = before

    def __missing__(self, word: str) -> bytes:
        ids = None if self.before is None else self.before.get(word)
        if ids is None:
            ids = self.code(word)
        self[word] = ids
        return ids


class WordCoder:
    """Encodes texts to the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.tokenize = self.lib.model.tokenize
        self.letters = byte_letters()
        self.max_words = max_words
        #: Numbers that ids are held in: two bytes each if the vocabulary allows.
        self.kind = np.dtype("<u2" if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.array = "H" if self.kind.itemsize == 2 else "I"
        self.by_word = "ByteLevel" in str(self.lib.pre_tokenizer) and "Lowercase" in str(self.lib.normalizer)
        self.words = _Words(self._word)

    def _next_generation(self) -> None:
        self.words.before = None
        self.words = _Words(self._word, self.words)

    def _run(self, run: str) -> bytes:
        coded = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return array(self.array, [t.id for t in self.tokenize(coded)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._run(word)
            if word[-1] in ",." and word[:-1].isalpha():
                return self.words[word[:-1]] + self.words[word[-1]]
        if _ODD.search(word):
            return array(self.array, self.lib.encode(word, add_special_tokens=False).ids).tobytes()
        runs = _RUNS.findall(word)
        return self._run(word) if len(runs) == 1 else b"".join(map(self.words.__getitem__, runs))

    def _split(self, text: str) -> list[str]:
        """Words by ASCII white space, in lower case except those that the library is to code."""
        try:
            raw = text.encode("latin-1")
            if len(raw.translate(None, _CONTROLS)) == len(raw):
                return text.lower().split()
        except UnicodeEncodeError:
            pass
        return [w if _ODD.search(w) else w.lower() for w in _BLANKS.split(text) if w]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, as numbers of ``kind``; null counts as empty."""
        if not text:
            return np.empty(0, self.kind)
        if not self.by_word or any(s in text for s in self.specials):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind)
        if len(self.words) > self.max_words:
            self._next_generation()
        return np.frombuffer(b"".join(map(self.words.__getitem__, self._split(text))), self.kind)


_CODERS: dict[tuple[str, int], WordCoder] = {}


def coder(path: str, max_words: int = MAX_WORDS) -> WordCoder:
    """This worker's coder: a reused Python worker keeps it, with its words, from task to task."""
    if (path, max_words) not in _CODERS:
        _CODERS[path, max_words] = WordCoder(path, max_words)
    return _CODERS[path, max_words]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
