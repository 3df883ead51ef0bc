"""Token ids of whole documents, with a memory of words that were met before.

The tokenizer drops white space, and no token or normalisation reaches across it, so a
text's ids are those of its words in turn. Each task tokenizes a word once, until its memory
is full and starts anew.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from logloom.llm.textkit import U64, Chunk

#: Words held in memory, and words tokenized in one call.
MEMORY, TOGETHER = 2_000_000, 500


def word_tokenizer(file: str | None = None):
    """The tokenizer in a file; by default the public word-end vocabulary of the installation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(file)


class WordTokens:
    """Ids of texts by way of their words; end is appended to every text."""

    def __init__(self, file: str | None = None, end: int = 1):
        self.tokenizer, self.end = word_tokenizer(file), end
        special = sorted((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word))
        self.mark, self.mark_id = special[0] if special else (None, None)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U64)  # hashes of the words held, sorted
        self.number = np.zeros(0, np.int64)  # and the words' numbers, from 1
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)  # where word i's ids begin; those of word i + 1 follow
        self.at[1] = 1
        self.ids[0] = self.end  # word 0 is the end

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, 0 for those not held."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.number[at], 0)

    def _add(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        """Hold words that are not held; returns their numbers."""
        flat, sizes = self._tokenize(words)
        n, used = len(self.known) + 1, int(self.at[len(self.known) + 1])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(words) >= len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.ids[used : used + len(flat)] = flat
        self.at[n + 1 : n + 1 + len(words)] = used + np.cumsum(sizes)
        place, new = np.searchsorted(self.known, hashes), np.arange(n, n + len(words))
        self.known, self.number = np.insert(self.known, place, hashes), np.insert(self.number, place, new)
        return new

    def _tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has.

        Many words go through one call, with a special token between them: the tokenizer cuts
        texts there before it does anything else.
        """
        if self.mark is None or any(self.mark in w for w in words):
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each])
        texts = [self.mark.join([*words[i : i + TOGETHER], ""]) for i in range(0, len(words), TOGETHER)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        marks = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.diff(marks, prepend=-1) - 1

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's texts one after the other, and where each begins (n + 1 entries)."""
        w = c.words()
        u, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(u) > MEMORY:
            self.forget()
        number = self._find(u)
        new = np.flatnonzero(number == 0)
        if len(new):
            raw = c.buf.tobytes()
            number[new] = self._add(u[new], [raw[w.starts[first[i]] : w.ends[first[i]]].decode() for i in new])
        # words of all texts, with word 0 after each text
        order = np.zeros(w.n + c.n, np.int64)
        order[np.arange(w.n) + w.doc] = number[back]
        start, size = self.at[order], self.at[order + 1] - self.at[order]
        begin = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.arange(begin[-1]) + np.repeat(start - begin[:-1], size)]
        return flat, begin[np.concatenate((w.first[:-1] + np.arange(c.n), [w.n + c.n]))]


@lru_cache(maxsize=2)
def shared(file: str | None = None, end: int = 1) -> WordTokens:
    """One memory for all tasks that a Python worker runs."""
    return WordTokens(file, end)
