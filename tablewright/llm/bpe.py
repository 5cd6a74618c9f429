"""Batched encoding with a tokenizers file, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

MOST_BYTES = 64 << 20  # of the table of known words
WORD_BYTES = 150  # of an entry beside its letters: dict slot, object head, number, ids
JOINED = 64  # words encoded as one text
TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")  # signs that end words
LAST_PLAIN = "\u0530"  # letters below have one lower-case form for all libraries


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(first - (ends - sizes), sizes)


class _Numbers(dict):
    """Numbers words as they are first asked for, and keeps the new ones in ``fresh``."""

    fresh: list[bytes]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """Encodes texts by their words; exact for tokenizers that lower case and drop white space.

    Such a tokenizer (white space runs become one blank, pieces are letters, single digits or signs)
    never joins characters across white space, so the ids of a text are those of its words in a row,
    whatever the case of A-Z. The file's normalizer, splitter and special tokens are looked at when it is
    loaded, and a probe is tried; where they are others, and for texts that hold a special token's sign in
    any case (the library takes it in its own case only), whole texts are encoded. Known words are kept up
    to ``MOST_BYTES``, then forgotten; ``forget`` drops them at the end of a task.
    """

    NORMALIZERS, SPLITTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

    PROBE = "Its THE rain's  12ab-c_d,\tÉcole ÜBER\n\"don't\" é <a> 漢字! X, garçon. \"so\"."

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # words of letters alone, already normal and lower: nothing to normalise, blanks are all there is to split at
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = [(self._head(t.content), t.content.lower()) for t in added]
        self.known = _Numbers()
        self._clear()
        words = self.PROBE.encode().lower().split()
        try:
            for w in words:
                self.known[w]
            self._learn()
            parts = [i for w in words for i in self._ids_of(w)]
        except ValueError:
            parts = None
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        self.by_words = self._kinds() and plain and parts == self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids
        self.forget()

    def _kinds(self) -> bool:
        file = json.loads(self.tokenizer.to_str())
        parts = [(file.get(k) or {}).get(many, []) for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        return [[x["type"] for x in p] for p in parts] == [self.NORMALIZERS, self.SPLITTERS]

    @staticmethod
    def _head(sign: str) -> str:
        """The signs before the first letter, which are the same in any case."""
        return sign[: next((i for i, c in enumerate(sign) if c.isalnum()), len(sign))]

    def forget(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.known.fresh, self.held = [], 0
        self.ids, self.limits = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids_of(self, word: bytes) -> list[int]:
        at = self.known[word]
        return self.ids[self.limits[at] : self.limits[at + 1]].tolist()

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of letters, encoded many at a time; the end-of-word pieces tell them apart."""
        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        encoded = [e.ids for e in self.letters.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, sum(map(len, encoded)))
        sizes = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
        if len(sizes) != len(words):
            raise ValueError("the tokenizer does not mark the ends of words")
        return ids, sizes

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes

    def _learn(self) -> None:
        """Encode the new words. A word is its letters and the signs after them, which are always pieces of their own, or is taken whole."""
        letters, others, heads, tails = {}, {"": 0}, [], []
        for raw in self.known.fresh:
            word = raw.decode()
            core = word.rstrip(TAIL)
            if core.isalpha() and (core.isascii() or (max(core) < LAST_PLAIN and core == core.lower() and is_normalized("NFC", core))):
                heads.append(letters.setdefault(core, len(letters)))
                tails.append(others.setdefault(word[len(core) :], len(others)))
            else:
                heads.append(-1 - others.setdefault(word, len(others)))
                tails.append(0)
        parts = [self._letters(list(letters)), self._others(list(others))]
        ids = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        first = np.cumsum(sizes) - sizes
        head, tail = np.array(heads, np.int64), np.array(tails, np.int64) + len(letters)
        head = np.where(head < 0, len(letters) - 1 - head, head)
        pairs = np.stack([head, tail], axis=1).ravel()
        self.held += sum(map(len, self.known.fresh)) + WORD_BYTES * len(self.known.fresh)
        self.known.fresh = []
        self.ids = np.concatenate([self.ids, ids[_runs(first[pairs], sizes[pairs])]])
        self.limits = np.concatenate([self.limits, self.limits[-1] + np.cumsum(sizes[head] + sizes[tail])])

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, and the number of words of each text."""
        split = [t.encode().lower().split() for t in texts]
        if self.held > MOST_BYTES:
            self._clear()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.known.fresh:
            self._learn()
        return places, counts

    def _whole(self, texts: list[str]) -> bool:
        return not self.by_words or any(head in t and sign in t.lower() for head, sign in self.special for t in texts)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        if self._whole(texts):
            return np.array([len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)], np.int64)
        places, words = self._places(texts)
        sizes = np.concatenate([[0], np.cumsum(np.diff(self.limits)[places])])
        return np.diff(sizes[np.concatenate([[0], np.cumsum(words)])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        if self._whole(texts):
            pieces = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            return np.fromiter(chain.from_iterable(pieces), np.uint32, int(sizes.sum())), sizes
        places, words = self._places(texts)
        size = np.diff(self.limits)[places]
        ids = self.ids[_runs(self.limits[places], size)]
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(words)])])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file, shared by the tasks that the worker runs."""
    return WordEncoder(path)
