"""Token ids of whole texts by a public BPE file whose pre-tokenizer never crosses white space.

The ids of a text are then those of its white-space-separated words, one after the other, so each different word is
encoded once in a batch of others and looked up afterwards.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

from .common import remembered

#: Words whose pre-tokens are plain: Latin-1 letters, then perhaps one of MARKS, a pre-token of its own.
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+[.,]?")
MARKS = ".,"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]|<\|")
_END_OF_WORD = "</w>"


class _Numbers(dict):
    """Key to number; new keys get the next one and wait in `new`."""

    def __init__(self, keys=()):
        super().__init__((k, i) for i, k in enumerate(keys))
        self.new: list = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class _Ragged:
    """Lists of ids behind numbers."""

    def __init__(self, ids=(), sizes=()):
        self.ids, self.sizes = np.array(ids, np.uint32), np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def take(self, numbers: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbers in turn, where each ends); each takes `more` further ids of any value."""
        sizes = self.sizes[numbers] + more
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[np.minimum(at, len(self.ids) - 1)] if len(at) else np.zeros(0, np.uint32), ends


class WordEncoder:
    """encode(texts) -> (ids of all texts, number of ids of each).

    Remembers words, of which those met but once or twice are dropped when there are more than `most_words`.
    """

    def __init__(self, path: str, most_words: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_END_OF_WORD)]] = True
        self.marks = [self._each([m])[0] for m in MARKS]
        self.most_words = most_words
        self.words, self.of_words, self.uses = _Numbers(), _Ragged(), np.zeros(0, np.int64)
        self.stems, self.of_stems = _Numbers(), _Ragged()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.most_words:
            self._drop_rare()
        number, found, counts = self.words.__getitem__, [], []
        for text in texts:
            # bytes: A-Z and the six ASCII white-space characters only; marks of special tokens depend on case
            words = (text if b"<|" in text else text.lower()).split()
            counts.append(len(words))
            found.extend(map(number, words))
        self._learn()
        at = np.array(found, np.int64)
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, ends = self.of_words.take(at)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, np.diff(edges)

    def _drop_rare(self) -> None:
        kept = np.flatnonzero(self.uses > 2)
        if len(kept) > self.most_words // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most_words // 2]])
        keys = list(self.words)
        ids, ends = self.of_words.take(kept)
        self.words, self.of_words, self.uses = _Numbers(keys[k] for k in kept.tolist()), _Ragged(ids, np.diff(ends, prepend=0)), self.uses[kept]
        self.stems, self.of_stems = _Numbers(), _Ragged()

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        if not new:
            return
        stem_of, marks = [], np.full(len(new), -1, np.int64)
        number, plain = self.stems.__getitem__, _PLAIN.fullmatch
        for i, word in enumerate(new):
            text = word.decode("utf-8", "replace")
            if text[-1] in MARKS and len(text) > 1 and plain(text):
                marks[i], text = MARKS.index(text[-1]), text[:-1]
            stem_of.append(number(text))
        stems, self.stems.new = self.stems.new, []
        if stems:
            self.of_stems.add(*self._encode_words(stems))
        full = len(self.stems) > self.most_words
        marked = marks >= 0
        ids, ends = self.of_stems.take(np.array(stem_of, np.int64), marked.astype(np.int64))
        ids[ends[marked] - 1] = np.array(self.marks, np.uint32)[marks[marked]]
        self.of_words.add(ids, np.diff(ends, prepend=0))
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        if full:
            self.stems, self.of_stems = _Numbers(), _Ragged()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words with a sure number of pre-tokens go together, in one text; each pre-token ends in one end-of-word id."""
        parts = [self._pre_tokens(w) for w in words]
        alone, order, pieces, all_sizes = [i for i, n in enumerate(parts) if not n], [], [], []
        sure = [i for i, n in enumerate(parts) if n]
        for at in range(0, len(sure), 4096):
            group = sure[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in group])], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            ends = np.cumsum([parts[i] for i in group])
            if len(last) != ends[-1]:  # not as expected: each by itself
                alone += group
                continue
            order += group
            pieces.append(ids)
            all_sizes.append(np.diff(last[ends - 1], prepend=0))
        own = [np.array(x, np.uint32) for x in self._each([words[i] for i in alone], True)]
        made = _Ragged(np.concatenate([*pieces, *own]), np.concatenate([*all_sizes, np.array([len(x) for x in own], np.int64)]).astype(np.int64))
        back = np.empty(len(words), np.int64)
        back[np.array(order + alone, np.int64)] = np.arange(len(words))
        ids, ends = made.take(back)
        return ids, np.diff(ends, prepend=0)

    def _each(self, words: list[str], many: bool = False) -> list:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []
        return found if many else [x[0] for x in found]

    @staticmethod
    def _pre_tokens(word: str) -> int:
        """Their number, or 0 where that needs the tokenizer itself."""
        if _PLAIN.fullmatch(word):
            return 1 + (word[-1] in MARKS)
        if word.isascii() and not _ODD.search(word):
            return len(_ASCII.findall(word.lower()))
        return 0


def encoder(path: str) -> WordEncoder:
    """The encoder of this process: tasks that one Python worker runs in turn share what it remembers."""
    if ("encoder", path) not in remembered:
        remembered.clear()
        remembered["encoder", path] = WordEncoder(path)
    return remembered["encoder", path]
