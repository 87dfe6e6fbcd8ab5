"""Ids of whole texts as the tokenizers library gives them, each distinct word encoded once."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cardloom.llm.pieces import Coder, Ragged, piece_text

# Words that one Python worker remembers over its tasks; forgetting costs time, not results.
WORKER_WORDS = 300_000
# Pieces that are learned, and laid out, at a time: what they take in between is given back sooner.
LEARNED = 1 << 15
LAID_OUT = 1 << 18
# Between a letter or digit and one of these a match of either pre-tokenizer always ends.
_TAIL = "!#$%&()*+,-./:;?"
# ... if that letter stays one letter when case and composition are normalised.
_HEAD_END = "[a-zA-Z0-9À-ÖØ-öø-ÿ]\\z"


_LATIN = re.compile(" ?[a-zA-ZÀ-ÖØ-öø-ÿ]+")
# How byte-level models write the bytes that are no printable characters.
_UNPRINTED = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


def _byte_text(word: str) -> str:
    if word.isascii():
        return "\u0120" + word[1:] if word[0] == " " else word
    return word.encode().decode("latin-1").translate(_UNPRINTED)


class _Words:
    """The library's ids of words without context, kept by a worker over its tasks."""

    def __init__(self, path: str, spaced: bool) -> None:
        from tokenizers import Tokenizer

        self.spaced = spaced  # whether a match takes the space before it

        self.tokenizer = Tokenizer.from_file(path)
        self.rows: dict[str, int] = {}
        self.ids = Ragged(np.int32)
        # Which tokens begin with a space, as byte-level models write it.
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == "\u0120"]] = True

    def _add(self, words: list[str], found: list[list[int]]) -> None:
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.ids.extend(np.array(list(chain.from_iterable(found)), np.int32), np.array(list(map(len, found)), np.int64))

    def _add_spaced(self, words: list[str]) -> None:
        """Words of Latin letters, each after its space, encoded as the one text they make together.

        Each is a match of its own, and only its first token begins with the space: there the ids are cut.
        """
        texts = ["".join(words[at : at + 1024]) for at in range(0, len(words), 1024)]
        flat = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(flat), np.int32, sum(map(len, flat)))
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(words):
            raise ValueError("a tokenizer that does not cut before each space")
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.ids.extend(ids, np.diff(np.append(starts, len(ids))))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The words' rows in `ids`."""
        if len(self.rows) > WORKER_WORDS:
            self.rows, self.ids = {}, Ragged(np.int32)
        fresh = [x for x in words if x not in self.rows]
        # A run of Latin letters is one match of the pre-tokenizer: no other match reaches into it.
        plain = _LATIN.fullmatch
        latin = [x for x in fresh if plain(x) and (self.spaced or x[0] != " ")]
        if self.spaced:
            lone = [x for x in latin if x[0] != " "]
            self._add_spaced([x for x in latin if x[0] == " "])
        else:
            lone = latin
        # The library's model takes such a run as it is.
        model = self.tokenizer.model.tokenize
        self._add(lone, [[x.id for x in model(_byte_text(word if self.spaced else word.lower()))] for word in lone])
        rest = [x for x in fresh if x not in self.rows]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            self._add(part, [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        return np.array([self.rows[x] for x in words], np.int64)


@cache
def _words(path: str, spaced: bool) -> _Words:
    return _Words(path, spaced)


class LibraryIds:
    """An encoder for one task. `words` says that the tokenizer drops white space and lowers case."""

    def __init__(self, path: str, words: bool) -> None:
        self.known, self.words = _words(path, not words), words
        self.ids = Ragged(np.int32)
        self.coder = Coder(self._learn, self.ids.clear, words)

    def _learn(self, fresh: list[str]) -> None:
        for at in range(0, len(fresh), LEARNED):
            self._learn_some(fresh[at : at + LEARNED])

    def _learn_some(self, fresh: list[str]) -> None:
        lines: list[int] = []
        if not self.words:
            lines = [k for k, x in enumerate(fresh) if x[:1] == "\n" and len(x) > 1]
            # `piece_text` of each, without a call.
            fresh = [" " + x if x and x[0] not in "\0\n" else piece_text(x) for x in fresh]
            for k in lines:  # the line end is a match of its own
                fresh[k] = fresh[k][1:]
        whole = pa.array(fresh, pa.large_string())
        core = pc.utf8_rtrim(whole, _TAIL)
        split = pc.and_(pc.less(pc.binary_length(core), pc.binary_length(whole)), pc.match_substring_regex(core, _HEAD_END))
        core = pc.if_else(split, core, whole)
        if self.words:
            # ASCII letters lower one for one, which the tokenizer would do itself; special strings are left alone.
            core = pc.if_else(pc.match_substring(core, "<|"), core, pc.ascii_lower(core))
        tails = np.flatnonzero(split.to_numpy(zero_copy_only=False))
        ends = pc.utf8_length(core).to_numpy()[tails]
        words = pa.concat_arrays([pa.array(["\n"] * len(lines), pa.large_string()), core, pa.array([fresh[k][n:] for k, n in zip(tails.tolist(), ends.tolist())], pa.large_string())])
        coded = words.dictionary_encode()
        rows = self.known.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        # Each piece's line end if it has one, its word, then its tail if it has one.
        piece = np.concatenate([np.array(lines, np.int64), np.arange(len(fresh)), tails])
        order = np.argsort(piece, kind="stable")
        flat, sizes = self.known.ids.take(rows[order])
        self.ids.extend(flat, np.bincount(piece[order], weights=sizes, minlength=len(fresh)).astype(np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin (one more at the end)."""
        codes, starts = self.coder.encode(texts)
        ends = np.concatenate([[0], np.cumsum(self.ids.size[codes])])
        flat = np.empty(ends[-1], np.int32)
        for at in range(0, len(codes), LAID_OUT):
            some = codes[at : at + LAID_OUT]
            flat[ends[at] : ends[at + len(some)]] = self.ids.take(some)[0]
        return flat, ends[starts]


def with_end(flat: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more id after each text."""
    return np.insert(flat, starts[1:], end), starts + np.arange(len(starts))
