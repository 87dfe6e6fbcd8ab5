"""Texts as codes of distinct pieces, so that dear work is done once for each distinct piece.

A byte-level pre-tokenizer of the GPT-2 kind always starts a new match at a single space
between two characters that are not white space. Texts are cut there, and only there (but for a
space before NUL, the mark of a first piece): what a tokenizer makes of the pieces is then what it
makes of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space besides the plain space: what Latin texts hold, and the rest.
_LATIN_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
_OTHER_BLANK = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=[^\s\0])")
# Distinct pieces that one task remembers before it starts afresh; forgetting costs time, not results.
MEMORY = 250_000


def _every_space_cuts(text: str) -> bool:
    """Whether no space touches other white space, NUL or an end of the text (now and then a false no)."""
    if "  " in text or " \0" in text or text[:1].isspace() or text[-1:].isspace():
        return False
    for blank in _LATIN_BLANKS:
        if blank in text and (f" {blank}" in text or f"{blank} " in text):
            return False
    return text.isascii() or _OTHER_BLANK.search(text) is None


def _lines_cut(text: str) -> bool:
    """Whether every line end stands between characters that are no white space: it is then a match of its own."""
    return "\n" in text and "\n\n" not in text and not any(b in text for b in _LATIN_BLANKS if b != "\n") and _every_space_cuts(text) and _OTHER_BLANK.search(text) is None


def piece_text(piece: str) -> str:
    """What a piece stands for: a first piece is marked by NUL, a line's first word keeps the line end before it."""
    return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece


def cut(text: str) -> list[str]:
    """The pieces of a text; all but the first stand for a space and what follows."""
    return text.split(" ") if _every_space_cuts(text) else _SAFE_SPACE.split(text)


# Characters that are no characters: one that no text of a batch holds stands for spaces not to be cut at.
_STAND_INS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def pieces(texts: list[str], words: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(places in the list of distinct pieces, that list, where each text begins) of a batch.

    With `words` a text gives its runs between plain blanks, for tokenizers that drop white space; other
    white space stays inside a run. Else a text gives the pieces described above: the first is marked
    by a leading NUL, and all others stand for a space and what follows.
    """
    if words:
        texts = [x.replace("\n", " ").replace("\t", " ") for x in texts]
    else:
        unsafe = [i for i, x in enumerate(texts) if not _every_space_cuts(x)]
        stand_in = next((c for c in _STAND_INS if not any(c in x for x in texts)), None)
        if stand_in is None:
            parts = [["\0" + x if k == 0 else x for k, x in enumerate(cut(text))] for text in texts]
            flat = pa.array([x for part in parts for x in part], pa.large_string()).dictionary_encode()
            return flat.indices.to_numpy(), flat.dictionary.to_pylist(), np.cumsum([0, *map(len, parts)])
        texts = ["\0" + (x.replace("\n", " \n") if _lines_cut(x) else x) for x in texts]
        for i in unsafe:
            parts = _SAFE_SPACE.split(texts[i][1:])
            texts[i] = "\0" + " ".join([x.replace(" ", stand_in) for x in parts])
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = lists.values.dictionary_encode()
    places, starts = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    names = coded.dictionary.to_pylist()
    if words:
        if "" not in names:
            return places, names, starts
        empty = names.index("")
        keep = places != empty
        held = np.concatenate([[0], np.cumsum(keep)])
        return np.where(places > empty, places - 1, places)[keep], names[:empty] + names[empty + 1 :], held[starts]
    if unsafe:
        names = [x.replace(stand_in, " ") if stand_in in x else x for x in names]
    return places, names, starts


class Coder:
    """Codes of pieces in the order of first sight; `learn` is told each new piece once."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], words: bool = False, memory: int = MEMORY) -> None:
        self.learn, self.forget, self.words, self.memory = learn, forget, words, memory
        self.codes: dict[str, int] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' codes one after the other, and where each text's codes begin (one more at the end)."""
        if len(self.codes) > self.memory:
            self.codes = {}
            self.forget()
        places, names, starts = pieces(texts, self.words)
        get = self.codes.get
        codes = np.fromiter([get(x, -1) for x in names], np.int64, len(names))
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            fresh = list(dict.fromkeys([names[k] for k in unknown.tolist()]))
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
            self.learn(fresh)
            codes[unknown] = [self.codes[names[k]] for k in unknown.tolist()]
        return codes[places], starts


class Ragged:
    """Rows of unequal length in one growing buffer."""

    def __init__(self, kind: type = np.int32) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.pool = np.zeros(1 << 16, self.kind)
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = self.rows = 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(values) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.rows + len(sizes) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.pool[self.used : self.used + len(values)] = values
        self.begin[self.rows : self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.rows : self.rows + len(sizes)] = sizes
        self.used += len(values)
        self.rows += len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the given rows one after the other, and each row's size."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.begin[rows] - (ends - sizes), sizes) + np.arange(total)
        return self.pool[at], sizes


def text_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the codes' values over each text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]
