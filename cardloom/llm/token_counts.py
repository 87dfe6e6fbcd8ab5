"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

The transducer reads characters and its transitions carry the number of tokens they emit. A state
holds where the pre-tokenizer stands and, inside a match, what byte-pair encoding may still change:
the longest suffix that some token continues, the last token at each place in it, and the counts
there relative to now. A byte's transition takes the one token that ends there and may follow the
token before it, so its count is that place's count plus one. Both are finite; states and
transitions are compiled when first needed and kept.

Texts are cut into chunks before single spaces between other characters. There every state moves to
the same one, so a chunk's state map is one count whatever state it is entered in; maps are worked
out once for each distinct chunk and compose by addition: one prefix scan over all chunks of a batch
gives every text's count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ready, text_of
from cardloom.llm.pieces import Coder, Ragged, piece_text, text_sums

WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))
# Compiled transitions that a worker keeps before it starts afresh; that costs time, not results.
MOST_TRANSITIONS = 1_200_000


@cache
def byte_letters() -> dict[str, int]:
    """The printable characters by which vocabulary files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + k)] = b
    return letters


def read_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], set[bytes], list[str]]:
    """Merge ranks, all tokens' bytes, and the special strings of a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters = byte_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    special = [x["content"] for x in data["added_tokens"]]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in data["model"]["merges"]]
    merges = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
    return merges, {raw(t) for t in data["model"]["vocab"] if t not in special}, special


def kind_of(char: str) -> str:
    if char in WHITE:
        return "S"
    category = unicodedata.category(char)[0]
    return category if category in "LN" else "O"


class Transducer:
    """States are numbers; `moves[state][char]` is (next state, tokens emitted), `ends[state]` what a text's end emits."""

    def __init__(self, path: str) -> None:
        self.merges, self.tokens, self.special = read_merges(path)
        self.begins = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.longest = max(map(len, self.tokens))
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.compiled = 0
        self.byte_states: dict[tuple, int] = {}
        self.byte_keys: list[tuple] = []
        self.byte_moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.empty = self._byte_state((b"", (b"",), (0,)))
        self.names: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.ends: list[int] = []
        self.start = self._state(("-", self.empty, ""))

    # --- byte-pair encoding --------------------------------------------------

    def _merged(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.merges.get(pair, len(self.merges)), i) for i, pair in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == len(self.merges):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        found = self.follows.get((before, token))
        if found is None:
            if len(self.follows) > 1_000_000:
                self.follows = {}
            found = self._merged(before + token) == ([before, token] if before else [token])
            self.follows[before, token] = found
        return found

    def _byte_state(self, key: tuple) -> int:
        if key not in self.byte_states:
            self.byte_states[key] = len(self.byte_keys)
            self.byte_keys.append(key)
        return self.byte_states[key]

    def _byte_step(self, state: int, byte: int) -> tuple[int, int]:
        """A state's key: the open suffix, and at each place from its start to now the last token and the relative count."""
        found = self.byte_moves.get((state, byte))
        if found is not None:
            return found
        suffix, lasts, counts = self.byte_keys[state]
        suffix += bytes([byte])
        for i in range(len(suffix)):  # from the longest candidate on
            token = suffix[i:]
            if lasts[i] is not None and token in self.tokens and self._may_follow(lasts[i], token):
                emitted = counts[i] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        lasts, counts = (*lasts, token), (*(c - emitted for c in counts), 0)
        # Only places from which some token may still come matter to what follows.
        open_ = [i == len(suffix) or suffix[i:] in self.begins for i in range(len(suffix) + 1)]
        keep = open_.index(True)
        places = range(keep, len(suffix) + 1)
        key = suffix[keep:], tuple(lasts[i] if open_[i] else None for i in places), tuple(counts[i] if open_[i] else 0 for i in places)
        found = self._byte_state(key), emitted
        self.byte_moves[state, byte] = found
        self.compiled += 1
        return found

    def _read(self, state: int, text: str) -> tuple[int, int]:
        emitted = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            state, n = self._byte_step(state, byte)
            emitted += n
        return state, emitted

    # --- the pre-tokenizer around it --------------------------------------------

    def _state(self, key: tuple) -> int:
        """(mode, byte state, held text). Modes: - none, L N O in a run, P a space, S a run of white space whose last
        character is held, ' an apostrophe that may begin a contraction (with the letter after it)."""
        if key not in self.names:
            self.names[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            mode, state, held = key
            # What is held is read at the end: white space joins its run, a broken-off contraction is its parts.
            if mode == "'":
                n = self._read(self.empty, held[0])[1] + (self._read(self.empty, held[1:])[1] if held[1:] else 0)
            else:
                n = self._read(state, held)[1] if held else 0
            self.ends.append(n)
        return self.names[key]

    def _begin(self, char: str, kind: str, lead: str = "") -> tuple[tuple, int]:
        """A new match that begins with the character, after a space that belongs to it."""
        if kind == "S":
            return ("S", self.empty, char), 0
        if char == "'" and not lead:
            return ("'", self.empty, char), 0
        state, n = self._read(self.empty, lead + char)
        return (kind, state, ""), n

    def _compile(self, at: int, char: str) -> tuple[int, int]:
        mode, state, held = self.keys[at]
        kind = kind_of(char)
        emitted = 0
        if mode == "'":
            both = held[1:] + char
            if both in ("s", "t", "m", "d", "re", "ve", "ll"):
                key, emitted = ("-", self.empty, ""), self._read(self.empty, "'" + both)[1]
            elif both in ("r", "v", "l"):
                key = ("'", self.empty, "'" + both)
            elif held == "'" and kind == "O":
                state, emitted = self._read(self.empty, "'" + char)
                key = ("O", state, "")
            else:
                emitted = self._read(self.empty, "'")[1]
                if len(held) == 2:  # the letter after the apostrophe begins a run of letters
                    state, n = self._read(self.empty, held[1])
                    emitted += n
                    if kind == "L":
                        state, n = self._read(state, char)
                        key, emitted = ("L", state, ""), emitted + n
                    else:
                        key, n = self._begin(char, kind)
                        emitted += n
                else:
                    key, n = self._begin(char, kind)
                    emitted += n
        elif mode == "S":
            if kind == "S":
                state, emitted = self._read(state, held)
                key = ("S", state, char)
            elif held == " ":
                key, emitted = self._begin(char, kind, " ")
            else:
                emitted = self._read(self.empty, held)[1]
                key, n = self._begin(char, kind)
                emitted += n
        elif mode == kind and mode in "LNO":
            state, emitted = self._read(state, char)
            key = (mode, state, "")
        else:
            key, emitted = self._begin(char, kind)
        self.compiled += 1
        move = self._state(key), emitted
        self.moves[at][char] = move
        return move

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it count as one each."""
        for string in self.special:
            if string in text:
                parts = text.split(string)
                return len(parts) - 1 + sum(map(self.count, parts))
        state, total, moves = self.start, 0, self.moves
        for char in text:
            move = moves[state].get(char)
            if move is None:
                move = self._compile(state, char)
            state, emitted = move
            total += emitted
        return total + self.ends[state]


@cache
def transducer(path: str) -> Transducer:
    """One for each Python worker, which keeps what it has compiled over its tasks."""
    return Transducer(path)


def count_texts(tokenizer: str) -> Callable[[list[str]], np.ndarray]:
    """A function of texts that gives their numbers of tokens; each distinct piece is read once."""
    machine, known = transducer(tokenizer), Ragged(np.int64)

    def learn(fresh: list[str]) -> None:
        if machine.compiled > MOST_TRANSITIONS:
            machine.clear()
        n = [machine.count(piece_text(x)) for x in fresh]
        known.extend(np.array(n, np.int64), np.ones(len(n), np.int64))

    coder = Coder(learn, known.clear)

    def count(texts: list[str]) -> np.ndarray:
        codes, starts = coder.encode(texts)
        return text_sums(known.take(codes)[0], starts)

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every whole text.

    A NULL or empty text has no tokens. Repeated rows give repeated rows; other columns play no part;
    an empty table gives no rows. Nothing is shuffled.
    """
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = count_texts(tokenizer)
        for batch in batches:
            n = counted(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
