"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Texts are cut into distinct pieces and those into matches of the pattern. For each distinct match
the recursion holds one row for each token and its position; every step joins neighbouring rows with
the merge table and contracts each match's leftmost pair of smallest rank, until no pair is left.
A recursion of many steps is cut into several, so that a match of any length fits. Decoding joins the ids with the tokens' bytes and puts them together by an ordered aggregation.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ready, text_of
from cardloom.llm.pieces import Coder, piece_text

# Matches that one recursive query works on, by number and by bytes, and the rows that all its steps may
# hold together: these bound its memory. What is not done after that many rows goes on in a further query.
MATCHES = 20_000
MATCH_BYTES = 400_000
STEP_ROWS = 3_000_000

# Words that one Python worker remembers over its tasks; forgetting costs time, not results.
WORKER_WORDS = 600_000

# `after` is the place of the next token of the word. A step joins neighbours with the merge table, finds
# each word's smallest (rank, place), writes the new token there and drops the pair's second; words
# without a pair end. Each word's last step is its state, open if the steps allowed are used up.
ENCODE = """
CREATE OR REPLACE TABLE state AS
WITH RECURSIVE step(n, word, place, id, after) AS (
    SELECT 0, word, place, id, after FROM letters
    UNION ALL
    (
        WITH token AS MATERIALIZED (SELECT * FROM step WHERE n < {steps}),
        pair AS (
            SELECT a.word, (m.id << 32) + a.place AS key, b.place AS gone, b.after
            FROM token a
            JOIN token b ON a.word = b.word AND a.after = b.place
            JOIN merges m ON a.id = m.lhs AND b.id = m.rhs
        ),
        best AS (
            SELECT word, min(key) AS key, arg_min(gone, key) AS gone, arg_min(after, key) AS after FROM pair GROUP BY word
        )
        SELECT n + 1, word, place,
            CASE WHEN place = key & 4294967295 THEN key >> 32 ELSE id END,
            CASE WHEN place = key & 4294967295 THEN best.after ELSE token.after END
        FROM token JOIN best USING (word)
        WHERE place <> gone
    )
),
last AS (SELECT word, max(n) AS n FROM step GROUP BY word)
SELECT word, place, id, after, n = {steps} AS open FROM step JOIN last USING (word, n)
"""

DECODE = """
SELECT list(id ORDER BY place) AS ids, unhex(string_agg(hex, '' ORDER BY place)) AS decoded
FROM done JOIN tokens USING (id) JOIN owners USING (word)
GROUP BY owner
ORDER BY owner
"""


class SqlBpe:
    """Encodes and decodes matches in one in-memory DuckDB connection of one Python worker."""

    def __init__(self, ranks_path: str) -> None:
        import duckdb

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.ranks = ranks
        self.known: dict[str, tuple[str, bytes, int]] = {}
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, new = (pa.array(x, pa.int64()) for x in zip(*pairs))
        self._table("merges", lhs=left, rhs=right, id=new)
        self._table("tokens", id=pa.array(ranks.values(), pa.int64()), hex=pa.array([t.hex() for t in ranks], pa.string()))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Neighbouring bytes that no token holds: no merge ever reaches over them.
        self.meets = np.zeros((256, 256), bool)
        for token in ranks:
            for pair in zip(token, token[1:]):
                self.meets[pair] = True

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def encode(self, words: list[bytes]) -> tuple[list[list[int]], list[bytes]]:
        """Ids and decoded bytes of each word. A word that is a token as a whole is that token.

        Words are cut where two bytes meet that no token holds together; the parts take part in the
        recursion as words of their own.
        """
        known = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        # A whole token takes part as one letter of the recursion's start, and decodes like all others.
        rows = np.where(known >= 0, 1, np.fromiter(map(len, words), np.int64, len(words)))
        owner = np.repeat(np.arange(len(words)), rows)
        place = np.arange(len(owner))
        letter = np.frombuffer(b"".join(w if k < 0 else b"\0" for w, k in zip(words, known.tolist())), np.uint8)
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | ~self.meets[letter[:-1], letter[1:]]
        word = np.cumsum(first)
        single = known[owner]
        self._table("letters", word=word, place=place, id=np.where(single >= 0, single, self.byte_ids[letter]), after=place + 1)
        self._table("owners", word=word[first], owner=owner[first])
        self.con.execute("CREATE OR REPLACE TABLE done (word BIGINT, place BIGINT, id BIGINT)")
        left = len(owner)
        while left:
            self.con.execute(ENCODE.format(steps=max(16, STEP_ROWS // left)))
            self.con.execute("INSERT INTO done SELECT word, place, id FROM state WHERE NOT open")
            self.con.execute("CREATE OR REPLACE TABLE letters AS SELECT word, place, id, after FROM state WHERE open")
            left = self.con.execute("SELECT count(*) FROM letters").fetchall()[0][0]
        found = self.con.sql(DECODE).to_arrow_table()
        return found.column("ids").to_pylist(), found.column("decoded").to_pylist()

    def learn(self, words: Iterable[str]) -> dict[str, tuple[str, bytes, int]]:
        """(ids as text, decoded bytes, number of ids) of these words, and of others seen before."""
        if len(self.known) > WORKER_WORDS:
            self.known = {}
        fresh = [w for w in words if w not in self.known]
        at = 0
        while at < len(fresh):
            size, part = 0, []
            while at < len(fresh) and len(part) < MATCHES and (not part or size + len(fresh[at]) <= MATCH_BYTES):
                size += len(fresh[at])
                part.append(fresh[at])
                at += 1
            for word, ids, decoded in zip(part, *self.encode([w.encode() for w in part])):
                self.known[word] = ",".join(map(str, ids)), decoded, len(ids)
        return self.known


@cache
def sql_bpe(ranks_path: str) -> SqlBpe:
    return SqlBpe(ranks_path)


class Pieces:
    """Ids as text and decoded bytes of each distinct piece."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.bpe, self.matches = sql_bpe(ranks_path), regex.compile(pattern).findall
        self.coder = Coder(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.ids: list[str] = []
        self.decoded: list[bytes] = []
        self.sizes: list[int] = []

    def _learn(self, fresh: list[str]) -> None:
        parts = [self.matches(piece_text(x)) for x in fresh]
        known = self.bpe.learn(dict.fromkeys([w for x in parts for w in x]))
        for x in parts:
            if len(x) == 1:
                ids, decoded, n = known[x[0]]
            else:
                found = [known[w] for w in x]
                ids, decoded, n = ",".join([y[0] for y in found]), b"".join([y[1] for y in found]), sum([y[2] for y in found])
            self.ids.append(ids)
            self.decoded.append(decoded)
            self.sizes.append(n)

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, checksum of the ids as text, checksum of the decoded bytes) of each text."""
        codes, starts = self.coder.encode(texts)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = codes[a:b].tolist()
            ids = ",".join([x for x in map(self.ids.__getitem__, own) if x])
            decoded = b"".join(map(self.decoded.__getitem__, own))
            yield sum(map(self.sizes.__getitem__, own)), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], bytes]]:
        """(ids, decoded bytes) of each text."""
        codes, starts = self.coder.encode(texts)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = codes[a:b].tolist()
            yield [int(y) for x in own if self.ids[x] for y in self.ids[x].split(",")], b"".join(map(self.decoded.__getitem__, own))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every whole text.

    A NULL or empty text has no ids and decodes to no bytes. Repeated rows give repeated rows; other
    columns play no part; an empty table gives no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks_path, pattern)
        for batch in batches:
            rows = list(pieces.encode(batch.column(1).to_pylist()))
            arrays = [batch.column(0), pa.array([x[0] for x in rows], pa.list_(pa.int32())), pa.array([x[1] for x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: checksums of what `encode` gives, taken inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks_path, pattern)
        kinds = [pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = list(pieces.digest(batch.column(1).to_pylist()))
            arrays = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
