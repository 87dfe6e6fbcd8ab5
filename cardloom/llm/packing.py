"""Packing by cutting-stock column generation.

Documents longer than a sequence fill whole sequences; what remains of each is shorter than one. The
remainders' lengths form a histogram of fixed size, and patterns (how many of each length share a
sequence) are chosen by a linear program over it: a knapsack dynamic program prices new patterns by
the program's dual values until the bound says that little is left to gain. Patterns are rounded
down; the few documents that rounding leaves over are laid end to end and cut where a sequence is
full. Documents are ranked among those of their length, which says which sequence each belongs to.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardloom.llm.common import ready, text_of, written
from cardloom.llm.library_ids import LibraryIds, with_end

# Lengths are counted in steps of so many tokens for the patterns; offsets use the true lengths.
STEP = 8
# Column generation ends when the program's value is this close to its lower bound, or after so many
# patterns; a pattern that leaves more than MOST_WASTE of a sequence empty is not used. These only
# decide how little padding is left and how many documents are cut: every document is placed.
GAP = 0.001
MOST_PATTERNS = 3000
MOST_WASTE = 0.02

PIECE = "doc_id long, doc_tokens long, start long, length int, tail boolean, task int, place long, ids binary"


class Plan(NamedTuple):
    """Where the r-th remainder of each length goes. A bin holds STEP neighbouring lengths, shortest first."""

    capacity: int
    begins: list[int]  # by length: the rank in its bin of the first remainder of this length
    bin_lengths: list[list[int]]  # by bin: the lengths in it that occur
    bin_begins: list[list[int]]  # by bin: where each of them begins
    first: list[list[int]]  # by bin: the ranks at which a pattern's share begins
    which: list[list[int]]  # by bin: that pattern
    patterns: list[tuple[int, list[tuple[int, int, int]]]]  # first sequence; (bin, first rank, copies) in their order
    left_rank: list[int]  # by bin: ranks from here on are left over
    left_at: list[int]  # by length: where the leftovers of this length begin in their row
    left_sequence: int
    sequences: int


def _best_pattern(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the pattern of most value, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(lengths, room, side="right")
        best[room] = best[room - 1]
        if fits:
            gain = best[room - lengths[:fits]] + value[:fits]
            k = int(gain.argmax())
            if gain[k] > best[room]:
                best[room], took[room] = gain[k], k
    pattern, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= int(lengths[took[room]])
    return float(best[capacity]), pattern


def patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, from the linear program's revised simplex method."""
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(np.int64)  # one column for each length to begin with
    inverse = np.diag(1.0 / np.diag(basis))
    used = inverse @ demand
    for _ in range(MOST_PATTERNS):
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, column = _best_pattern(np.maximum(dual, 0.0), lengths, capacity)
        if worth <= 1 + GAP:  # the value divided by `worth` bounds the optimum from below
            break
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(used[rows] / direction[rows])]
        step = used[out] / direction[out]
        used -= step * direction
        used[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    return basis.T[:m], np.maximum(used, 0.0)


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    """The plan for `counts[l]` remainders of each length l below the capacity."""
    n_bins = -(-capacity // STEP) + 1
    begins, bin_lengths, bin_begins = [0] * capacity, [[] for _ in range(n_bins)], [[] for _ in range(n_bins)]
    held = np.zeros(n_bins, np.int64)
    for length in np.flatnonzero(counts).tolist():
        b = -(-length // STEP)
        begins[length] = int(held[b])
        bin_lengths[b].append(length)
        bin_begins[b].append(int(held[b]))
        held[b] += int(counts[length])
    bins = np.flatnonzero(held)
    ranks, left, sequences = np.zeros(n_bins, np.int64), held.copy(), 0
    first, which, chosen = [[] for _ in range(n_bins)], [[] for _ in range(n_bins)], []
    if len(bins):
        rows, times = patterns(bins, held[bins].astype(float), capacity // STEP)
        for row, often in zip(rows, np.floor(times + 1e-9).astype(np.int64)):
            inside = np.flatnonzero(row)
            # Patterns may cover more than there is: never use one beyond what is left.
            often = min([int(often), *(int(left[bins[k]] // row[k]) for k in inside)])
            if often <= 0 or STEP * (row @ bins) < (1 - MOST_WASTE) * capacity:
                continue
            items = []
            for b, copies in zip(bins[inside].tolist(), row[inside].tolist()):
                first[b].append(int(ranks[b]))
                which[b].append(len(chosen))
                items.append((b, int(ranks[b]), copies))
                ranks[b] += copies * often
                left[b] -= copies * often
            chosen.append((sequences, items))
            sequences += often
    left_at, at = [0] * capacity, 0
    for length in np.flatnonzero(counts).tolist()[::-1]:
        left_at[length] = at
        over = begins[length] + int(counts[length]) - max(int(ranks[-(-length // STEP)]), begins[length])
        at += max(0, over) * length
    return Plan(capacity, begins, bin_lengths, bin_begins, first, which, chosen, ranks.tolist(), left_at, sequences, sequences + -(-at // capacity))


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of each piece of the rank-th remainder of a length."""
    own = -(-length // STEP)
    rank += plan.begins[length]
    if rank >= plan.left_rank[own]:
        at = plan.left_at[length] + (rank - max(plan.left_rank[own], plan.begins[length])) * length
        out, start = [], 0
        while start < length:
            sequence, offset = divmod(at + start, plan.capacity)
            size = min(length - start, plan.capacity - offset)
            out.append((start, size, plan.left_sequence + sequence, offset))
            start += size
        return out
    k = bisect_right(plan.first[own], rank) - 1
    sequence, items = plan.patterns[plan.which[own][k]]
    row, slot = divmod(rank - plan.first[own][k], next(c for b, _, c in items if b == own))
    offset = 0
    for b, begin, copies in items:  # the true lengths of what lies before in the same sequence
        before = range(begin + row * copies, begin + row * copies + (slot if b == own else copies))
        offset += sum(plan.bin_lengths[b][bisect_right(plan.bin_begins[b], r) - 1] for r in before)
        if b == own:
            break
    return [(0, length, sequence + row, offset)]


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian 32 bits).

    A NULL text counts as empty: its end id alone. Repeated rows are packed as often as they occur, a
    NULL id stays NULL, and other columns play no part. An empty table gives no rows. Texts of any
    length are encoded whole.
    """
    spark = ready(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryIds(tokenizer, words=False)
        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity, np.int64)
        full = 0
        for batch in batches:
            flat, starts = with_end(*encoder.encode(batch.column(1).to_pylist()), end_id)
            # All pieces of the batch lie end to end in `flat`.
            tokens = np.diff(starts)
            pieces = -(-tokens // capacity)
            first = np.cumsum(pieces) - pieces
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = capacity * (np.arange(len(doc)) - first[doc])
            length = np.minimum(capacity, tokens[doc] - start)
            tail = length < capacity
            # A tail's place is its rank among those of its length in this task, a whole sequence's among those.
            place = np.cumsum(~tail) - 1 + full
            own = np.flatnonzero(tail)
            order = own[np.argsort(length[own], kind="stable")]
            count = np.bincount(length[own], minlength=capacity)
            place[order] = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) + ranks[length[order]]
            ranks += count
            full += int((~tail).sum())
            # Arrow's offsets have 32 bits: a batch of more than 1 GiB of ids is handed over in parts.
            for at in range(0, len(doc), 1 << 18):
                some = slice(at, at + (1 << 18))
                begin = int(starts[doc[at]] + start[at])
                ends = np.concatenate([[0], np.cumsum(length[some])])
                raw = np.ascontiguousarray(flat[begin : begin + int(ends[-1])], "<u4")
                ids = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw)])
                arrays = [
                    batch.column(0).take(pa.array(doc[some])), pa.array(tokens[doc[some]]), pa.array(start[some]), pa.array(length[some].astype(np.int32)),
                    pa.array(tail[some]), pa.array(np.full(len(ends) - 1, task, np.int32)), pa.array(place[some]), ids,
                ]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECE.split(", ")])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = written(texts.mapInArrow(encode, PIECE), "pieces")
    tails = pieces.filter("tail")
    # A document's rank among all of its length: its rank inside its task, after those of earlier tasks.
    by_task = tails.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(capacity, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # one row for each length at most
        counts[length] = n
    plan = make_plan(counts, capacity)
    shared = spark.sparkContext.broadcast(plan)  # its size has a bound: lengths and patterns, not documents
    out = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            rows = []
            for doc, n, start, length, rank, ids in zip(*(x.to_pylist() for x in batch.columns)):
                for at, size, sequence, offset in place(plan, length, rank):
                    rows.append((doc, start + at, size, n, sequence, offset, ids[4 * at : 4 * (at + size)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in out.split(", ")])

    ranked = tails.join(before, ["length", "task"]).select("doc_id", "doc_tokens", "start", "length", (F.col("before") + F.col("place")).alias("rank"), "ids")
    # Whole sequences are numbered after the planned ones, by task and place.
    whole = pieces.filter("NOT tail").select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens",
        (F.lit(plan.sequences) + F.col("task").cast("long") * F.lit(1 << 32) + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids",
    )
    return ranked.mapInArrow(lay, out).unionByName(whole)


def piece_digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
