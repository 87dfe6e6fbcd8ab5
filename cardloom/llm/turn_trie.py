"""The prefix trie of conversations as balanced parentheses, shard by shard.

Turns are numbered and their prefixes hashed by running sums over a range-sorted table, so that a
conversation of any length is spread over tasks. A node is a distinct (depth, prefix hash); the
smallest conversation through it names it. Nodes of one name form a chain, and a chain's place in the
trie is the list of chains above it and where each begins: sorted by that list and the depth, the
nodes come in preorder, every subtree in one run.

The preorder is cut into shards of fixed size. A shard is a sequence of parentheses with the excess
(the depth) at each place and a tree of minima over blocks of it: findclose searches the minima for the
end of a subtree, the rank of `()` pairs there gives its leaves, and cumulative arrays its savings. The spine
that is open at a shard's end closes in the first later shard whose smallest depth is not larger: shards
hand over their smallest depths, and the spine meets the records of that shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import ready, written

# Nodes of one shard.
SHARD_NODES = 200_000
# Places of one block of the excess.
BLOCK = 64
# Odd factors of the two rolling sums over turns' hashes.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
NOTHING = hashlib.sha256(b"").hexdigest()


# --- parentheses -----------------------------------------------------------


class Parentheses:
    """Parentheses of nodes in preorder, given their depths; `after` is the depth of what follows them."""

    def __init__(self, depth: np.ndarray, after: int) -> None:
        closes = np.maximum(np.append(depth[:-1] - depth[1:], depth[-1] - after) + 1, 0)
        self.opens = np.arange(len(depth)) + np.cumsum(closes) - closes
        signs = np.full(len(depth) + int(closes.sum()), -1, np.int64)
        signs[self.opens] = 1
        self.open_here = signs == 1
        self.excess = np.cumsum(signs) + depth[0]
        blocks = -(-len(signs) // BLOCK)
        self.size = 1 << max(0, (blocks - 1).bit_length())
        padded = np.full(self.size * BLOCK, np.iinfo(np.int64).max)
        padded[: len(signs)] = self.excess
        self.padded = padded
        self.least = np.empty(2 * self.size, np.int64)
        self.least[self.size :] = padded.reshape(self.size, BLOCK).min(axis=1)
        for level in range(self.size.bit_length() - 2, -1, -1):
            row = np.arange(1 << level, 2 << level)
            self.least[row] = np.minimum(self.least[2 * row], self.least[2 * row + 1])

    def find_close(self) -> np.ndarray:
        """Where each node's parenthesis closes, -1 if it does not."""
        aim = self.excess[self.opens] - 1
        found = np.full(len(aim), -1)
        # Inside the block of the parenthesis itself.
        rows = np.arange(len(aim))
        for step in range(1, BLOCK):
            at = self.opens[rows] + step
            inside = at % BLOCK != 0
            rows, at = rows[inside], at[inside]
            hit = self.padded[np.minimum(at, len(self.padded) - 1)] <= aim[rows]
            found[rows[hit]] = at[hit]
            rows = rows[~hit]
            if not len(rows):
                break
        # Up the minima to the first later block that reaches so low, down to it, and through it.
        rows = np.flatnonzero(found < 0)
        node = self.size + self.opens[rows] // BLOCK
        while True:
            right = (node & 1 == 0) & (self.least[np.minimum(node + 1, 2 * self.size - 1)] <= aim[rows])
            going = ~right & (node > 1)
            if not going.any():
                break
            node = np.where(going, node >> 1, node)
        rows, node = rows[right], node[right] + 1
        while len(node) and (node < self.size).any():
            left = np.minimum(2 * node, 2 * self.size - 1)
            node = np.where(node >= self.size, node, np.where(self.least[left] <= aim[rows], left, left + 1))
        begin = (node - self.size) * BLOCK
        for step in range(BLOCK):
            hit = self.padded[begin + step] <= aim[rows]
            found[rows[hit]] = begin[hit] + step
            rows, begin = rows[~hit], begin[~hit]
            if not len(rows):
                break
        return found

    def leaf_ranks(self) -> np.ndarray:
        """`()` pairs that begin before each place, and before the end."""
        pair = np.zeros(len(self.open_here), bool)
        pair[:-1] = self.open_here[:-1] & ~self.open_here[1:]
        return np.concatenate([[0], np.cumsum(pair)])


class Bounds(NamedTuple):
    """What the shards know of each other: one number for each."""

    first: np.ndarray
    least: np.ndarray


SHARD_ROW = "kind string, shard long, target long, conv long, depth long, parent long, n_convs long, children long, leaves long, saved long"


def shard_rows(frame: pd.DataFrame, bounds: Bounds, size: int) -> pd.DataFrame:
    """Rows of one shard: `node` (subtree ends here: its leaves and savings), `open` (ends in shard `target`, -1: at the very
    end; leaves and savings before it), `record` (a new smallest depth; leaves and savings before it), `children` of
    parents, and the shard's `total`."""
    frame = frame.sort_values("place")
    shard = int(frame.place.iloc[0]) // size
    depth, conv = frame.depth.to_numpy(), frame.conv.to_numpy()
    after = int(bounds.first[shard + 1]) if shard + 1 < len(bounds.first) else -1
    tree = Parentheses(depth, after)
    close, leaf = tree.find_close(), tree.leaf_ranks()
    saved = np.concatenate([[0], np.cumsum((frame.n_convs.to_numpy() - 1) * frame.chars.to_numpy())])
    closed = close >= 0
    begin = np.arange(len(depth))
    end = np.cumsum(tree.open_here)[close]  # nodes that begin before the close
    first_later = np.minimum.accumulate(bounds.least[shard + 1 :])
    target = shard + 1 + np.searchsorted(-first_later, -depth, side="left")
    target = np.where(target < len(bounds.least), target, -1)

    def rows(kind: str, **columns: object) -> pd.DataFrame:
        names = [x.split()[0] for x in SHARD_ROW.split(", ")]
        return pd.DataFrame({"kind": kind, "shard": shard, **columns}).reindex(columns=names, fill_value=0)

    common = {"conv": conv, "depth": depth, "parent": frame.parent.to_numpy(), "n_convs": frame.n_convs.to_numpy()}
    nodes = rows("node", **common, leaves=leaf[np.maximum(close, 0)] - leaf[tree.opens], saved=saved[end] - saved[begin])
    spine = rows("open", **common, target=target, leaves=leaf[tree.opens], saved=saved[begin])
    lower = np.ones(len(depth), bool)
    lower[1:] = depth[1:] < np.minimum.accumulate(depth)[:-1]
    record = rows("record", depth=depth[lower], leaves=leaf[tree.opens][lower], saved=saved[begin][lower])
    below = frame[frame.depth > 0].assign(depth=lambda x: x.depth - 1).groupby(["parent", "depth"], as_index=False).size()
    children = rows("children", conv=below.parent.to_numpy(), depth=below.depth.to_numpy(), children=below["size"].to_numpy())
    total = rows("total", leaves=[leaf[-1]], saved=[saved[-1]])
    return pd.concat([nodes[closed], spine[~closed], record, children, total], ignore_index=True)


# --- running numbers over a sorted table ----------------------------------------


def _powers(exponent: np.ndarray) -> np.ndarray:
    """FACTORS to these powers, modulo 2**64, as two columns."""
    out = np.ones((len(exponent), 2), np.uint64)
    base, rest = FACTORS.copy(), exponent.astype(np.int64)
    with np.errstate(over="ignore"):
        while rest.any():
            out = np.where((rest & 1 == 1)[:, None], out * base, out)
            base, rest = base * base, rest >> 1
    return out


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows (conv, digest, chars) sorted by range, with their number `i` in their conversation and the rolling
    sums `a`, `b` of its turns' hashes up to them. No task needs a conversation as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, held = TaskContext.get().partitionId(), None, 0, np.zeros(2, np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column(0).to_numpy()
            at = np.arange(len(conv))
            first = np.ones(len(conv), bool)
            first[1:] = conv[1:] != conv[:-1]
            start = np.maximum.accumulate(np.where(first, at, 0))
            # The leading run may go on from the batch before.
            head = (start == 0) & (conv[0] == last)
            i = at - start + np.where(head, count, 0)
            digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 2)
            with np.errstate(over="ignore"):
                term = np.cumsum(digest * _powers(i), axis=0, dtype=np.uint64)
                before = np.where((start > 0)[:, None], term[np.maximum(start - 1, 0)], np.uint64(0))
                sums = term - before + np.where(head[:, None], held, np.uint64(0))
            last, count, held = conv[-1], int(i[-1]) + 1, sums[-1].copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(conv), part, np.int32)), *batch.columns, pa.array(i), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64))],
                ["part", "conv", "digest", "chars", "i", "a", "b"],
            )

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars")
    local = written(sorted_rows.mapInArrow(run, "part int, conv long, digest binary, chars long, i long, a long, b long"), name)
    # One row for each part: where its first conversation goes on from earlier parts.
    edges = local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "i", "a", "b")).alias("last")).collect()
    goes_on: dict[int, tuple[int, int, int, int]] = {}
    before: tuple[int, int, int, int] | None = None  # conversation, its turns so far, sums
    word = (1 << 64) - 1
    for part, first, end in sorted(map(tuple, edges)):
        turns, a, b = end.i + 1, end.a & word, end.b & word
        if before and before[0] == first:
            goes_on[part] = before
            if end.conv == first:
                power = _powers(np.array([before[1]]))[0].tolist()
                turns, a, b = before[1] + turns, (before[2] + power[0] * a) & word, (before[3] + power[1] * b) & word
        before = (end.conv, turns, a, b)
    if not goes_on:
        return local.drop("part")
    shared = local.sparkSession.sparkContext.broadcast(goes_on)  # one entry for each part at most

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, i = (batch.column(k).to_numpy() for k in (0, 1, 4))
            sums = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (5, 6)], axis=1)
            i = i.copy()
            for p in np.unique(part).tolist():
                if p in shared.value:
                    own, turns, a, b = shared.value[p]
                    rows = np.flatnonzero((part == p) & (conv == own))
                    with np.errstate(over="ignore"):
                        sums[rows] = sums[rows] * _powers(np.array([turns])) + np.array([a, b], np.uint64)
                    i[rows] += turns
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:4], pa.array(i), pa.array(sums[:, 0].copy().view(np.int64)), pa.array(sums[:, 1].copy().view(np.int64))],
                ["conv", "digest", "chars", "i", "a", "b"],
            )

    return local.mapInArrow(shift, "conv long, digest binary, chars long, i long, a long, b long")


# --- the trie --------------------------------------------------------------------


def turns_of(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, i, digest, chars) of every turn: its number in its conversation, a hash of role and text, the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text)))
    picked = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.substring(role, 1, 64).alias("role"), F.substring(text, 1, 64).alias("text"), digest.alias("digest"), F.length(text).cast("long").alias("chars"),
    ).filter("conv IS NOT NULL")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("digest")]
    return _numbered(picked, order, "trie-turns").select("conv", "i", "digest", "chars")


def shared_heads(turns: DataFrame, convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv, source, i, digest, chars): each conversation c begins with the first h turns of conversation c - c % block,
    followed by its own from the h-th on; h is the unsigned crc32 of c in decimal modulo `most`."""
    def h(conv: str) -> Column:
        return F.crc32(F.col(conv).cast("string").cast("binary")) % most

    own = turns.filter(F.col("i") >= h("conv")).select("conv", F.lit(1).alias("source"), "i", "digest", "chars")
    # At most most - 1 turns of each first conversation, for at most 2 * block - 1 others.
    heads = turns.filter((F.col("conv") % block == 0) & (F.col("i") < most - 1)).withColumnRenamed("conv", "base")
    asked = convs.select("conv", (F.col("conv") - F.col("conv") % block).alias("base"), h("conv").alias("h")).filter("h > 0")
    begun = asked.join(heads, "base").filter("i < h").select("conv", F.lit(0).alias("source"), "i", "digest", "chars")
    return begun.unionByName(own)


def _runs(paths: DataFrame) -> DataFrame:
    """conv, and the names along its path with the depths (from, to) at which each holds, from the top."""
    spans = paths.groupBy("conv", "name").agg(F.min("depth").alias("from"), F.max("depth").alias("to"))
    # As many names as chains above the conversation, each begun at another of its turns.
    return spans.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("from", "to", "name"))).alias("runs"))


def _ends(ends: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256) of rows (name, depth, conv): each node's list is hashed as it streams by in order.

    A part hashes what it holds of a node whole; only the first and last node of each part may go on
    in others, and their lists are handed on as text in chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        key, digest, first_run, chunks = None, None, True, []

        def rows(kept: list[tuple]) -> pa.RecordBatch:
            names = ["name", "depth", "conv", "sha", "text"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*kept), kinds)], names)

        for batch in batches:
            if not len(batch):
                continue
            name, depth, conv = (batch.column(k).to_numpy() for k in range(3))
            text = pc.cast(batch.column(2), pa.string()).to_pylist()
            starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (depth[1:] != depth[:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(name)]):
                now = (int(name[a]), int(depth[a]))
                piece = ",".join(text[a:b]).encode()
                if now != key:
                    if key is not None:
                        if first_run:
                            held += chunks
                        else:
                            held.append((*key, None, digest.hexdigest(), None))
                        first_run = False
                    first_run, key, digest, chunks = key is None, now, hashlib.sha256(), []
                else:
                    digest.update(b",")
                digest.update(piece)
                chunks.append((*now, int(conv[a]), None, piece))
                if first_run and len(chunks) > 64:
                    held, chunks = held + chunks, []
                if len(held) > 4000:
                    yield rows(held)
                    held = []
        if key is not None:
            yield rows(held + chunks)

    order = ["name", "depth", "conv"]
    parts = written(
        ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "name long, depth long, conv long, sha string, text binary"), "trie-ends"
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row(key: tuple[int, int], sha: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sha])], ["name", "depth", "ends_sha256"])

        for batch in batches:
            for name, depth, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (name, depth) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        yield row(key, digest.hexdigest())
                    key, digest = (name, depth), hashlib.sha256()
                digest.update(text)
        if key is not None:
            yield row(key, digest.hexdigest())

    chunks = parts.filter("sha IS NULL").select("name", "depth", "conv", "text")
    whole = parts.filter("sha IS NOT NULL").select("name", "depth", F.col("sha").alias("ends_sha256"))
    # A list is hashed in order: one task reads a node's chunks, one after the other.
    dealt = chunks.repartition("name", "depth").sortWithinPartitions("name", "depth", "conv")
    return whole.unionByName(dealt.mapInArrow(join, "name long, depth long, ends_sha256 string"))


def trie(convs: DataFrame, turns: DataFrame, order: list[str], shard_nodes: int | None = None) -> DataFrame:
    """The nodes of the trie of all conversations `convs` (conv), whose `turns` (conv, `order`, digest, chars) come in that order.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as described
    at `conversation_trie`.
    """
    size = shard_nodes or SHARD_NODES
    spark = ready(convs.sparkSession)
    convs = written(convs.select("conv").distinct(), "trie-convs")
    total, root = convs.agg(F.count("*"), F.min("conv")).first()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not total:
        return spark.createDataFrame([], out)
    steps = _numbered(turns, [F.col("conv"), *map(F.col, order)], "trie-steps").select("conv", (F.col("i") + 1).alias("depth"), "a", "b", "chars")
    # A node of many conversations is one row of `named` against many of `steps`, which adaptive joins split.
    named = steps.groupBy("depth", "a", "b").agg(F.min("conv").alias("name"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    named = written(named, "trie-names")
    paths = steps.select("conv", "depth", "a", "b").join(named.select("depth", "a", "b", "name"), ["depth", "a", "b"])
    runs = written(_runs(paths), "trie-runs")
    last = F.get("runs", F.size("runs") - 1)

    # A chain's key: where each chain above it and itself begin (deeper first) and their names.
    chains = runs.select("conv", "runs", last.alias("last")).filter(F.col("last.name") == F.col("conv")).select(
        F.col("conv").alias("name"), F.flatten(F.transform("runs", lambda r: F.array(-r["from"], r["name"]))).alias("key"), F.col("last.from").alias("begins"),
        F.coalesce(F.get("runs", F.size("runs") - 2)["name"], F.lit(root)).alias("above"),
    )
    nodes = named.select("name", "depth", "n_convs", "chars").join(chains, "name").select(
        "key", F.col("name").alias("conv"), "depth", F.when(F.col("depth") > F.col("begins"), F.col("name")).otherwise(F.col("above")).alias("parent"), "n_convs", "chars"
    )
    top = spark.range(1).select(
        F.array().cast("array<bigint>").alias("key"), F.lit(root).alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(root).alias("parent"),
        F.lit(total).alias("n_convs"), F.lit(0).cast("long").alias("chars"),
    )
    placed = _preorder(nodes.unionByName(top), size)

    sums = placed.groupBy("shard").agg(F.min_by("depth", "place").alias("first"), F.min("depth").alias("least")).collect()  # one row for each shard
    sums = sorted(map(tuple, sums))
    bounds = spark.sparkContext.broadcast(Bounds(np.array([x[1] for x in sums]), np.array([x[2] for x in sums])))
    found = placed.groupBy("shard").applyInPandas(_shard_task(bounds, size), SHARD_ROW)
    found = written(found, "trie-shards")

    before, leaves, saved = [], 0, 0
    for row in found.filter("kind = 'total'").select("shard", "leaves", "saved").orderBy("shard").collect():  # one row for each shard
        before.append((row.shard, leaves, saved))
        leaves, saved = leaves + row.leaves, saved + row.saved
    offsets = F.broadcast(spark.createDataFrame(before, "shard long, leaves0 long, saved0 long"))
    absolute = [(F.col("leaves") + F.col("leaves0")).alias("leaves"), (F.col("saved") + F.col("saved0")).alias("saved")]
    spine = found.filter("kind = 'open'").join(offsets, "shard").select("conv", "depth", "parent", "n_convs", "target", *absolute)
    record = found.filter("kind = 'record'").join(offsets, "shard").select(F.col("shard").alias("target"), "depth", *absolute)
    # The record of the largest depth not beyond the spine node's own, in the shard where it closes.
    asked = spine.withColumn("is_open", F.lit(1)).unionByName(record.withColumn("is_open", F.lit(0)), allowMissingColumns=True)
    until = F.last(F.when(F.col("is_open") == 0, F.struct("leaves", "saved")), True).over(Window.partitionBy("target").orderBy("depth", "is_open").rowsBetween(Window.unboundedPreceding, 0))
    at_end = F.struct(F.lit(leaves).cast("long").alias("leaves"), F.lit(saved).cast("long").alias("saved"))
    merged = asked.withColumn("until", F.when(F.col("target") < 0, at_end).otherwise(until)).filter("is_open = 1").select(
        "conv", "depth", "parent", "n_convs", (F.col("until.leaves") - F.col("leaves")).alias("leaves"), (F.col("until.saved") - F.col("saved")).alias("saved")
    )

    turnless = convs.join(runs, "conv", "left_anti").select(F.lit(root).alias("name"), F.lit(0).cast("long").alias("depth"), "conv")
    ended = runs.select(last["name"].alias("name"), last["to"].alias("depth"), "conv").unionByName(turnless)
    parts = (
        found.filter("kind = 'node'").select("conv", "depth", "parent", "n_convs", "leaves", "saved").unionByName(merged)
        .unionByName(found.filter("kind = 'children'").select("conv", "depth", "children"), allowMissingColumns=True)
        .unionByName(_ends(ended).withColumnRenamed("name", "conv"), allowMissingColumns=True)
    )
    return parts.groupBy("conv", "depth").agg(
        F.max("parent").alias("parent"), F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"),
        F.max("leaves").alias("n_leaves"), F.max("saved").alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256"),
    ).select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def _shard_task(bounds: object, size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return shard_rows(frame, bounds.value, size)

    return run


def _preorder(nodes: DataFrame, size: int) -> DataFrame:
    """The nodes with their `place` in preorder and the shard it falls in."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            arrays = [pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(at, at + len(batch)))]
            at += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], ["conv", "depth", "parent", "n_convs", "chars", "part", "at"])

    order = ["key", "depth"]
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "depth", "parent", "n_convs", "chars")
    local = written(ranged.mapInArrow(number, "conv long, depth long, parent long, n_convs long, chars long, part int, at long"), "trie-nodes")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, local.groupBy("part").count().collect())):  # one row for each part
        offsets.append((part, before))
        before += n
    begins = F.broadcast(local.sparkSession.createDataFrame(offsets, "part int, before long"))
    placed = local.join(begins, "part").withColumn("place", F.col("before") + F.col("at")).drop("part", "at", "before")
    return placed.withColumn("shard", F.floor(F.col("place") / size).cast("long"))


def conversation_trie(conversations: DataFrame, block: int = 100, most: int = 6, shard_nodes: int | None = None) -> DataFrame:
    """The trie of conversations rebuilt on shared heads (`shared_heads`): one row for each distinct prefix.

    conv_id (the smallest conversation through the node), depth, parent_conv_id (NULL at the root), n_convs, n_children,
    n_leaves (nodes without children in the subtree), saved_tokens (over the subtree, the node itself
    included: code points of its last text times its conversations but one) and ends_sha256 (of the conversations that end in
    it, ascending, joined by commas).

    Turns come in the order of `turn`, NULL first; turns of one number in the order of role, the first 64
    characters of the text and its hash; repeated rows are repeated turns. A NULL role or text is empty. Rows without a conv_id
    belong to no conversation and are left out. Other columns play no part. An empty table has no nodes,
    not even a root.
    """
    ready(conversations.sparkSession)
    turns = turns_of(conversations)  # reads a written table
    convs = turns.select("conv").distinct()
    return trie(convs, shared_heads(turns, convs, block, most), ["source", "i"], shard_nodes)
