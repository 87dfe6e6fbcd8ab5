"""Near-duplicate documents by DartMinHash over weighted word shingles.

A shingle's weight is 1 + ln(times it occurs). The plane of weight and rank above each shingle is
divided into unit regions; hashing throws a Poisson number of darts into each, every dart with a
weight, a rank and one of K coordinates. A document is hit by the darts whose weight is below its
shingle's weight, and the earliest hit of each coordinate is its signature. Only as many ranks are
looked at as fill all coordinates: the larger a document, the fewer. Links are decided exactly, by the
Jaccard similarity of the shingle sets, so a document with repeated shingles has a second signature,
of unit weights; without repeats the two are one. Bands of the signatures join candidates.

Equal texts are one node. Candidates' connected groups are compared in blocks of bounded size: first
inside blocks and with a few hubs of the group, then between blocks as far as their nodes are not in
one class already. No pairs are emitted but the links that join parts, so a group of thousands costs
no rows by its square, and no link between different classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import ready, text_of, written
from cardloom.llm.components import components
from cardloom.llm.near_vectors import forest
from cardloom.llm.pieces import Coder

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
K = BANDS * ROWS
# Darts that fill all K coordinates but for about one document in eight, which looks at more ranks.
DARTS = K * np.log(K) + 2 * K
# A block holds about so many documents and shingles.
BLOCK = 256
BLOCK_SHINGLES = 300_000
HUBS = 16
# Text that is signed at once.
SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


# Cumulative Poisson(1) probabilities: how many darts a region of area one receives.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


class Shingler:
    """Hashed word shingles of texts, each distinct word hashed once."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.coder = Coder(self._learn, self._forget, words=True)

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.lower().encode("utf-8", "surrogatepass") for w in fresh]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(text)) - np.repeat(begin, sizes)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(sizes.max(initial=1)), 0x100000001B3, np.uint64))
            sums = np.add.reduceat(mix(text + np.uint64(1)) * power[place], begin) if len(raw) else np.zeros(0, np.uint64)
        self.hashes = np.concatenate([self.hashes, mix(sums + sizes.astype(np.uint64))])

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, times) of the distinct shingles; a text of fewer words than WORDS is one shingle."""
        codes, starts = self.coder.encode(texts)
        words, sizes = self.hashes[codes], np.diff(starts)
        n = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.repeat(starts[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        end = starts[1:][owner]
        code = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS):
                inside = at + k < end
                word = np.where(inside, words[np.minimum(at + k, max(0, len(words) - 1))], np.uint64(0)) if len(words) else code
                code = mix(code * _ODD + word + np.uint64(k))
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        return owner[at], code[at], np.diff(np.append(at, len(code)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The K earliest darts of each weighted set (zeros for an empty one); `owner` says which set an element is of."""
    total = np.bincount(owner, weights=weight, minlength=texts)
    best_rank = np.full(texts * K, np.inf)
    best = np.zeros(texts * K, np.uint64)
    ranks = np.ceil(DARTS / np.maximum(total, 1e-9)).astype(np.int64)
    done = np.zeros(texts, np.int64)  # ranks looked at so far
    open_ = total > 0
    while open_.any():
        rows = np.flatnonzero(open_[owner]).astype(np.int32)
        # Every open set's elements, each with its regions of weight and its new regions of rank.
        high = np.ceil(weight[rows]).astype(np.int64)
        new = (ranks - done)[owner[rows]]
        cells = high * new
        row = np.repeat(rows, cells)
        cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        levels = np.repeat(high.astype(np.int32), cells)
        level, rank = (cell % levels).astype(np.int32), (cell // levels + done[owner[row]]).astype(np.int32)
        del cell, levels
        with np.errstate(over="ignore"):
            seed = mix(element[row] + mix(level.astype(np.uint64) * _ODD + mix(rank.astype(np.uint64) + np.uint64(77))))
        count = np.searchsorted(_POISSON, _unit(mix(seed + np.uint64(1))), side="right")
        dart_row, dart_rank, dart_slot, dart = [], [], [], []
        for t in range(int(count.max(initial=0))):
            thrown = np.flatnonzero(count > t)
            with np.errstate(over="ignore"):
                code = mix(seed[thrown] + np.uint64(1000 + t) * _ODD)
                hit = level[thrown] + _unit(mix(code + np.uint64(2))) <= weight[row[thrown]]
                thrown, code = thrown[hit], code[hit]
                dart_rank.append(rank[thrown] + _unit(mix(code + np.uint64(3))))
                dart_slot.append(owner[row[thrown]] * K + (mix(code + np.uint64(4)) % np.uint64(K)).astype(np.int64))
                dart.append(code)
        if dart:
            where, when, what = np.concatenate(dart_slot), np.concatenate(dart_rank), np.concatenate(dart)
            order = np.lexsort((when, where))
            where, when, what = where[order], when[order], what[order]
            first = np.ones(len(where), bool)
            first[1:] = where[1:] != where[:-1]
            where, when, what = where[first], when[first], what[first]
            earlier = when < best_rank[where]
            best_rank[where[earlier]], best[where[earlier]] = when[earlier], what[earlier]
        done = np.where(open_, ranks, done)
        open_ = open_ & np.isinf(best_rank).reshape(texts, K).any(axis=1)
        ranks = np.where(open_, 2 * ranks, ranks)
    return best.reshape(texts, K)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys * _ODD + signature.reshape(-1, BANDS, ROWS)[:, :, r])
        return mix(keys + np.arange(BANDS, dtype=np.uint64) * _ODD)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of about SLICE_BYTES of text; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)]):
        yield batch.slice(begin, end - begin)


def _banded(shingler: Shingler, texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Numbers of distinct shingles and band keys of the texts' sets; texts with repeats have weighted bands beside them."""
    owner, code, times = shingler.shingles(texts)
    n = np.bincount(owner, minlength=len(texts))
    keys = band_keys(signatures(owner, code, np.ones(len(code)), len(texts)))
    repeats = np.bincount(owner, weights=times > 1, minlength=len(texts)) > 0
    place = np.cumsum(repeats) - 1
    own = repeats[owner]
    owner, code, times = place[owner[own]], code[own], times[own]
    weighted = band_keys(signatures(owner, code, 1 + np.log(times), int(repeats.sum())))
    held = np.where(n > 0, BANDS, 0) + np.where(repeats, BANDS, 0)
    both = np.concatenate([keys[n > 0], weighted])
    text = np.concatenate([np.flatnonzero(n > 0), np.flatnonzero(repeats)])
    flat = pa.array(both[np.argsort(text, kind="stable")].reshape(-1).view(np.int64))
    return pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), flat)


def _sets_meet(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, columns of shingles at a time."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    meet = np.zeros((len(left), len(right)), np.float32)
    width = 1 << 13
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(left) + len(right), width), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        meet += part[: len(left)] @ part[len(left) :].T
    return meet


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have a Jaccard similarity of at least the threshold."""
    meet = _sets_meet(left, right).astype(np.float64)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    union = size_l[:, None] + size_r[None, :] - meet
    # The intersections are whole numbers: a pair at the threshold itself must not be lost to rounding.
    return np.nonzero(meet >= threshold * union - 1e-9)


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links that join parts: among the rows of side 0, and between them and those of side 1."""
        frame = frame.sort_values(["side", "node"])
        side, node = frame.side.to_numpy(), frame.node.to_numpy()
        sets = [np.asarray(x) for x in frame.shingles]
        ours = int((side != 1).sum())
        alone = ours == len(sets)  # one block with itself
        i, j = similar(sets[:ours], sets if alone else sets[ours:], threshold)
        j = j if alone else j + ours
        apart = node[i] != node[j]
        i, j = i[apart], j[apart]
        keep = forest(len(node), i, j)
        return pd.DataFrame({"a": node[i[keep]], "b": node[j[keep]]}, dtype=object)

    return run


def node_of(text: Column) -> Column:
    """One node for all equal texts."""
    return F.md5(text)


def candidate_links(banded: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of every band; `banded` holds (node, band), a few dozen bands a node at most.

    A band's nodes meet in its smallest one, its hub. A node links with the smallest of its hubs only, and that one
    with the node's other hubs, which are the same few for all nodes of a group: one link for each node and those
    between hubs, not one for each node and hub.
    """
    hub = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("band", "a")
    hubs = banded.join(hub, "band").filter("a <> node").groupBy("node").agg(F.array_sort(F.collect_set("a")).alias("hubs"))
    ends = F.concat(F.array("node"), F.slice("hubs", F.lit(2), F.size("hubs")))
    return hubs.select(F.get("hubs", F.lit(0)).alias("a"), F.explode(ends).alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (of its text), class_id and kept of every document.

    `class_id` is the smallest doc_id reachable by links: the similarity of the sets of five-word
    shingles (lower case, between blanks) is at least `threshold`, or the texts are equal. A text of one
    to four words is one shingle. NULL texts count as empty; texts without words link with nothing, not even with each
    other. `kept` marks one document of each class: that of the smallest (doc_id, text). Repeated rows
    give repeated rows; NULL ids count as largest; an empty table gives no rows; other columns play no part.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("node", node_of(F.col("text")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch, 1):
                n, bands = _banded(shingler, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n, bands], ["doc_id", "node", "n", "bands"])

    signed = written(texts.mapInArrow(sign, "doc_id long, node string, n int, bands array<long>"), "dart-signatures")
    nodes = signed.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    groups = components(candidate_links(banded)).withColumnRenamed("component", "grp")

    # Shingles of the documents that have a candidate, one row for each node.
    def list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch, 1):
                owner, code, _ = shingler.shingles(part.column(1).to_pylist())
                offsets = np.searchsorted(owner, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "shingles"])

    # One document for each such node: the one of smallest id, so that no group of copies meets in a task.
    first_of = signed.join(groups, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = texts.select("node", "text", "doc_id").join(first_of, (texts.node == first_of.node) & texts.doc_id.eqNullSafe(first_of.doc_id), "left_semi")
    lists = chosen.select("node", "text").mapInArrow(list_shingles, "node string, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    members = written(lists.join(groups, "node").withColumn("n", F.size("shingles")), "dart-members")

    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("grp").agg(blocks_of.alias("blocks"))
    dealt = members.join(sizes, "grp").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    # Hubs of a group of several blocks: its HUBS nodes of smallest hash meet every block.
    order = Window.partitionBy("grp").orderBy("spot", "node")
    spots = dealt.filter("blocks > 1").select("grp", "node", F.xxhash64("node", F.lit(1)).alias("spot"))
    hubs = spots.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= HUBS).select("grp", "node")
    visiting = (
        dealt.join(hubs, ["grp", "node"], "left_semi").select("grp", "node", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("block").alias("home"))
        .filter("block <> home").select("grp", "block", "node", "shingles")
    )
    schema = "a string, b string"
    inside = dealt.select("grp", "block", "node", "shingles").unionByName(visiting).withColumn("side", F.lit(2))
    near = written(inside.groupBy("grp", "block").applyInPandas(_compare(threshold), schema), "dart-links")
    found = components(near).withColumnRenamed("component", "label")

    # Between blocks: nodes of a large class keep to blocks of their own, which need not meet each other.
    labelled = written(
        dealt.filter("blocks > 1").drop("block", "blocks").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")), "dart-labelled"
    )
    by_label = labelled.groupBy("grp", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    large = F.when(F.col("rows") >= BLOCK // 2, F.col("label")).otherwise("")
    kinds = by_label.withColumn("kind", large).groupBy("grp", "kind").agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight"))
    kinds = kinds.withColumn("kind_blocks", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int"))
    spread = labelled.join(by_label.select("grp", "label", large.alias("kind")), ["grp", "label"]).join(kinds.select("grp", "kind", "kind_blocks"), ["grp", "kind"])
    spread = spread.withColumn("block", F.expr("cast(pmod(xxhash64(node, 2), kind_blocks) as int)"))
    meets = kinds.select("grp", F.col("kind").alias("other"), F.col("kind_blocks").alias("other_blocks"))
    tiles = (
        spread.join(meets, "grp").filter("kind = '' OR kind <> other")
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        .withColumn("mine", F.struct("kind", "block")).withColumn("theirs", F.struct(F.col("other").alias("kind"), F.col("other_block").alias("block")))
        .select(
            "grp", F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high"),
            F.when(F.col("mine") == F.col("theirs"), 2).when(F.col("mine") < F.col("theirs"), 0).otherwise(1).alias("side"), "node", "shingles",
        )
    )
    across = written(tiles.groupBy("grp", "low", "high").applyInPandas(_compare(threshold), schema), "dart-links")
    joined = components(near.unionByName(across))

    labels = signed.select("node").distinct().join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    # Texts without words stand alone, row by row.
    with_words = signed.filter("n > 0").select("doc_id", "node").join(labels, "node")
    order_key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    leaders = with_words.groupBy("component").agg(F.min(order_key).alias("leader"))
    out = with_words.join(leaders, "component").select(
        "doc_id", "node", F.col("leader.doc_id").alias("class_id"), (order_key == F.col("leader")).alias("kept")
    )
    alone = signed.filter("n = 0").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with one document of each class; of rows equal in id and text one stays, too.

    Texts without words are kept.
    """
    found = classes(docs, threshold, id_col, text_col).filter("kept")

    def key(doc_id: Column, node: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), node)

    kept = found.select(key(F.col("doc_id"), F.col("node")).alias("__key__"))
    keyed = docs.withColumn("__key__", key(F.col(id_col).cast("long"), node_of(text_of(text_col))))
    return keyed.join(kept, "__key__", "left_semi").dropDuplicates(["__key__"]).drop("__key__")
