"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors are one from the start. The others are dealt into tiles by the nearest of a few
pivots; a pair of tiles is skipped only where the triangle inequality of angles rules out any link.
In a pair of tiles the unit vectors' int8 codes are multiplied, exactly, as integers. With x = s*q + e
the true cosine differs from the scaled product of codes by at most |e_x| + |e_y| + |e_x||e_y|; each
vector carries its |e|. Only pairs whose interval reaches the threshold are computed again in double
precision. A pair of tiles gives counts of links and a spanning forest of them, never all its links.
Tiles are not exchanged for their pairs: a round of them, of bounded size, is sent to all tasks, which hold the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ready, written
from cardloom.llm.components import components
from cardloom.llm.vectors import matrix, vector_rows
from cardloom.session import discard

# Vectors in one tile, on average; one pivot for so many, and at most PIVOTS of them.
TILE = 4096
PIVOTS = 256
# Tiles sent to all tasks at a time, on average.
ROUND_BYTES = 8 << 20
# Slack for the rounding of doubles in bounds.
EPS = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the norm of what the codes miss, for each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1) + EPS


def tame(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: squares keep inside a double's range."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of left, rows of right) with cosine >= threshold in double precision; both are raw vectors."""
    left, right = tame(left), tame(right)
    norm_l, norm_r = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    (ql, sl, el), (qr, sr, er) = quantise(left / norm_l[:, None]), quantise(right / norm_r[:, None])
    # Products of int8 codes are integers below 2**24 up to 1040 dimensions: float32 holds them exactly.
    kind = np.float32 if left.shape[1] <= 1040 else np.float64
    ql, qr = ql.astype(kind), qr.astype(kind)
    for at in range(0, len(ql), 512):
        rows = slice(at, at + 512)
        near = (ql[rows] @ qr.T).astype(kind)
        # cosine <= s_l s_r <codes> + e_l + e_r + e_l e_r, tested per row against the loosest column first
        near *= sl[rows, None].astype(kind)
        near *= sr[None, :].astype(kind)
        loosest = threshold - (el[rows] + er.max() + el[rows] * er.max()) - 1e-5
        i, j = np.nonzero(near >= loosest[:, None].astype(kind))
        i += at
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            exact = np.einsum("ij,ij->i", left[a], right[b]) / (norm_l[a] * norm_r[b])
            keep = exact >= threshold
            yield a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a[k], b[k]) between n nodes join parts that were apart."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[y] = x
            out.append(k)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing and are
    components of their own, as are vectors of different lengths to each other. Rows of equal vectors
    link with each other. Rows are told apart by their id; rows that share an id are one row of the
    result for each, with the same component. A NULL id forms a component of its own (NULL). An empty
    table gives no rows; other columns play no part.
    """
    spark = ready(vectors.sparkSession)
    rows = vector_rows(vectors, id_col, vector_col, narrow=True).filter("vec_id IS NOT NULL")
    # Equal vectors: the smallest id stands for all.
    by_key = written(rows.withColumn("key", F.md5(F.to_json("v"))), "near-rows")
    copies = by_key.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = copies.select("node", "n", "v", F.size("v").alias("dim"))

    # Pivots: vectors of smallest hash, one for each tile's worth; any choice gives the same links.
    total = distinct.count()
    wanted = max(1, min(PIVOTS, total // TILE))
    pivots = [r.v for r in distinct.orderBy(F.xxhash64("node"), "node").limit(wanted).select("v").collect()]
    shared = spark.sparkContext.broadcast([x / np.linalg.norm(x) for p in pivots for x in tame(np.array([p], float))])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cells, angles = np.full(len(dims), -1), np.full(len(dims), math.pi)
            for dim in np.unique(dims):
                own = [k for k, c in enumerate(centres) if len(c) == dim]
                rows = np.flatnonzero(dims == dim)
                if own:
                    x = tame(matrix(batch.column(2).take(pa.array(rows))))
                    near = np.arccos(np.clip(x @ np.array([centres[k] for k in own]).T / np.linalg.norm(x, axis=1)[:, None], -1, 1))
                    cells[rows] = np.array(own)[near.argmin(axis=1)]
                    angles[rows] = near.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(angles)], ["node", "n", "v", "dim", "cell", "angle"])

    kind = dict(distinct.dtypes)["v"]
    homed = written(distinct.mapInArrow(home, f"node long, n long, v {kind}, dim int, cell int, angle double"), "near-homes")
    # A row for each pivot and length; a cell is cut into slices of bounded size.
    cells = homed.groupBy("dim", "cell").agg(F.max("angle").alias("reach"), F.ceil(F.count("*") / TILE).cast("int").alias("slices"))
    pairs = cell_pairs([tuple(r) for r in cells.collect()], shared.value, threshold)
    meets = spark.createDataFrame([(x[0], x[1], x[3]) for x in pairs], "dim int, cell int, other int")
    width = np.dtype("<f4" if kind == "array<float>" else "<f8")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        """A slice as one row: its nodes, how many rows each stands for, and its raw vectors."""
        first = frame.iloc[0]
        flat = np.concatenate([np.asarray(x, width) for x in frame.v])
        numbers = [frame[c].to_numpy().astype("<i8").tobytes() for c in ("node", "n")]
        return pd.DataFrame({"dim": [first.dim], "cell": [first.cell], "slice": [first.slice], "nodes": [numbers[0]], "times": [numbers[1]], "v": [flat.tobytes()]})

    sliced = homed.join(F.broadcast(cells.select("dim", "cell", "slices")), ["dim", "cell"]).withColumn("slice", F.expr("cast(pmod(xxhash64(node), slices) as int)"))
    tiles = sliced.select("dim", "cell", "slice", "node", "n", "v").groupBy("dim", "cell", "slice").applyInPandas(
        pack, "dim int, cell int, slice int, nodes binary, times binary, v binary"
    )
    tiles = written(tiles, "near-tiles", large=True)
    size = tiles.agg(F.count("*").alias("n"), F.sum(F.length("nodes") * 2 + F.length("v")).alias("size")).first()
    rounds = max(1, -(-(size.size or 0) // ROUND_BYTES))
    parts = max(1, min(size.n, 4 * spark.sparkContext.defaultParallelism))

    def opened(nodes: bytes, times: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, n = np.frombuffer(nodes, "<i8"), np.frombuffer(times, "<i8")
        return node, n, np.frombuffer(v, width).astype(np.float64).reshape(len(node), -1)

    def compare(low: tuple[bytes, bytes, bytes], high: tuple[bytes, bytes, bytes], own: bool) -> pd.DataFrame:
        node_l, n_l, vl = opened(*low)
        node_r, n_r, vr = (node_l, n_l, vl) if own else opened(*high)
        left, right = node_l, node_r
        count_l, count_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        a, b = [], []
        for i, j in linked_pairs(vl, vr, threshold):
            if own:
                i, j = i[i != j], j[i != j]
            np.add.at(count_l, i, n_r[j])
            if not own:
                np.add.at(count_r, j, n_l[i])
            offset = 0 if own else len(left)
            keep = forest(len(left) + len(right), i, j + offset)
            a.append(i[keep])
            b.append(j[keep] + offset)
        nodes = np.concatenate([node_l, node_r])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        keep = forest(len(nodes), a, b)
        counts = pd.DataFrame({"a": np.concatenate([node_l, node_r]) if not own else node_l, "links": np.concatenate([count_l, count_r]) if not own else count_l})
        counts = counts[counts.links > 0]
        counts["b"] = counts["a"]
        return pd.concat([counts[["a", "b", "links"]], pd.DataFrame({"a": nodes[a[keep]], "b": nodes[b[keep]], "links": 0})])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                low, high = ([batch.column(j)[i].as_buffer() for j in side] for side in ((0, 1, 2), (3, 4, 5)))
                links = compare(low, high, batch.column(6)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(links[x].to_numpy(), pa.int64()) for x in ("a", "b", "links")], ["a", "b", "links"])

    # A tile meets the tiles of the round in every cell that its own may link with; a pair meets once, its smaller tile on the left.
    parted = F.expr(f"pmod(xxhash64(cell, slice), {rounds})")
    mine = tiles.select("dim", "cell", F.struct("cell", "slice").alias("mine"), "nodes", "times", "v")
    theirs = tiles.select("dim", F.col("cell").alias("other"), F.struct("cell", "slice").alias("theirs"), *[F.col(x).alias(f"their_{x}") for x in ("nodes", "times", "v")], parted.alias("round"))
    passed = []
    for turn in range(rounds):
        sent = F.broadcast(theirs.where(F.col("round") == turn).drop("round"))
        dealt = mine.repartition(parts).join(F.broadcast(meets), ["dim", "cell"]).join(sent, ["dim", "other"]).where("mine <= theirs")
        met = dealt.select("nodes", "times", "v", "their_nodes", "their_times", "their_v", (F.col("mine") == F.col("theirs")).alias("own"))
        passed.append(written(met.mapInArrow(meet, "a long, b long, links long"), "near-links"))
    for table in (homed, tiles):
        discard(table)
    found = reduce(DataFrame.unionByName, passed)
    linked = components(found.filter("a <> b"))
    links = found.filter("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    of_node = (
        copies.select("key", "node", "n")
        .join(links, F.col("node") == F.col("a"), "left").drop("a")
        .join(linked.withColumnRenamed("node", "b"), F.col("node") == F.col("b"), "left")
        .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked_rows = by_key.select("vec_id", "key").join(of_node, "key").select("vec_id", "n_links", "component_id")
    taking_part = usable_flag(vectors, id_col, vector_col)
    rest = taking_part.filter("NOT takes_part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def usable_flag(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    from cardloom.llm.vectors import usable

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.select("vec_id", (F.coalesce(usable(F.col("v")), F.lit(False)) & F.col("vec_id").isNotNull()).alias("takes_part"))


def cell_pairs(cells: list[tuple], pivots: list[np.ndarray], threshold: float) -> list[tuple[int, int, int, int, int]]:
    """(dim, cell, slices, other cell, its slices) in both directions where a link between the cells is possible.

    With t the threshold's angle, vectors x and y of the cells of pivots p and q can link only if the
    angle between p and q is at most (x to p) + (y to q) + t.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    out = []
    for dim, cell, far, slices in cells:
        for dim2, cell2, far2, slices2 in cells:
            if dim != dim2:
                continue
            if cell != cell2 and min(cell, cell2) >= 0:
                apart = math.acos(max(-1.0, min(1.0, float(pivots[cell] @ pivots[cell2]))))
                if apart > far + far2 + reach:
                    continue
            out.append((dim, cell, slices, cell2, slices2))
    return out
