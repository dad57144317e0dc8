"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, ``floor(1024 * x)``. Data and queries are dealt to cells by the nearest of some pivots, and cells with too
many rows again by pivots of their own, until blocks are of bounded size; equal vectors are split by hash at last. Each
block is summed up by a centre, its covering radius, its highest norm and, for queries, the worst kth score known. No
inner product of two balls with centres q, d and radii a, b exceeds ``q.d + a|d| + b|q| + ab``, nor
(Q^2 + D^2 - s^2) / 2 with the highest norms Q, D and the least distance s of the balls. Pairs of cells, then pairs of
the blocks in them, go where the bound is below the worst kth score of the queries: their rows are never brought together.

For the pairs left a task takes a data block and all query blocks left for it, up to some thousands of rows, builds a cover tree over either side, so one
over a data block for many query blocks, and walks both together with the same bounds against each query group's worst kth score. That is done first for the most promising block of each query block, then, with
the scores it gave, for those still left. First scores come from a bounded sample of the
data, against which all queries are scored; they are scores of true candidates, so they cut only what
can't be among the k best. The lists of all blocks are merged by rank.

Pivots and first scores use samples of bounded size; all rows are indexed and searched, and the
result is exact. Vectors that are null, empty or hold a null or non-finite component take no part, and only
vectors of one length are compared. Candidates with the query's own id are left out; queries that repeat an
id are one query (the smallest vector), candidates that do are candidates each. Ties go to the smaller id. Other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded, materialise

SCALE = 1024
K = 10
#: Rows from which pivots and first scores are taken.
SAMPLE = 2048
PIVOTS = 32
DATA_BLOCK, QUERY_BLOCK = 8192, 512
#: Query rows that meet a data block in one task; the last query block may go beyond.
BUNDLE = 8192
#: Rounds in which cells are split, sampled rows and new pivots of a cell in each, and cells that one round splits at most.
ROUNDS, CELL_SAMPLE, CELL_PIVOTS, CELLS = 4, 48, 16, 4096
LEAF, QUERY_LEAF = 64, 16
#: Pairs that are scored at once rather than walked further down: products of a few pairs each cost more than what they save.
DIRECT = 2048
#: Children of a tree node, at most; a net with more points goes on a level below.
FAN = 16
_HELD = 200_000


class Node:
    __slots__ = ("rows", "centre", "norm", "radius", "top", "children", "centres", "norms", "radii", "tops")

    def __init__(self, x: np.ndarray, square: np.ndarray, rows: np.ndarray, centre: int):
        self.rows, self.centre = rows, x[centre]
        self.norm = float(np.sqrt(square[centre]))
        self.radius = float(np.sqrt(_distances(x, square, rows, centre).max()))
        self.top = float(square[rows].max())
        self.children: list[Node] = []

    def adopt(self, children: list[Node]) -> None:
        self.children = children
        self.centres = np.array([c.centre for c in children])
        self.norms, self.radii, self.tops = (np.array([getattr(c, k) for c in children]) for k in ("norm", "radius", "top"))


def _distances(x: np.ndarray, square: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
    """Squared, of rows from one of them; exact for integers."""
    return np.maximum(square[rows] - 2 * (x[rows] @ x[centre]) + square[centre], 0)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Each node's children are centred on a net of half its covering radius, of at most ``FAN`` points at a time.

    Small or unsplittable nodes are leaves.
    """
    square = (x * x).sum(1)
    root = Node(x, square, np.arange(len(x)), 0)
    todo = [root]
    while todo:
        node = todo.pop()
        rows = node.rows
        if len(rows) <= leaf or node.radius == 0:
            continue
        near = ((x[rows] - node.centre) ** 2).sum(1)
        owner, centres = np.zeros(len(rows), np.int64), [int(near.argmin())]
        near = _distances(x, square, rows, rows[centres[0]])
        while near.max() > (node.radius / 2) ** 2 and len(centres) < FAN:
            centres.append(int(near.argmax()))
            d = _distances(x, square, rows, rows[centres[-1]])
            closer = d < near
            owner[closer], near = len(centres) - 1, np.minimum(near, d)
        parts = [(rows[owner == c], rows[centres[c]]) for c in range(len(centres)) if (owner == c).any()]
        if len(parts) > 1:
            node.adopt([Node(x, square, *p) for p in parts])
            todo += node.children
    return root


def _bounds(inner, a_norm, a_radius, a_top, b_norm, b_radius, b_top) -> np.ndarray:
    """No inner product of two balls is higher: by Cauchy-Schwarz, and by the least distance of their points."""
    apart = np.sqrt(np.maximum(a_norm * a_norm + b_norm * b_norm - 2 * inner, 0)) - a_radius - b_radius
    return np.minimum(inner + a_radius * b_norm + b_radius * a_norm + a_radius * b_radius, (a_top + b_top - np.maximum(apart, 0) ** 2) / 2) + 1e-6 + 1e-9 * (a_top + b_top)


def _first_k(row: np.ndarray, hit: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller id."""
    order = np.lexsort((ids[hit], -score, row))
    row, hit, score = row[order], hit[order], score[order]
    own = np.arange(len(row)) - np.searchsorted(row, row)
    return row[own < k], hit[own < k], score[own < k]


def dual_search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, data row, score)`` of the k best of each query above its floor; ids break ties.

    ``seen`` counts the node pairs that were cut, the vector pairs that were scored and the products they were scored in.
    """
    seen = {} if seen is None else seen
    best = np.full((len(q), k), -np.inf)
    worst = floor.astype(float).copy()
    q_top = (q * q).sum(1)
    q_norm = np.sqrt(q_top)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    waiting = 0
    stack = [(np.inf, cover_tree(q, QUERY_LEAF), cover_tree(d))]
    while stack:
        bound, a, b = stack.pop()
        if bound < worst[a.rows].min():
            seen["cut"] = seen.get("cut", 0) + 1
            continue
        if not a.children and not b.children or len(a.rows) * len(b.rows) <= DIRECT:
            at = a.rows
            at = at[_bounds(q[at] @ b.centre, q_norm[at], 0.0, q_top[at], b.norm, b.radius, b.top) >= worst[at]]
            score = q[at] @ d[b.rows].T
            seen["scored"], seen["products"] = seen.get("scored", 0) + score.size, seen.get("products", 0) + 1
            score[q_ids[at][:, None] == d_ids[b.rows][None, :]] = -np.inf
            i, j = np.nonzero((score >= worst[at][:, None]) & (score > -np.inf))
            if not len(i):
                continue
            held.append((at[i], b.rows[j], score[i, j]))
            waiting += len(i)
            if waiting > _HELD:
                held = [_first_k(*(np.concatenate(c) for c in zip(*held)), d_ids, k)]
                waiting = 0
            some = np.unique(i)
            own = at[some]
            best[own] = np.partition(np.concatenate([best[own], score[some]], 1), -k, 1)[:, -k:]
            worst[own] = np.maximum(worst[own], best[own, 0])
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            found = _bounds(a.centres @ b.centre, a.norms, a.radii, a.tops, b.norm, b.radius, b.top)
            pairs = [(c, b) for c in a.children]
        else:
            found = _bounds(b.centres @ a.centre, b.norms, b.radii, b.tops, a.norm, a.radius, a.top)
            pairs = [(a, c) for c in b.children]
        stack += [(found[n], *pairs[n]) for n in np.argsort(found, kind="stable")]  # the most promising pair is next
    row, hit, score = (np.concatenate(c) for c in zip(*held))
    fine = score >= worst[row]
    return _first_k(row[fine], hit[fine], score[fine], d_ids, k)


def _integers(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad) & F.col(id).isNotNull()
    return vectors.filter(fine).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different rows, each the one furthest from those before."""
    centres, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(centres) < count and near.max() > 0:
        centres.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[centres[-1]]) ** 2).sum(1))
    return x[centres]


_DEALT = "id long, v array<double>, size int, floor double, cell string"


def _assigned(rows: DataFrame, pivots: dict[tuple[int, str], np.ndarray]) -> DataFrame:
    """Rows of the cells that have pivots go to the cell of the nearest one."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, cell = batch.column(2).to_numpy(), np.array(batch.column(4).to_pylist(), object)
            for key in set(zip(size.tolist(), cell.tolist())) & shared.value.keys():
                at = np.flatnonzero((size == key[0]) & (cell == key[1]))
                x, p = _matrix(batch.column(1).take(pa.array(at))), shared.value[key]
                own = ((p**2).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
                cell[at] = [f"{key[1]}.{k}" for k in own]
            yield batch.set_column(4, "cell", pa.array(cell.tolist(), pa.string()))

    return rows.mapInArrow(run, _DEALT)


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with ``block``: cells of more than ``limit`` rows are split by pivots of their own, what is left of such by hash."""
    counts = lambda: rows.groupBy("size", "cell").agg(F.count("*").alias("n"))
    for _ in range(ROUNDS):
        big = counts().filter(F.col("n") > limit).orderBy(F.desc("n"), "size", "cell").limit(CELLS).collect()
        if not big:
            return rows.withColumn("block", F.col("cell"))
        some = Window.partitionBy("size", "cell").orderBy(F.xxhash64("id", F.lit(5)), "v")
        named = F.broadcast(rows.sparkSession.createDataFrame([(r["size"], r.cell) for r in big], "size int, cell string"))  # at most CELLS rows
        sample = rows.join(named, ["size", "cell"], "left_semi").withColumn("r", F.row_number().over(some)).filter(F.col("r") <= CELL_SAMPLE)
        held: dict[tuple[int, str], list] = {}
        for r in sample.select("size", "cell", "v").collect():  # at most CELLS * CELL_SAMPLE rows
            held.setdefault((r["size"], r.cell), []).append(r.v)
        pivots = {k: _far_apart(np.array(v), CELL_PIVOTS) for k, v in held.items()}
        pivots = {k: p for k, p in pivots.items() if len(p) > 1}
        if not pivots:
            break
        rows = materialise(_assigned(rows, pivots))
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.ceil(F.col("n") / limit)).cast("string")
    return materialise(rows.join(counts(), ["size", "cell"]).withColumn("block", F.concat_ws("#", "cell", part)).drop("n"))


_SUMMARY = "size int, cell string, block string, centre array<double>, radius double, top double, worst double, n long"


def _summaries(blocks: DataFrame) -> DataFrame:
    """Centre, covering radius, highest squared norm, worst floor and number of rows of each block."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v"))
        centre = np.rint(x.mean(0))
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        first = {c: [table.column(c)[0].as_py()] for c in ("size", "cell", "block")}
        return pa.table(
            {"size": pa.array(first["size"], pa.int32()), "cell": first["cell"], "block": first["block"], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "top": [float((x * x).sum(1).max())], "worst": [float(table.column("floor").to_numpy().min())], "n": [table.num_rows]}
        )

    return materialise(blocks.groupBy("size", "cell", "block").applyInArrow(run, _SUMMARY))


def _cells(summaries: DataFrame) -> DataFrame:
    """Balls of the first level's cells around those of their blocks; there are at most PIVOTS of each vector length."""
    top = summaries.withColumn("root", F.substring_index("cell", ".", 1))
    named = top.groupBy("size", "root").agg(F.min_by("centre", "block").alias("centre"), F.max("top").alias("top"), F.min("worst").alias("worst"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = top.join(named.select("size", "root", F.col("centre").alias("c")), ["size", "root"]).groupBy("size", "root").agg(F.max(apart + F.col("radius")).alias("radius"))
    return named.join(reach, ["size", "root"])


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs ``q, d`` of summaries whose bound reaches the worst score, with the ``bound``."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    inner = F.aggregate(F.zip_with("q.centre", "d.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q, d, a, b = norm(F.col("q.centre")), norm(F.col("d.centre")), F.col("q.radius"), F.col("d.radius")
    apart = F.greatest(F.sqrt(F.greatest(q * q + d * d - 2 * inner, F.lit(0.0))) - a - b, F.lit(0.0))
    tops = F.col("q.top") + F.col("d.top")
    bound = F.least(inner + a * d + b * q + a * b, (tops - apart * apart) / 2) + 1e-6 + 1e-9 * tops
    return pairs.withColumn("bound", bound).filter(F.col("bound") >= F.col("q.worst"))


def _block_pairs(asked: DataFrame, data: DataFrame) -> DataFrame:
    """``size, part, block, bound, n`` (rows of the query block) of the block pairs that no bound cuts: first cells, then the blocks of those left."""
    pack = lambda df, name: df.select("size", F.substring_index("cell", ".", 1).alias(f"{name}_root"), F.struct("block", "centre", "radius", "top", "worst", "n").alias(name))
    cell = lambda df, name: _cells(df).select("size", F.col("root").alias(f"{name}_root"), F.struct("centre", "radius", "top", "worst").alias(name))
    roots = _promising(cell(asked, "q").join(cell(data, "d"), "size")).select("size", "q_root", "d_root")
    pairs = roots.join(pack(asked, "q"), ["size", "q_root"]).join(pack(data, "d"), ["size", "d_root"])
    return materialise(_promising(pairs).select("size", F.col("q.block").alias("part"), F.col("d.block").alias("block"), "bound", F.col("q.n").alias("n")))


def _bundles(pairs: DataFrame, limit: int) -> DataFrame:
    """``size, part, block, bundle``: query blocks of a data block, neighbours first, in bundles of about ``limit`` rows."""
    before = F.sum("n").over(Window.partitionBy("size", "block").orderBy("part")) - F.col("n")
    return pairs.select("size", "part", "block", F.floor(before / limit).alias("bundle"))


def _searched(asked: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of each pair of blocks; a data block's rows travel once for each of its bundles."""
    dealt = materialise(_bundles(pairs, BUNDLE))
    left = asked.withColumnRenamed("block", "part").join(dealt, ["size", "part"]).select("size", "block", "bundle", F.lit(True).alias("ask"), "id", "v", "floor")
    right = data.join(dealt.select("size", "block", "bundle").distinct(), ["size", "block"]).select("size", "block", "bundle", F.lit(False).alias("ask"), "id", "v", F.lit(None).cast("double").alias("floor"))

    def search(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        x, ids, floor = _matrix(table.column("v")), table.column("id").to_numpy(), table.column("floor").to_numpy(zero_copy_only=False)
        out = ([], [], [])
        if ask.any() and not ask.all():
            q, d = np.flatnonzero(ask), np.flatnonzero(~ask)
            row, hit, score = dual_search(x[q], ids[q], floor[q], x[d], ids[d], k)
            out = (ids[q][row], ids[d][hit], score.astype(np.int64))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return materialise(left.unionByName(right).groupBy("size", "block", "bundle").applyInArrow(search, "query_id long, vec_id long, score long"))


def top_k(queries: DataFrame, data: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query."""
    spark = bounded(data.sparkSession)
    data = _integers(data, id, vector, scale)
    asked = _integers(queries, id, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    sample = data.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r.v) for r in sample}:
        own = [r for r in sample if len(r.v) == size]
        by_size[size] = (np.array([r.id for r in own]), np.array([r.v for r in own]))
    shared = spark.sparkContext.broadcast(by_size)  # at most SAMPLE rows

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            floor = np.full(len(size), -np.inf)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                ids, x = shared.value.get(int(s), (np.zeros(0), np.zeros((0, int(s)))))
                if len(ids) > k:
                    score = _matrix(batch.column(1).take(pa.array(at))) @ x.T
                    score[batch.column(0).to_numpy()[at][:, None] == ids[None, :]] = -np.inf
                    floor[at] = np.partition(score, -k, 1)[:, -k]
            yield pa.record_batch({"id": batch.column(0), "v": batch.column(1), "size": pa.array(size, pa.int32()), "floor": floor, "cell": pa.array(["c"] * len(size))})

    pivots = {(s, "c"): _far_apart(x, PIVOTS) for s, (_, x) in by_size.items()}
    # cells of the first level are "0", "1" and so on, or "c" for a vector length outside the sample
    short = lambda df: df.withColumn("cell", F.regexp_replace("cell", r"^c\.", ""))
    plain = data.select("id", "v", F.size("v").alias("size"), F.lit(0.0).alias("floor"), F.lit("c").alias("cell"))
    data = _blocks(materialise(short(_assigned(plain, pivots))), DATA_BLOCK)
    asked = _blocks(materialise(short(_assigned(asked.mapInArrow(first_scores, _DEALT), pivots))), QUERY_BLOCK)
    about = _summaries(data)
    pairs = _block_pairs(_summaries(asked), about)
    # the most promising block of each query block first; its scores cut more of the others
    by = Window.partitionBy("size", "part").orderBy(F.desc("bound"), "block")
    first = materialise(pairs.withColumn("r", F.row_number().over(by)).filter("r = 1").drop("r"))
    found = _searched(asked, data, first, k)
    kth = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    asked = materialise(asked.join(kth, "id", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth"))
    worst = asked.groupBy("size", F.col("block").alias("part")).agg(F.min("floor").alias("worst"))
    left = pairs.join(first.select("size", "part", "block"), ["size", "part", "block"], "left_anti").join(worst, ["size", "part"]).filter(F.col("bound") >= F.col("worst"))
    found = found.unionByName(_searched(asked, data, left.select("size", "part", "block", "n"), k))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` against all rows."""
    return top_k(vectors.filter(F.col("vec_id") % every == 0), vectors, k)
