"""Centroid clustering over subvector dictionaries, in exact integers.

Vectors are turned into integers and written once, in chunks: a chunk holds, for each block of neighbouring dimensions, the
distinct subvectors that occur in it and a code for each vector. Nothing is lost, a code stands for its subvector. In each round a
task computes the squared distances of a chunk's distinct subvectors to all centroids once, and a vector's distance is the sum of
the partial distances under its codes; the sums for the new centroids are the codes' counts times their subvectors. Blocks begin as
single dimensions and neighbours grow together as long as their dictionary stays small against the chunk, so repeated
vectors end up as one code and unrelated dimensions as one code each.

Only the centroids and their sums (``k`` times the dimensions) pass through the driver. Chunks are rows of a table
in the shared folder, so a lost executor costs its tasks alone, and no key is shuffled that a vector could make hot.

Cases: vectors that are null, of another length or that hold null, NaN or infinite components take no part. Repeated rows count as often
as they stand; a null id is an id like any other (hashed as the empty text). With fewer vectors than ``k`` there are as many
centroids as vectors; an empty table gives an empty result. Extra columns are not read. Components beyond 2**62 after scaling stand
for 2**62; distances and inertias that a long can't hold are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded, materialise

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a chunk.
CHUNK = 32_768
#: Two blocks are joined while their dictionary holds at most one subvector for so many vectors.
SHARE = 8
_LARGEST, _LIMIT = 2**63 - 1, 2.0**62
_ENCODED = "ids array<long>, blocks array<struct<at int, width int, subvectors binary, codes binary>>"
#: Rows of a round's sums that are not a dimension: vectors and summed distances.
_COUNT, _DISTANCE = -1, -2


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dimensions) & ~F.exists(vector, bad), F.lit(False))


def _dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers and the code of each value; by a table of presence where the range is small."""
    low = int(values.min())
    span = int(values.max()) - low + 1
    if span > 4 * len(values):
        return np.unique(values, return_inverse=True)
    there = np.zeros(span, bool)
    there[values - low] = True
    code = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, code[values - low]


def _blocks(vectors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(first dimension, subvectors, codes)`` of the blocks of a chunk."""
    found = []
    for k in range(vectors.shape[1]):
        values, codes = _dictionary(vectors[:, k])
        found.append((k, values[:, None], codes))
    joined = True
    while joined:
        joined, rest, k = False, [], 0
        while k < len(found):
            if k + 1 < len(found) and len(found[k][1]) <= len(vectors) // SHARE and len(found[k + 1][1]) <= len(vectors) // SHARE:
                (at, a, x), (_, b, y) = found[k], found[k + 1]
                pairs, codes = _dictionary(x * len(b) + y)
                if len(pairs) <= max(1, len(vectors) // SHARE):
                    rest.append((at, np.hstack([a[pairs // len(b)], b[pairs % len(b)]]), codes))
                    joined, k = True, k + 2
                    continue
            rest.append(found[k])
            k += 1
        found = rest
    return found


def encode(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, chunk: int = CHUNK) -> DataFrame:
    """The usable vectors of ``df`` as a table of dictionary-encoded chunks."""

    def pack(ids: list, parts: list) -> pa.RecordBatch:
        vectors = np.concatenate(parts)
        rows = []
        for at, subvectors, codes in _blocks(vectors):
            kind = np.uint16 if len(subvectors) <= 2**16 else np.uint32
            rows.append({"at": at, "width": subvectors.shape[1], "subvectors": subvectors.astype("<i8").tobytes(), "codes": codes.astype(kind).tobytes()})
        return pa.RecordBatch.from_pylist([{"ids": pa.concat_arrays(ids).to_pylist(), "blocks": rows}], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, have = [], [], 0
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            whole = np.clip(np.floor(values * scale), -_LIMIT, _LIMIT).astype(np.int64)
            for i in range(0, len(whole), chunk):
                part = whole[i : i + chunk]
                if have + len(part) > chunk:
                    yield pack(ids, parts)
                    ids, parts, have = [], [], 0
                ids.append(batch.column(0).slice(i, len(part)))
                parts.append(part)
                have += len(part)
        if have:
            yield pack(ids, parts)

    bounded(df.sparkSession)
    rows = df.filter(usable(F.col(vector), dimensions)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return materialise(rows.mapInArrow(run, _ENCODED))


_SCHEMA = pa.schema(
    [("ids", pa.list_(pa.int64())), ("blocks", pa.list_(pa.struct([("at", pa.int32()), ("width", pa.int32()), ("subvectors", pa.binary()), ("codes", pa.binary())])))]
)


def first_centroids(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, as whole numbers; those that share an id go by their components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    rows = df.filter(usable(F.col(vector), dimensions)).select(F.sha2(text, 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    found = [r.v for r in rows.orderBy("h", "v").limit(k).collect()]
    return np.clip(np.floor(np.array(found, np.float64).reshape(-1, dimensions) * scale), -_LIMIT, _LIMIT).astype(np.int64)


def _open(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in row["blocks"]:
        subvectors = np.frombuffer(b["subvectors"], "<i8").reshape(-1, b["width"])
        yield b["at"], subvectors, np.frombuffer(b["codes"], np.uint16 if len(subvectors) <= 2**16 else np.uint32)


def _nearest(blocks: list, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the first on ties) and its squared distance; Python integers where 64 bits might not do."""
    most = 2 * max([int(np.abs(centroids).max()), *[int(np.abs(s).max()) for _, s, _ in blocks]])
    kind = np.int64 if most * most * centroids.shape[1] < _LARGEST else object
    total = np.zeros((len(centroids), n), kind)
    for at, subvectors, codes in blocks:
        diff = subvectors.astype(kind)[None] - centroids[:, None, at : at + subvectors.shape[1]].astype(kind)
        partial = (diff * diff).sum(axis=2)
        total += partial[:, codes]
    best = total.argmin(axis=0)
    return best, total[best, np.arange(n)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


@dataclass
class Round:
    count: list[int]
    distance: list[int]
    sums: list[list[int]]


def measure(encoded: DataFrame, centroids: np.ndarray) -> Round:
    """Sizes, summed distances and sums of components of the clusters around ``centroids``."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, distance, sums = [0] * k, [0] * k, np.zeros((k, dimensions), object)
        for row in _rows(batches):
            blocks = list(_open(row))
            best, near = _nearest(blocks, centroids, len(row["ids"]))
            for c in range(k):
                own = best == c
                count[c] += int(own.sum())
                distance[c] += sum(min(x, _LARGEST) for x in near[own].tolist())
                for at, subvectors, codes in blocks:
                    times = np.bincount(codes[own], minlength=len(subvectors))
                    kind = np.int64 if int(np.abs(subvectors).max()) * len(best) < _LARGEST else object
                    sums[c, at : at + subvectors.shape[1]] += times.astype(kind) @ subvectors.astype(kind)
        rows = [(c, what, value) for c in range(k) for what, value in ((_COUNT, count[c]), (_DISTANCE, distance[c]), *enumerate(sums[c].tolist())) if count[c]]
        kinds = (pa.int32(), pa.int32(), pa.string())
        yield pa.record_batch([pa.array([str(r[i]) if i == 2 else r[i] for r in rows], kinds[i]) for i in range(3)], names=["cluster", "what", "value"])

    found = encoded.mapInArrow(run, "cluster int, what int, value string").groupBy("cluster", "what").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = Round([0] * k, [0] * k, [[0] * dimensions for _ in range(k)])
    for r in found.collect():  # at most k * (dimensions + 2) rows
        if r.what == _COUNT:
            out.count[r.cluster] = int(r.value)
        elif r.what == _DISTANCE:
            out.distance[r.cluster] = int(r.value)
        else:
            out.sums[r.cluster][r.what] = int(r.value)
    return out


def fit(encoded: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds; an empty one stays where it is. Rounds after one that moves nothing would change nothing."""
    for _ in range(rounds):
        found = measure(encoded, centroids)
        moved = np.array([[s // n for s in sums] if n else old for n, sums, old in zip(found.count, found.sums, centroids.tolist())], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def assign(encoded: DataFrame, centroids: np.ndarray, id: str = "vec_id") -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            best, near = _nearest(list(_open(row)), centroids, len(row["ids"]))
            near = near if near.dtype == np.int64 else [min(x, _LARGEST) for x in near]
            yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(best.astype(np.int32)), pa.array(near, pa.int64())], names=[id, "cluster", "distance"])

    return encoded.mapInArrow(run, f"`{id}` long, cluster int, distance long")


def cluster_table(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector."""
    spark = bounded(df.sparkSession)
    centroids = first_centroids(df, id, vector, dimensions, k, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    encoded = encode(df, id, vector, dimensions, scale)
    centroids = fit(encoded, centroids, rounds)
    inertia = measure(encoded, centroids).distance
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    most = [min(x, _LARGEST) for x in inertia]
    return assign(encoded, centroids, id).select(
        id, "cluster", "distance", per(most).cast("long").alias("cluster_inertia"), F.lit(min(sum(inertia), _LARGEST)).cast("long").alias("inertia"), per(names).alias("centroid_sha256")
    )
