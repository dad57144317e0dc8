"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its inner s-mers is that of
its first or its last one. That depends on the k-mer alone, so the same passage gives the same anchors in any
document, and every window of k - s + 1 k-mers holds one. A text shorter than k has itself as
its only anchor; an empty one has none.

The fingerprint keeps the smallest anchor hash of each of ``BINS`` bins, hashed anew to 4 hex digits (``ffff``:
an empty bin). The likeness of two fingerprints is the share of equal bins among those that at
least one fills, an estimate of the Jaccard similarity of the anchor sets; two empty ones are alike.

Null texts count as empty. Rows that repeat a doc_id are ordered by the hash of their text; a null
doc_id counts as the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded, partitions
from watchloom.llm.text_hash import fold, mix64, rolling, text_slices

K, S = 15, 7
_BIN_BITS = 7
BINS = 1 << _BIN_BITS
_CHUNK = 1 << 20
_EMPTY = np.uint16(0xFFFF)
_LEAST = -(2**63)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a whole text."""
    code = mix64(_codes(text or "") + np.uint64(1))
    n = len(code)
    if n < k:
        return (np.zeros(1, np.int64), np.array([fold(code)], np.uint64)) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    where, found = [], []
    for at in range(0, n - k + 1, _CHUNK):
        part = code[at : at + _CHUNK + k - 1]
        inner = rolling(part, s)
        low, have, count = inner, 1, k - s + 1
        while 2 * have <= count:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        m = len(part) - k + 1
        if have < count:
            low = np.minimum(low[:m], low[count - have : count - have + m])
        pick = np.flatnonzero((low == inner[:m]) | (low == inner[k - s : k - s + m]))
        where.append(pick + at)
        found.append(rolling(part, k)[pick])
    return np.concatenate(where), np.concatenate(found)


def sketch(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BINS, _EMPTY)
    if len(hashes):
        # the bin on top, the rest of the hash below it: all 64 bits decide which is the smallest
        key = np.unique((hashes << np.uint64(64 - _BIN_BITS)) | (hashes >> np.uint64(_BIN_BITS)))
        bins = (key >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        out[bins[first]] = (mix64(key[first]) % np.uint64(0xFFFF)).astype(np.uint16)
    return out


def fingerprint(text: str | None) -> np.ndarray:
    return sketch(anchors(text)[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != _EMPTY) | (b != _EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def as_text(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def match_positions(a: str | None, b: str | None) -> list[tuple[int, int]]:
    """Places of anchors that occur once in either text and in both, ordered by the place in ``a``."""
    sides = []
    for text in (a, b):
        where, found = anchors(text)
        values, first, n = np.unique(found, return_index=True, return_counts=True)
        sides.append((values[n == 1], where[first[n == 1]]))
    _, i, j = np.intersect1d(sides[0][0], sides[1][0], return_indices=True)
    return sorted(zip(sides[0][1][i].tolist(), sides[1][1][j].tolist()))


def anchor_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, place, hash`` of every anchor of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _ in text_slices(batch, text):
                found = [anchors(t.as_py()) for t in batch.column(1).slice(i, j - i)]
                row = np.repeat(np.arange(i, j), [len(x[0]) for x in found])
                place, hash = (np.concatenate([x[c] for x in found]) for c in (0, 1))
                yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(row)), "place": pa.array(place, pa.int64()), "hash": hash.view(np.int64)})

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, "doc_id long, place long, hash long")


def _with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows ``(doc_id, key, text, bucket, ghost)``, where each bucket, sorted by ``ghost, key desc``, is followed by its successor."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(id).cast("long"), F.lit(_LEAST)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * partitions(bounded(docs.sparkSession))
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    cuts = np.array(sorted(set(found)), np.int64)

    bucket = _bucket_udf(cuts)
    # the largest key of each bucket follows the smallest one of the next bucket above; that of the top one follows the last
    tops = [(r.bucket, r.top) for r in rows.select("key", bucket("key").alias("bucket")).groupBy("bucket").agg(F.max("key").alias("top")).collect()]
    order = sorted(tops)
    follows = {top: order[(i + 1) % len(order)][0] for i, (_, top) in enumerate(order)}
    keys = np.array(sorted(follows), np.int64)
    targets = np.array([follows[k] for k in keys.tolist()], np.int64)
    own = rows.withColumn("bucket", bucket("key")).withColumn("ghost", F.lit(False))
    ghost = rows.filter(F.col("key").isin([int(k) for k in keys])).withColumn("bucket", _target_udf(keys, targets)("key")).withColumn("ghost", F.lit(True))
    return own.unionByName(ghost)


def _bucket_udf(cuts: np.ndarray):
    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="left").astype(np.int32))

    return bucket


def _target_udf(keys: np.ndarray, targets: np.ndarray):
    @F.pandas_udf("int")
    def target(own: pd.Series) -> pd.Series:
        return pd.Series(targets[np.searchsorted(keys, own.to_numpy())].astype(np.int32))

    return target


def fingerprint_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            doc, bucket, ghost = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i, t in enumerate(batch.column(1)):
                if ghost[i] and (held is None or held[0] != bucket[i]):
                    continue  # a second ghost: the bucket has its successor already
                t = t.as_py()
                own = fingerprint(t)
                if held is not None:
                    _, d, x, fp = held
                    half = len(x) // 2
                    edited = x[: len(x) - half] + t[:half]
                    fp2 = fp if edited == x else fingerprint(edited)
                    out.append((d, len(x), hashlib.sha256(edited.encode()).hexdigest(), as_text(fp), as_text(fp2), likeness(fp, fp2), likeness(fp, own)))
                held = None if ghost[i] else (bucket[i], doc[i], t, own)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    rows = _with_next(docs, id, text).withColumn("tie", F.xxhash64("text"))
    near = rows.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("key"), "tie")
    return near.select("doc_id", "text", "bucket", "ghost").mapInArrow(run, schema)
