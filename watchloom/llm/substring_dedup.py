"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document. Its anchor is the smallest hash among
the ``anchor``-word shingles it holds, so equal windows have equal anchors wherever they stand.

The index is a folder of immutable runs and of manifests that name them. A run is a Parquet table of postings
``(anchor, key)``, bucketed and sorted by anchor; ``key`` stands for a document's id and text. Postings of an anchor that
fills a part of a slice of texts lie apart, bucketed by document, as no bucket should hold a line that all documents share; there are
few such anchors, so they are met by a broadcast of those in question. A task writes one file of either kind. The newest
manifest that was written whole counts, so a lost driver loses nothing and an index can be opened again. Texts stay where
their owner keeps them. A new batch

1. writes its own postings as a run,
2. is merge-joined with each older run, bucket by bucket: an anchor is *needed* if it occurs twice in the batch
   or once in the batch and once in history; the postings met name the historical documents to read,
3. verifies: the whole windows around needed anchors, of the batch and of these documents only,
   are hashed twice over (64 and 32 bits, with different salts) and grouped; all but the first window of a group are repeats, which
   are written once,
4. compacts the runs into one when there are more than ``max_runs``, and writes the next manifest.

Windows meet by anchor; those of a hot anchor, which stands in many places, by their own hash, so none fills a task.

A document is identified by its id and the hash of its text. Historical documents count as earlier
than the batch; inside a batch the order is doc_id (null first), text hash, word position. Rows that repeat both
id and text are one document: they get the same result and are no copies of each other. A null
or empty text has no words. Documents shorter than a window lose nothing. Texts may be of any length; other columns pass through
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import bloom
from watchloom.llm.storage import bounded, materialise, partitions, release, shared_dir, unused
from watchloom.llm.text_hash import join, mix64, text_slices, window_hashes, words

WINDOW = 20
ANCHOR = 5
#: Places from which on an anchor is hot.
HOT = 32
#: Needed anchors up to which all tasks get them as a bit filter (8 MB); more are joined with the documents.
FILTERED = bloom.MAX_BITS // 10
_CHECK_SALT = 0x51ED2701
_MAX = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over each ``size`` neighbours, by doubling."""
    n, have = len(x) - size + 1, 1
    while 2 * have <= size:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:n], x[size - have : size - have + n]) if have < size else x[:n]


def _window_anchors(w, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, for each window its anchor, and which windows lie in one document."""
    small, ok = window_hashes(w, anchor)
    count = window - anchor + 1
    if len(small) < count:
        return small, np.zeros(0, np.uint64), np.zeros(0, bool)
    small = np.where(ok, small, _MAX)
    at = np.arange(len(small) - count + 1)
    return small, _sliding(small, count, np.minimum), w.doc[at] == w.doc[at + window - 1]


def _key(doc: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    return join(mix64(doc.view(np.uint64)), text_hash.view(np.uint64)).view(np.int64)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document and text hash of the rows of ``_keyed``; a null id is the least."""
    return batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()


def postings(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(anchor, key, hot)``: the selected shingles of all windows of ``doc, text_hash, text``; hot ones stand more than HOT times in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _key(*_ids(batch))
            for i, _, raw, off in text_slices(batch, "text"):
                w = words(raw, off)
                small, low, ok = _window_anchors(w, window, anchor)
                if not ok.any():
                    continue
                # a shingle is selected if some window around it has no smaller one
                pad = np.zeros(window - anchor, np.uint64)
                top = _sliding(np.concatenate([pad, np.where(ok, low, 0), pad]), window - anchor + 1, np.maximum)
                at = np.flatnonzero((top == small) & (small != _MAX))
                _, own, n = np.unique(small[at], return_inverse=True, return_counts=True)
                yield pa.record_batch({"anchor": small[at].view(np.int64), "key": key[i + w.doc[at]], "hot": n[own] > HOT})

    return keyed.mapInArrow(run, _RUN)


_RUN = "anchor long, key long, hot boolean"
#: Columns of the files of a run: anchor and key, or key and anchor of a hot posting, so that a row lies in the bucket of what it is dealt by.
_FILED = "dealt long, other long"
_LAYOUT = 2


def _occurrences(needed, hot, wanted, window: int, anchor: int, parts: int):
    """Windows with a needed anchor, packed by part; repeats inside a slice are settled here.

    Rows are ``doc, text_hash, past, text`` and, without the filter ``needed``, ``anchors``, those that the document needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = _ids(batch)
            past = batch.column(2).to_numpy(zero_copy_only=False)
            if past.any():  # of history only the documents that the postings named
                keep = ~past | wanted.value.has(_key(ids, hashes).view(np.uint64))
                if not keep.all():
                    batch = batch.take(pa.array(np.flatnonzero(keep)))
                    (ids, hashes), past = _ids(batch), past[keep]
            for i, j, raw, off in text_slices(batch, "text"):
                w = words(raw, off)
                _, low, ok = _window_anchors(w, window, anchor)
                at = np.flatnonzero(ok)
                if needed is not None:
                    at = at[needed.value.has(low[at])]
                else:
                    # a document's anchors are looked up under its row, so that one search serves the slice
                    lists = batch.column(4).slice(i, j - i)
                    mine = join(np.repeat(np.arange(j - i), lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.uint64), lists.flatten().to_numpy().view(np.uint64))
                    at = at[np.isin(join(w.doc[at].astype(np.uint64), low[at]), mine)]
                if not len(at):
                    continue
                full, _ = window_hashes(w, window)
                check = window_hashes(w, window, _CHECK_SALT)[0].astype(np.uint32)
                doc = w.doc[at] + i
                order = np.lexsort((at, hashes[doc], ids[doc], ~past[doc]))
                at, doc = at[order], doc[order]
                full, check, low = full[at], check[at], low[at]
                start = at - w.first[doc - i]
                # of equal windows of this slice only the first goes on; those of the same document row twice stay
                by = np.lexsort((np.arange(len(at)), check, full))
                again = np.zeros(len(at), bool)
                again[by[1:]] = (full[by[1:]] == full[by[:-1]]) & (check[by[1:]] == check[by[:-1]])
                lead = by[np.maximum.accumulate(np.where(again[by], 0, np.arange(len(by))))]
                same = np.zeros(len(at), bool)
                same[by] = (ids[doc[by]] == ids[doc[lead]]) & (hashes[doc[by]] == hashes[doc[lead]]) & (start[by] == start[lead])
                gone = again & ~same & ~past[doc]
                where = mix64(np.where(hot.value.has(low), full, low))
                yield from _packed(where, full, check, ids[doc], hashes[doc], past[doc], start, ~again, gone, parts)

    return run


_PACKED = (
    "part int, doc array<long>, text_hash array<long>, past array<boolean>, start array<int>, len array<int>, "
    "anchor array<long>, hash array<long>, check array<int>, gone_doc array<long>, gone_hash array<long>, gone_start array<int>, gone_len array<int>"
)
_PACKED_ARROW = pa.schema(
    [("part", pa.int32())]
    + [(k, pa.list_(t)) for k, t in (("doc", pa.int64()), ("text_hash", pa.int64()), ("past", pa.bool_()), ("start", pa.int32()), ("len", pa.int32()), ("anchor", pa.int64()), ("hash", pa.int64()), ("check", pa.int32()))]
    + [(f"gone_{k}", pa.list_(t)) for k, t in (("doc", pa.int64()), ("hash", pa.int64()), ("start", pa.int32()), ("len", pa.int32()))]
)


def _stretches(doc, text_hash, start, key=None) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of stretches of neighbouring windows of one document (with one key)."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (start[1:] != start[:-1] + 1)
    if key is not None:
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(doc)))


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _packed(where, full, check, ids, hashes, past, start, keep, gone, parts) -> Iterator[pa.RecordBatch]:
    """Kept windows go to the part of ``where``, their anchor or hash; settled ones to that of their document."""
    sent = []
    for mask, key in ((keep, where), (gone, mix64(_key(ids, hashes).view(np.uint64)))):
        part = (key % np.uint64(parts)).astype(np.int64)
        at = np.flatnonzero(mask)
        at = at[np.argsort(part[at], kind="stable")]
        first, n = _stretches(ids[at], hashes[at], start[at], key[at])
        head = at[first]
        sent.append((at, head, n, np.searchsorted(part[head], np.arange(parts + 1)), np.searchsorted(part[at], np.arange(parts + 1))))
    (at, head, n, cuts, wcuts), (_, ghead, gn, gcuts, _) = sent
    rows = pa.record_batch(
        [
            pa.array(np.arange(parts), pa.int32()),
            _lists(ids[head], cuts, pa.int64()), _lists(hashes[head], cuts, pa.int64()), _lists(past[head], cuts, pa.bool_()),
            _lists(start[head], cuts, pa.int32()), _lists(n, cuts, pa.int32()), _lists(where[head].view(np.int64), cuts, pa.int64()),
            _lists(full[at].view(np.int64), wcuts, pa.int64()), _lists(check[at].view(np.int32), wcuts, pa.int32()),
            _lists(ids[ghead], gcuts, pa.int64()), _lists(hashes[ghead], gcuts, pa.int64()),
            _lists(start[ghead], gcuts, pa.int32()), _lists(gn, gcuts, pa.int32()),
        ],
        schema=_PACKED_ARROW,
    )
    used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(gcuts) > 0))
    if len(used):
        yield rows.take(pa.array(used))


_GONE = "doc long, text_hash long, start int, len int"


def _flat(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.flatten() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return column.to_numpy(zero_copy_only=False)


def _settle(table: pa.Table) -> pa.Table:
    """Of the windows of one part, the stretches that stand somewhere earlier too."""
    doc, text_hash, past = _flat(table, "doc"), _flat(table, "text_hash"), _flat(table, "past")
    start, n, anchor, hashes = _flat(table, "start"), _flat(table, "len"), _flat(table, "anchor"), _flat(table, "hash")
    out = [[_flat(table, f"gone_{k}")] for k in ("doc", "hash", "start", "len")]
    if len(doc):
        offset = np.concatenate([[0], np.cumsum(n)])[:-1]
        order = np.lexsort((start, text_hash, doc, ~past.astype(bool)))
        n = n[order]
        into = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(into, n)
        take = np.repeat(offset[order], n) + within
        which = np.repeat(order, n)
        full, key = hashes[take], anchor[which]
        w_doc, w_text, w_past, w_start = doc[which], text_hash[which], past[which].astype(bool), start[which] + within
        check = _flat(table, "check")[take]
        alike = lambda by: (full[by[1:]] == full[by[:-1]]) & (key[by[1:]] == key[by[:-1]]) & (check[by[1:]] == check[by[:-1]])
        by = np.argsort(full, kind="stable")
        same = alike(by)
        if (same != (full[by[1:]] == full[by[:-1]])).any():  # equal hashes of different windows
            by = np.lexsort((np.arange(len(full)), check, key, full))
            same = alike(by)
        again = np.zeros(len(by), bool)
        again[1:] = same
        lead = by[np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))]
        itself = (w_doc[by] == w_doc[lead]) & (w_text[by] == w_text[lead]) & (w_start[by] == w_start[lead])
        at = np.sort(by[again & ~itself & ~w_past[by]])
        first, length = _stretches(w_doc[at], w_text[at], w_start[at])
        for k, v in enumerate((w_doc[at[first]], w_text[at[first]], w_start[at[first]], length)):
            out[k].append(v)
    doc, text_hash, start, n = (np.concatenate(x) for x in out)
    return pa.table({"doc": pa.array(doc, pa.int64()), "text_hash": pa.array(text_hash, pa.int64()), "start": pa.array(start, pa.int32()), "len": pa.array(n, pa.int32())})


class FingerprintIndex:
    """Runs of postings of all documents seen so far, in a folder; a folder that holds an index is opened.

    ``max_runs`` is how many runs a batch is joined with at most.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, max_runs: int = 4):
        self.spark, self.id, self.text, self.window, self.anchor, self.max_runs = bounded(spark), id, text, window, anchor, max_runs
        self.path = path or shared_dir(spark)
        self.version, self.buckets, self.runs, self.compactions = 0, partitions(spark), [], 0
        self._load()

    def _load(self) -> None:
        """The newest manifest whose write was finished, if there is one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path, "manifest")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return
        done = [int(f.getPath().getName()) for f in system.listStatus(folder) if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        if done:
            state = json.loads(self.spark.read.text(f"{self.path}/manifest/{max(done)}").first()[0])
            if (state["window"], state["anchor"]) != (self.window, self.anchor):
                raise ValueError("the index was made with other window sizes")
            if state.get("layout") != _LAYOUT:
                raise ValueError("the index was made with another layout of its runs")
            self.version, self.runs, self.compactions = max(done), state["runs"], state["compactions"]

    def _commit(self) -> None:
        self.version += 1
        state = {"window": self.window, "anchor": self.anchor, "layout": _LAYOUT, "runs": self.runs, "compactions": self.compactions}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version}")

    def _write(self, run: DataFrame) -> dict:
        """A new run: one sorted file for each bucket of anchors, and one of hot postings for each bucket of documents."""
        name = f"run_{shared_dir(self.spark).rsplit('/', 1)[-1]}"
        either = lambda a, b: F.when(F.col("hot"), F.col(a)).otherwise(F.col(b))
        filed = run.select(either("key", "anchor").alias("dealt"), either("anchor", "key").alias("other"), "hot").repartition(self.buckets, "dealt")
        filed.write.partitionBy("hot").bucketBy(self.buckets, "dealt").sortBy("dealt").option("path", f"{self.path}/runs/{name}").format("parquet").saveAsTable(f"{name}_whole")
        self.spark.sql(f"DROP TABLE {name}_whole")  # its files stay
        release(self.spark)
        return {"name": name, "buckets": self.buckets}

    def _read(self, run: dict) -> DataFrame:
        """The bucketed postings of a run, named to this session first if it does not know them."""
        name = run["name"]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({_FILED}) USING parquet CLUSTERED BY (dealt) SORTED BY (dealt) INTO {run['buckets']} BUCKETS LOCATION '{self.path}/runs/{name}/hot=false'")
        return self.spark.table(name).select(F.col("dealt").alias("anchor"), F.col("other").alias("key"))

    def _hot(self, run: dict) -> DataFrame:
        """The hot postings of a run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{run['name']}/hot=true")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "anchor long, key long")
        return self.spark.read.schema(_FILED).parquet(path.toString()).select(F.col("other").alias("anchor"), F.col("dealt").alias("key"))

    def compact(self) -> None:
        """Merge all runs into one; the old ones are let go when the manifest names them no more."""
        if len(self.runs) > 1:
            merged = None
            for run in self.runs:
                for part, hot in ((self._read(run), False), (self._hot(run), True)):
                    part = part.withColumn("hot", F.lit(hot))
                    merged = part if merged is None else merged.unionByName(part)
            old, self.runs = self.runs, [self._write(merged)]
            self.compactions += 1
            self._commit()
            for run in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
                gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{run['name']}")
                gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    def _keyed(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.id).cast("long").alias("doc"), F.xxhash64(self.text).alias("text_hash"), F.col(self.text).alias("text"))

    def append(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Add a batch; returns its repeated windows as ``(doc, text_hash, start, len)`` stretches.

        ``history`` holds all documents of earlier batches, and may hold more.
        """
        keyed = self._keyed(batch)
        own = self._write(postings(keyed, self.window, self.anchor))
        # buckets of the batch meet those of each run; hot anchors, few on either side, go by broadcast
        new = self._read(own).groupBy("anchor").agg(F.count("*").alias("n"))
        hot = materialise(self._hot(own).groupBy("anchor").agg(F.count("*").alias("n")))
        met = None
        for run in self.runs:
            cold, common = self._read(run), self._hot(run).select("anchor").distinct()
            here = F.broadcast(hot.select("anchor"))
            asked = self._read(own).join(F.broadcast(common), "anchor", "left_semi").select("anchor").unionByName(hot.select("anchor")).distinct()
            found = cold.join(new.select("anchor"), "anchor", "left_semi").join(here, "anchor", "left_anti")
            for part in (found, cold.join(here, "anchor", "left_semi"), self._hot(run).join(F.broadcast(asked), "anchor", "left_semi")):
                part = part.select("anchor", "key")
                met = part if met is None else met.unionByName(part)
        total = new.filter("n > 1").unionByName(hot)
        if met is not None:
            met = materialise(met)
            total = total.unionByName(met.groupBy("anchor").agg(F.count("*").alias("n")))
        needed = materialise(total.groupBy("anchor").agg(F.sum("n").alias("n")))
        count, many = needed.agg(F.count("*"), F.count_if(F.col("n") > HOT)).first()
        gone = materialise(self._repeats(keyed, history, own, needed, met, count, many), free=True) if count else self.spark.createDataFrame([], _GONE)
        self.runs.append(own)
        self._commit()
        if len(self.runs) > self.max_runs:
            self.compact()
        return gone

    def _repeats(self, keyed: DataFrame, history: DataFrame | None, own: dict, needed: DataFrame, met: DataFrame | None, count: int, many: int) -> DataFrame:
        share = self.spark.sparkContext.broadcast
        hot = share(bloom.build(needed.filter(F.col("n") > HOT), "anchor", many))
        source, wanted = keyed.withColumn("past", F.lit(False)), None
        if met is not None and history is not None:
            wanted = share(bloom.build(met.select("key"), "key"))
            source = source.unionByName(self._keyed(history).withColumn("past", F.lit(True)))
        source = source.select("doc", "text_hash", "past", "text")
        chosen = share(bloom.build(needed, "anchor", count)) if count <= FILTERED else None
        if chosen is None:
            # too many for a filter: each document gets its own needed anchors by a join
            places = self._read(own).select("anchor", "key").unionByName(self._hot(own).select("anchor", "key"))
            places = places if met is None else places.unionByName(met)
            lists = materialise(places.join(needed.select("anchor"), "anchor", "left_semi").groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
            source = _with_key(source).join(lists, "key").select("doc", "text_hash", "past", "text", "anchors")
        parts = max(2 * partitions(self.spark), count // 50_000)
        pick = _occurrences(chosen, hot, wanted, self.window, self.anchor, parts)
        return source.mapInArrow(pick, _PACKED).groupBy("part").applyInArrow(_settle, _GONE)


def _with_key(source: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("key", pa.array(_key(*_ids(batch))))

    return source.mapInArrow(run, "doc long, text_hash long, past boolean, text string, key long")


def _covered(stretches: list | None, n: int, window: int) -> np.ndarray | None:
    if not stretches or not n:
        return None
    edge = np.zeros(n + 1, np.int64)
    for s in stretches:
        edge[s["start"]] += 1
        edge[min(n, s["start"] + s["len"] + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def _marked(docs: DataFrame, gone: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs`` as ``_columns``, a struct, with ``_gone``, the list of their repeated stretches."""
    by = gone.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "len")).alias("_gone"))
    key = [F.coalesce(F.col(id).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("text_hash")]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_columns"), *key).join(by, ["doc", "text_hash"], "left").select("_columns", "_gone")


def _batches(docs: DataFrame, id: str, batches: int) -> list[tuple[DataFrame, DataFrame | None]]:
    """Split by id, so that earlier batches hold the smaller ids, each with all that is before it; null ids come first."""
    cuts = docs.select(F.percentile_approx(F.col(id).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    if not cuts:
        return [(docs, None)]
    cuts, key = sorted(set(cuts)), F.col(id).cast("long")
    before = [docs.filter((key <= c) | key.isNull()) for c in cuts]
    out = [(before[0], None)]
    out += [(docs.filter((key > a) & (key <= b)), old) for a, b, old in zip(cuts, cuts[1:], before)]
    return [*out, (docs.filter(key > cuts[-1]), before[-1])]


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = 3, max_runs: int = 1) -> DataFrame:
    """Repeated windows of a whole table, fed to an empty index in ``batches`` batches by id, with compaction."""
    index = FingerprintIndex(docs.sparkSession, None, id, text, window, anchor, max_runs)
    gone = None
    for batch, history in _batches(docs, id, batches):
        found = index.append(batch, history)
        gone = found if gone is None else gone.unionByName(found)
    return gone


def dedup_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 3) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all other columns unchanged.

    A text that loses nothing stays as it is, byte for byte. Of another, the kept words are joined
    by one space; it may become empty.
    """
    gone, k = repeated(docs, id, text, window, batches=batches), docs.columns.index(text)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (frame.slice(at, 512) for frame in frames for at in range(0, frame.num_rows, 512)):
            texts = batch.column(k).to_pylist()
            for row, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    own = texts[row].encode().split()
                    lost = _covered(spans, len(own), window)
                    texts[row] = b" ".join(compress(own, ~lost)).decode()
            kept = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
            yield kept.select(list(range(batch.num_columns - 1)))

    marked = _marked(docs, gone, id, text)
    return marked.select("_columns.*", F.col("_gone").alias(unused(docs, "_gone"))).mapInArrow(run, docs.schema)


def dedup_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 3) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row of ``docs``."""
    gone = repeated(docs, id, text, window, batches=batches)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            n_words, n_removed, digest = [], [], []
            spans = batch.column(2).to_pylist()
            for row, value in enumerate(batch.column(1)):
                own = (value.as_py() or "").encode().split()
                lost = _covered(spans[row], len(own), window)
                n_words.append(len(own))
                n_removed.append(0 if lost is None else int(lost.sum()))
                digest.append(hashlib.sha256(b" ".join(own if lost is None else compress(own, ~lost))).hexdigest())
            yield pa.record_batch(
                {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            )

    small = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = _marked(small, gone, "doc_id", "text").select("_columns.doc_id", "_columns.text", "_gone")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
