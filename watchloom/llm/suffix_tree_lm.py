"""Language-model scores from a probabilistic suffix tree over words.

Texts are read once: a slice of them (some megabytes) becomes one row of a table, with its distinct word hashes and a code for
each word. The tree grows by levels. A context of ``k`` words that stands at least ``context`` times is a candidate; its
continuations with at least ``follow`` occurrences are counted, and the context becomes a state if its own distribution
explains what follows it better than that of its longest suffix state, by at least ``gain`` nats in all (the count times the difference
of the two divergences). A state's distribution is its discounted counts, and what they leave goes to its suffix state; the root gives
each word its count and one. A text is scored from the longest suffix state at each word.

What a candidate n-gram is, two filters of fixed size decide: n-grams whose context or suffix is too rare never leave their task.
A filter that gets too full only lets more of them through. The tree is a table and is never gathered: each
slice asks for the distinct words and n-grams it holds, gets the answers back, and is scored with them. What is shuffled are arrays: a slice's
keys that fall into a bucket are one row, and the number of buckets follows the number of tokens. So a frequent word is one entry
a slice, and no bucket is larger for it. The n-grams of a level are counted in parts by their context, and slices are scored in
parts, one after another: the shuffle of one part is on disk at a time. N-grams go by 64 bits of hashes: two of a thousand million words share one with a chance of 3 %, and
would then share their count.

Cases: a null text is empty and has the end token alone; a null id is an id like any other and is trained on. Repeated rows count as often
as they stand. One very long text is a slice of its own. Without training rows each probability is one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm import bloom
from watchloom.llm.storage import bounded, materialise, partitions
from watchloom.llm.text_hash import join, mix64, text_slices, words

#: Longest context; occurrences of a context and of a continuation; nats that a state must gain; discount of a continuation's count.
DEPTH, CONTEXT, FOLLOW, GAIN, DISCOUNT = 2, 64, 8, 16.0, 0.5
#: Tokens of a slice, and of the corpus for each bucket that keys are dealt to.
SLICE, BUCKET = 800_000, 2**20
#: Parts, a power of two, in which a corpus of at least as many buckets is counted and scored.
PARTS = 8
END = mix64(np.array([2**63 + 5], np.uint64))
_ENCODED = "slice long, ids array<long>, held array<boolean>, lengths array<int>, words binary, codes binary"
#: What an answer holds: the count of a word, of an n-gram or of a state, and with the latter the part of it that goes to its suffix.
_WORD, _GRAM, _STATE = 0, 1, 2
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(values: np.ndarray) -> bytes:
    """The values' bytes, first bytes first, compressed: what is sorted or small, and the codes of frequent words, gets short."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if len(values) else b"")


def _whole(body: bytes, kind) -> np.ndarray:
    count, size = int.from_bytes(body[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(body[8:], count * size, codec="zstd", asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """``_planes`` of the differences of neighbours (modulo 2^64), which are small where keys are sorted."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _summed(body: bytes) -> np.ndarray:
    return np.cumsum(_whole(body, np.uint64), dtype=np.uint64)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The used buckets, which are ranges, and the indices of their keys; neighbours share their first bytes."""
    bucket = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    yield from zip(used.tolist(), np.split(order, first[1:]))


def encode(docs: DataFrame, id: str = "doc_id", text: str = "text", held=None, size: int = SLICE) -> DataFrame:
    """Slices of ``docs`` as rows of a table; ``held`` is a column of what is not to be trained on."""

    def pack(number: int, ids: list, held: list, lengths: list, hashes: list) -> pa.RecordBatch:
        known, codes, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-np.log2(n).astype(np.int64), kind="stable")  # frequent words first, which makes codes small; by hash among those of a power of two
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        row = {"slice": (TaskContext.get().partitionId() << 32) + number, "ids": ids, "held": held, "lengths": np.concatenate(lengths).tolist()}
        return pa.RecordBatch.from_pylist([row | {"words": _steps(known[order]), "codes": _planes(rank[codes])}], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, have, parts = 0, 0, ([], [], [], [])
        for batch in batches:
            for i, j, raw, off in text_slices(batch, "text"):
                w = words(raw, off, lower=True)
                parts[0].extend(batch.column(0).slice(i, j - i).to_pylist())
                parts[1].extend(batch.column(1).slice(i, j - i).to_pylist())
                parts[2].append(np.diff(w.first))
                parts[3].append(w.hash)
                have += len(w.hash) + j - i
                if have >= size:
                    yield pack(number, *parts)
                    number, have, parts = number + 1, 0, ([], [], [], [])
        if parts[0]:
            yield pack(number, *parts)

    bounded(docs.sparkSession)
    out = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    return materialise(docs.select(F.col(id).cast("long").alias("id"), out.alias("held"), F.col(text).alias("text")).mapInArrow(run, _ENCODED))


_SCHEMA = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("codes", pa.binary())])


class Slice:
    """The tokens of a slice, ends included, in document order."""

    def __init__(self, row: dict):
        lengths = np.array(row["lengths"], np.int64)
        self.words = np.append(_summed(row["words"]), END)
        codes = _whole(row["codes"], "<u4")
        self.lengths = lengths + 1
        self.last = np.cumsum(self.lengths) - 1
        self.codes = np.full(len(codes) + len(lengths), len(self.words) - 1, np.int64)
        inner = np.ones(len(self.codes), bool)
        inner[self.last] = False
        self.codes[inner] = codes
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)

    def places(self, k: int) -> np.ndarray:
        """Which tokens have ``k`` before them in their document."""
        out = np.ones(len(self.codes), bool)
        out[:k] = False
        for j in range(1, k + 1):
            out[self.last[self.last < len(out) - j] + j] = False
        return out

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        """Keys of the ``k`` tokens that end at each position."""
        return self.words[self.codes[at]] if k == 1 else join(self.grams(at - 1, k - 1), self.grams(at, k - 1))

    def levels(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``k, positions, contexts, suffixes, n-grams``: keys for the tokens that have ``k`` before them in their document."""
        keys = self.words[self.codes]
        for k in range(1, depth + 1):
            at = np.flatnonzero(self.places(k))
            grams = np.zeros(len(keys), np.uint64)
            context, suffix = keys[at - 1], keys[at]
            grams[at] = join(context, suffix)
            yield k, at, context, suffix, grams[at]
            keys = grams


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Slice]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, Slice(row)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _word_counts(encoded: DataFrame, buckets: int) -> DataFrame:
    """``key, n`` of the training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in _slices(batches):
            n = np.bincount(s.codes[s.train], minlength=len(s.words)).astype(np.uint32)
            own = np.flatnonzero(n)
            own = own[np.argsort(s.words[own])]
            for bucket, at in _dealt(s.words[own], buckets):
                yield pa.record_batch([pa.array([bucket]), pa.array([_steps(s.words[own[at]])], pa.binary()), pa.array([_planes(n[own[at]])], pa.binary())], names=["bucket", "keys", "n"])

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_summed(x) for x in table.column("keys").to_pylist()])
        n = np.concatenate([_whole(x, np.uint32) for x in table.column("n").to_pylist()])
        found, place = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, n)
        return pa.table({"key": _signed(found), "n": total})

    return encoded.mapInArrow(run, "bucket long, keys binary, n binary").groupBy("bucket").applyInArrow(merge, "key long, n long")


def _gram_counts(encoded: DataFrame, level: int, contexts, suffixes, follow: int, buckets: int, part: int, parts: int) -> DataFrame:
    """``key, context, suffix, n`` of training n-grams with ``follow`` occurrences whose context and suffix pass the filters (broadcasts).

    Of the contexts, only those of one part are counted, which is told by their last word.
    """
    mask, own_part = np.uint64(parts - 1), np.uint64(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in _slices(batches):
            use = s.places(level) & s.train
            use[1:] &= (s.words & mask == own_part)[s.codes[:-1]]
            at = np.flatnonzero(use)
            context = s.grams(at - 1, level)
            own = np.flatnonzero(contexts.value.has(context))
            at, context = at[own], context[own]
            suffix = s.grams(at, level)
            own = np.flatnonzero(suffixes.value.has(suffix))
            context, suffix = context[own], suffix[own]
            gram, first, n = np.unique(join(context, suffix), return_index=True, return_counts=True)
            context, suffix = context[first], suffix[first]
            order = np.argsort(context)  # neighbours share it, which makes the shuffle smaller
            context, suffix, gram, n = context[order], suffix[order], gram[order], n[order].astype(np.uint32)
            for bucket, k in _dealt(gram, buckets):
                blobs = [pa.array([x], pa.binary()) for x in (_steps(context[k]), _planes(suffix[k]), _planes(n[k]))]
                yield pa.record_batch([pa.array([bucket]), *blobs], names=["bucket", "contexts", "suffixes", "n"])

    def merge(table: pa.Table) -> pa.Table:
        context = np.concatenate([_summed(x) for x in table.column("contexts").to_pylist()])
        suffix, n = (np.concatenate([_whole(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("suffixes", np.uint64), ("n", np.uint32)))
        found, first, place = np.unique(join(context, suffix), return_index=True, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, n)
        own = np.flatnonzero(total >= follow)
        return pa.table({"key": _signed(found[own]), "context": _signed(context[first[own]]), "suffix": _signed(suffix[first[own]]), "n": total[own]})

    dealt = encoded.mapInArrow(run, "bucket long, contexts binary, suffixes binary, n binary")
    return dealt.groupBy("bucket").applyInArrow(merge, "key long, context long, suffix long, n long")


@dataclass
class Tree:
    """``answers(key, kind, n, mass)`` is the tree as a table; probabilities follow from the counts where they are asked for."""

    answers: DataFrame
    grams: object  # filter of the keys of n-grams and of states of two words and more
    tokens: int
    distinct: int
    depth: int
    discount: float
    buckets: int
    parts: int


def fit(encoded: DataFrame, depth: int = DEPTH, context: int = CONTEXT, follow: int = FOLLOW, gain: float = GAIN, discount: float = DISCOUNT, parts: int | None = None) -> Tree:
    """The tree of the training rows; ``parts`` (a power of two) changes what is on disk at a time, and no result."""
    spark = encoded.sparkSession
    size = encoded.agg(F.sum(F.size("ids") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    buckets = max(partitions(spark), size // BUCKET)
    parts = parts or (PARTS if size >= PARTS * BUCKET else 1)
    shares = [max(1, parts >> k) for k in range(1, depth + 1)]  # longer n-grams are fewer, and a part costs a pass over the slices
    counted = materialise(_word_counts(encoded, buckets), free=True)
    whole = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = whole.n or 0, whole.v
    below = counted.select("key", "n", ((F.col("n") + 1) / F.lit(tokens + distinct + 1)).alias("p"))  # n-grams of this length, with their probability
    answer = lambda df, kind, key, n, mass=0.0: df.select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(n).alias("n"), (F.lit(mass) if mass == 0.0 else F.col(mass)).alias("mass"))
    answers = answer(counted, _WORD, "key", "n")
    later = None
    by = Window.partitionBy("context")

    def level(k: int, part: int) -> DataFrame:
        grams = _gram_counts(encoded, k, *filters, follow, max(1, buckets // shares[k - 1]), part, shares[k - 1])
        heads = below.filter(F.col("n") >= context).select(F.col("key").alias("context"), F.col("n").alias("whole"))
        tails = below.filter(F.col("n") >= follow).select(F.col("key").alias("suffix"), F.col("p").alias("lower"))
        # rows are dealt by suffix, then by context; all that is worked out for a context stays there
        grams = grams.join(tails, "suffix").select("key", "context", "n", "lower").join(heads, "context")
        grams = grams.withColumns({"mass": F.col("whole") - F.sum(F.col("n") - discount).over(by), "rest": F.col("whole") - F.sum("n").over(by), "head": F.col("key") == F.min("key").over(by)})
        grams = grams.withColumn("own", (F.col("n") - discount) / F.col("whole") + F.col("mass") / F.col("whole") * F.col("lower"))
        # a state with a continuation leaves something, as the counts are discounted
        gained = F.sum(F.col("n") * F.log(F.col("own") / F.col("lower"))).over(by) + F.col("rest") * F.log(F.col("mass") / F.col("whole"))
        return grams.withColumn("kept", gained >= gain).select("key", "context", "n", "whole", "mass", F.when(F.col("kept"), F.col("own")).otherwise(F.col("lower")).alias("p"), "head", "kept")

    for k in range(1, depth + 1):
        filters = [spark.sparkContext.broadcast(bloom.build(below.filter(F.col("n") >= least), "key")) for least in (context, follow)]
        found = materialise((level(k, part) for part in range(shares[k - 1])), free=True)
        entries, states = found.filter("kept"), found.filter("kept and head")
        answers = answers.unionByName(answer(entries, _GRAM, "key", "n")).unionByName(answer(states, _STATE, "context", "whole", "mass"))
        new = entries.select("key") if k == 1 else entries.select("key").unionByName(states.select(F.col("context").alias("key")))
        later = new if later is None else later.unionByName(new)
        below = found.select("key", "n", "p")
    grams = spark.sparkContext.broadcast(bloom.build(later, "key")) if depth else None
    return Tree(answers, grams, tokens, distinct, depth, discount, buckets, parts)


def _asked(s: Slice, filters, depth: int) -> np.ndarray:
    """The keys that a slice needs, in order: its words, and the n-grams and contexts that may be in the tree."""
    keys = [s.words]
    for k, _, context, _, gram in s.levels(depth):
        for x in [gram] if k == 1 else [gram, context]:
            keys.append(np.unique(x[filters.value.has(x)]))
    return np.unique(np.concatenate(keys))


def _found(keys: np.ndarray, table: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of each key, 0 if the table (sorted) lacks it."""
    if not len(table):
        return [np.zeros(len(keys), v.dtype) for v in values]
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    hit = table[at] == keys
    return [np.where(hit, v[at], v.dtype.type(0)) for v in values]


def score(encoded: DataFrame, tree: Tree) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text of ``encoded``."""
    depth, filters, tokens, distinct, discount, buckets = tree.depth, tree.grams, tree.tokens, tree.distinct, tree.discount, tree.buckets

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in _slices(batches):
            keys = _asked(s, filters, depth)
            for bucket, at in _dealt(keys, buckets):
                yield pa.record_batch([pa.array([bucket]), pa.array([row["slice"]]), pa.array([_steps(keys[at])], pa.binary())], names=["bucket", "slice", "keys"])

    def packed(held: pa.Table) -> pa.Table:
        key, kind, n, mass = (held.column(c).to_numpy() for c in ("key", "kind", "n", "mass"))
        row = {"bucket": held.column("bucket")[:1]}
        for k in (_WORD, _GRAM, _STATE):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own].view(np.uint64))]
            row |= {c: pa.array([x], pa.binary()) for c, x in ((f"keys{k}", _steps(key[own].view(np.uint64))), (f"n{k}", _planes(n[own])), (f"mass{k}", _planes(mass[own] if k == _STATE else mass[:0])))}
        return pa.table(row)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        row = (held.to_pylist() or [{}])[0]
        none = bytes(8)
        tables = [(_summed(row.get(f"keys{k}", none)), _whole(row.get(f"n{k}", none), np.int64), _whole(row.get(f"mass{k}", none), np.float64)) for k in (_WORD, _GRAM, _STATE)]
        out = []
        for body in asked.column("keys").to_pylist():
            keys = _summed(body)
            (n_word,), (n_gram,), (whole, left) = (_found(keys, *t) for t in (tables[_WORD][:2], tables[_GRAM][:2], tables[_STATE]))
            out.append((_planes(n_word), _planes(n_gram), _planes(whole), _planes(left[whole > 0])))
        return pa.table({"slice": asked.column("slice"), "bucket": asked.column("bucket")} | {c: pa.array([o[k] for o in out], pa.binary()) for k, c in enumerate(("n", "n_gram", "whole", "mass"))})

    def scored(_, answers: pa.Table, rows: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        s = Slice(row)
        keys = _asked(s, filters, depth)
        n, n_gram, whole = (np.zeros(len(keys), np.int64) for _ in range(3))
        mass = np.zeros(len(keys))
        told = {b: k for k, b in enumerate(answers.column("bucket").to_pylist())}
        for bucket, at in _dealt(keys, buckets):
            for values, c in ((n, "n"), (n_gram, "n_gram"), (whole, "whole")):
                values[at] = _whole(answers.column(c)[told[bucket]].as_py(), np.int64)
            mass[at[whole[at] > 0]] = _whole(answers.column("mass")[told[bucket]].as_py(), np.float64)
        place = np.searchsorted(keys, s.words)
        base = ((n[place] + 1) / (tokens + distinct + 1))[s.codes]
        value = base.copy()
        grams, states = (np.flatnonzero(x) for x in (n_gram, whole))
        grams, n_gram, states, whole, mass = keys[grams], n_gram[grams], keys[states], whole[states], mass[states]
        for _, at, context, _, gram in s.levels(depth) if len(states) else ():
            count, left = _found(context, states, whole, mass)
            own = np.flatnonzero(count)
            count, left = count[own], left[own]
            (own_n,) = _found(gram[own], grams, n_gram)
            value[at[own]] = np.where(own_n > 0, own_n - discount, 0) / count + left / count * value[at[own]]
        base, value = np.log(base), np.log(value)
        docs = len(s.last)
        doc = np.repeat(np.arange(docs), s.lengths)
        total = lambda x: np.bincount(doc, x, docs)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"]), "n_tokens": total(None).astype(np.int64), "n_known": total((n[place] > 0)[s.codes]).astype(np.int64),
            "train_tokens": np.full(docs, tokens), "base_score": total(base) / np.log(10), "score": total(value) / np.log(10),
        })

    own = tree.answers.withColumn("bucket", F.expr(f"shiftrightunsigned(shiftrightunsigned(key, 32) * {buckets}L, 32)"))
    columns = ", ".join(f"keys{k} binary, n{k} binary, mass{k} binary" for k in (_WORD, _GRAM, _STATE))
    held = materialise(own.groupBy("bucket").applyInArrow(packed, f"bucket long, {columns}"), free=True)

    def part_scores(part: int) -> DataFrame:
        own = encoded.filter((F.shiftright("slice", 32) + F.col("slice")).bitwiseAND(tree.parts - 1) == part)
        requests = own.mapInArrow(ask, "bucket long, slice long, keys binary")
        answers = requests.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(answer, "slice long, bucket long, n binary, n_gram binary, whole binary, mass binary")
        return answers.groupBy("slice").cogroup(own.groupBy("slice")).applyInArrow(scored, _SCORES)

    return materialise((part_scores(part) for part in range(tree.parts)), free=True)


def score_table(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, **options) -> DataFrame:
    """Scores of all texts by a tree of those whose checksum modulo ``folds`` is not ``held``."""
    encoded = encode(docs, id, text, F.crc32(F.col(id).cast("string")) % folds == held)
    return score(encoded, fit(encoded, **options))
