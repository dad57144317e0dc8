"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct ``size``-word shingles. Two documents link when their
Jaccard similarity is at least ``num / den``. For linked sets S and T the symmetric difference holds at
most ``(|S| + |T|) * (den - num) / (den + num)`` shingles.

Sketch. Per size band a set is spread over B blocks by hash, and each block is the XOR of the
64-bit hashes of its shingles. A shingle in only one of two sets changes one block, so the number of
blocks in which two sketches differ is at most their symmetric difference d; among any d + 1 of the
non-empty blocks, in an order that all documents share, one agrees (pigeonhole). So a document sends
its first d + 1 non-empty blocks, d taken for the largest possible partner. Band k has the sizes
64 * 4**k up to four times that; sets near the lower border are met by those just below it, which
send a second time. Below 64 each shingle is its own block. A document with too few non-empty blocks for
this would break the argument; the first pass counts such documents and takes another seed if there
is one (at odds of about 1e-12 each), and after some seeds single shingles as the blocks of all sizes.

Order. Any order that all share will do, so blocks which more than ``dense`` sketches hold come
last: a passage shared by many documents is then no block of documents that have enough else.
The hot blocks are found by a count over all documents and sent to all tasks as a
bit filter of bounded size; its false positives only change the order.

Candidates. In a group of sketches that share a block all are checked against one of them (a star),
and links are contracted to components. Only pairs that lie in different components are looked
at again: in small groups all of them, in large groups in blocks of bounded size. The centre of a large group
is the member with the most shared symbols, so that of near copies the original is likely chosen.
A hot block is never a shuffle key: its sketches are dealt by node, and a large star by salt, with its
centre's set fetched once for each salt and held while the members stream by.
Every candidate first passes a parity bit sketch of 4096 bits (its Hamming distance is a lower bound of
d) and is then verified on the exact shingle hashes. Equal sets are one node from the start.

Links. Components do not need the pairs inside them, numbers of links do. All linked sets share a component, so
on demand the sets of each component are compared in blocks of bounded size, every pair once and exactly.

Null, empty and blank texts have no shingles and link with nothing. Rows that repeat a doc_id are
separate rows with the same id; a null doc_id takes part, and a component of only such rows has a null id.
A text of any length is one set. Columns other than id and text play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm import bloom
from watchloom.llm.components import connected_components
from watchloom.llm.storage import bounded, dealt, materialise, partitions, unused
from watchloom.llm.text_hash import mix64, shingle_sets, text_slices, words

SIZE, NUM, DEN = 5, 3, 4
DENSE = 16
_SMALL = 64
_BITS = 4096
_SALTS = 64
_STAR = 256  # members of a star that meet its centre in one task, about
_PART_SHINGLES = 1 << 22  # about as many shingles are behind what one part of the blocks holds
_BLOCK = 1024  # rows of a large group that one task holds on either side
_BLOCK_SHINGLES = 1 << 19  # about as many shingles of a component are held on either side


def allowed(n: int, num: int, den: int) -> int:
    """Largest symmetric difference of a set of n shingles with any partner that it may link to."""
    return (n + n * den // num) * (den - num) // (den + num)


def _bands(n: int, num: int, den: int, small: int) -> list[int]:
    """Bands in which a set of n shingles is compared, the first from ``small`` on; -1: single shingles."""
    band = -1
    while small * 4 ** (band + 1) <= n:
        band += 1
    above = small * 4 ** (band + 1)
    return [band, band + 1] if n * den >= num * above else [band]


def _symbols(s: np.ndarray, band: int, seed: int) -> np.ndarray:
    """The non-empty blocks of a set's sketch in a band, each as one number, sorted."""
    h = np.sort(mix64(s ^ np.uint64(seed)))
    if band >= 0:
        block = h >> np.uint64(64 - (7 + 2 * band))
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        h = np.bitwise_xor.reduceat(h, first) ^ (block[first] << np.uint64(20))
    return np.unique(mix64(h + np.uint64(band + 2)))


def _node(s: np.ndarray) -> tuple[int, int]:
    """Identity of a set, and an independent check of it."""
    a = mix64(s + np.uint64(0x9E3779B97F4A7C15))
    whole = mix64(np.array([np.bitwise_xor.reduce(a), len(s)], np.uint64))
    node = mix64(np.array([whole[0] ^ (whole[1] << np.uint64(1))], np.uint64)).view(np.int64)
    return int(node[0]), int(a.sum().view(np.int64))


def _nodes(docs: DataFrame, size: int, num: int, den: int, seed: int, small: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in text_slices(batch, "text"):
                out = []
                for s in shingle_sets(words(raw, off, lower=True), size):
                    n = len(s)
                    fits = all(len(_symbols(s, b, seed)) > allowed(n, num, den) for b in _bands(n, num, den, small) if b >= 0) if n >= 48 else True
                    out.append((n, *(_node(s) if n else (None, None)), fits))
                n, node, check, fits = zip(*out)
                yield pa.record_batch(
                    {"doc_id": batch.column(0).slice(i, j - i), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "check": pa.array(check, pa.int64()), "fits": pa.array(fits, pa.bool_())}
                )

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, fits boolean")


def _prefixes(raw, off, size, num, den, seed, small, hot, parts) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """``(node, n, symbols, how many of them are not hot)`` of the distinct sets of a slice; without ``hot`` all symbols."""
    seen = set()
    for s in shingle_sets(words(raw, off, lower=True), size):
        n = len(s)
        if not n or (node := _node(s)[0]) in seen:
            continue
        seen.add(node)
        for band in _bands(n, num, den, small):
            sig = _symbols(s, band, seed)
            cold = len(sig)
            if hot is not None:
                late = hot.has(mix64(_count_key(sig, parts)))
                take = allowed(n, num, den) + 1
                cold = min(int((~late).sum()), take)
                sig = np.concatenate([sig[~late][:take], sig[late][: take - cold]])
            yield node, n, sig, cold


def _count_key(sig: np.ndarray, parts: int) -> np.ndarray:
    """What the count of a symbol goes by: as many of its values as ``parts`` times 32 bits tell apart."""
    return (sig >> np.uint64(20)) % np.uint64(parts << 32)


def _by_part(parts: int, *groups: tuple[np.ndarray, dict[str, np.ndarray]]) -> pa.RecordBatch:
    """Columns as lists, one row per part; each group of columns has parts of its own."""
    fields, used = {"part": pa.array(np.arange(parts), pa.int32())}, np.zeros(parts, bool)
    for part, columns in groups:
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        used |= np.diff(cuts) > 0
        fields |= {k: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v[order])) for k, v in columns.items()}
    return pa.record_batch(fields).take(pa.array(np.flatnonzero(used)))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in table.column(name).chunks]).to_numpy(zero_copy_only=False)


def _hot_symbols(docs: DataFrame, size, num, den, seed, small, dense, parts) -> DataFrame:
    """Symbols that more than ``dense`` sketches hold, as keys for the bit filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in text_slices(batch, "text"):
                found = [x[2] for x in _prefixes(raw, off, size, num, den, seed, small, None, parts)]
                if found:
                    # one more than ``dense`` settles a symbol, so a slice sends no more of it
                    key, n = np.unique(_count_key(np.concatenate(found), parts), return_counts=True)
                    key = np.repeat(key, np.minimum(n, dense + 1))
                    part = (key % np.uint64(parts)).astype(np.int64)
                    low = (key // np.uint64(parts)).astype(np.uint32)
                    yield _by_part(parts, (part, {"low": low.view(np.int32)}))

    def most(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        low, n = np.unique(_flat(table, "low").view(np.uint32), return_counts=True)
        key = low[n > dense].astype(np.uint64) * np.uint64(parts) + np.uint64(part)
        return pa.table({"h": mix64(key).view(np.int64)})

    packed = docs.select("text").mapInArrow(count, "part int, low array<int>")
    return packed.groupBy("part").applyInArrow(most, "h long")


def _groups(docs: DataFrame, size, num, den, seed, small, hot, dense, parts) -> DataFrame:
    """Groups of sketches that share a block.

    kind 0: edge a - b of the star of a small group; 1: another pair of a small group; 2: a holds the hot block ``sig``.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in text_slices(batch, "text"):
                found = list(_prefixes(raw, off, size, num, den, seed, small, hot.value, parts))
                if found:
                    lengths = np.array([len(x[2]) for x in found])
                    sig = np.concatenate([x[2] for x in found])
                    node = np.repeat(np.array([x[0] for x in found], np.int64), lengths)
                    n = np.repeat(np.array([x[1] for x in found], np.int32), lengths)
                    place = np.arange(len(sig)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    own = place < np.repeat(np.array([x[3] for x in found]), lengths)
                    part = (np.where(own, sig, mix64(sig ^ node.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
                    yield _by_part(
                        parts,
                        (part[own], {"sig": sig[own].view(np.int64), "node": node[own], "n": n[own]}),
                        (part[~own], {"hot": sig[~own].view(np.int64), "hot_node": node[~own]}),
                    )

    def meet(table: pa.Table) -> pa.Table:
        hot_sig, hot_node = np.unique(np.stack([_flat(table, "hot"), _flat(table, "hot_node")]), axis=1)
        sig, node, n = (_flat(table, k) for k in ("sig", "node", "n"))
        order = np.lexsort((node, sig))
        sig, node, n = sig[order], node[order], n[order].astype(np.int64)
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, n = sig[keep], node[keep], n[keep]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(sig)))
        out = []

        def add(kind: int, a: np.ndarray, b: np.ndarray) -> None:
            ok = np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num
            pairs = np.unique(np.stack([node[a[ok]], node[b[ok]]], 1), axis=0)
            out.append((np.full(len(pairs), kind), np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1]))

        pairs = [np.zeros((2, 0), np.int64)]
        for k in np.unique(count[count > 1]):  # never more than ``dense``: such blocks are hot
            i, j = np.triu_indices(int(k), 1)
            base = first[count == k]
            pairs.append(np.stack([(base[:, None] + i).ravel(), (base[:, None] + j).ravel()]))
        a, b = np.concatenate(pairs, 1)
        star = new[a] if len(a) else np.zeros(0, bool)
        add(0, a[star], b[star])
        add(1, a[~star], b[~star])
        out.append((np.full(len(hot_sig), 2), hot_sig, hot_node, hot_node))
        kind, s, a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"kind": pa.array(kind, pa.int32()), "sig": pa.array(s, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    packed = docs.select("text").mapInArrow(send, "part int, sig array<long>, node array<long>, n array<int>, hot array<long>, hot_node array<long>")
    return packed.groupBy("part").applyInArrow(meet, "kind int, sig long, a long, b long")


def _of_nodes(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, schema: str, column: str, value) -> DataFrame:
    """``value`` of the shingle sets of the wanted nodes, each from one document that has it."""
    reps = nodes.join(dealt(wanted.distinct()), "node", "left_semi").select(F.coalesce("rep", F.lit(-(2**63))).alias("rep"))
    chosen = docs.sparkSession.sparkContext.broadcast(bloom.build(materialise(mixed(reps, "rep")), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for i, j, raw, off in text_slices(batch, "text"):
                some = chosen.value.has(mix64(ids[i:j].view(np.uint64)))
                if some.any():
                    sets = shingle_sets(words(raw, off, lower=True), size)
                    rows = [(_node(s)[0], len(s), value(s)) for take, s in zip(some, sets) if take and len(s)]
                    if rows:
                        node, n, held = zip(*rows)
                        yield pa.record_batch({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64()), column: pa.array(held, pa.list_(pa.int64()))})

    found = docs.mapInArrow(run, f"node long, n long, {column} {schema}")
    return materialise(found.groupBy("node").agg(F.first("n").alias("n"), F.first(column).alias(column)))


def _bit_sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix64(s) & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _against(pairs: DataFrame, table: DataFrame, payload: str, keep) -> DataFrame:
    """The pairs of ``pairs(c, m, salt)`` that ``keep(c's n, c's payload, n of some m, their flat payload)`` accepts.

    A pair travels with the payload of ``m`` alone; that of ``c`` comes once for each salt, before its members.
    """
    side = lambda name: dealt(table.select(F.col("node").alias(name), "n", payload))
    members = pairs.join(side("m"), "m").select("c", "salt", "m", "n", payload)
    centres = pairs.select("c", "salt").distinct().join(side("c"), "c").select("c", "salt", F.lit(None).cast("long").alias("m"), "n", payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (0, np.zeros(0, np.int64))
        for batch in batches:
            opens, n = batch.column(2).is_null().to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            lists = batch.column(4)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = [0, *np.flatnonzero(opens).tolist(), len(n)]
            fine = np.zeros(len(n), bool)
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i < j and opens[i]:
                    held = (int(n[i]), flat[off[i] : off[i + 1]].copy())
                    i += 1
                if i < j:
                    fine[i:j] = keep(*held, n[i:j], flat[off[i] : off[j]])
            yield batch.select(["c", "salt", "m"]).take(pa.array(np.flatnonzero(fine)))

    rows = centres.unionByName(members).repartition("c", "salt").sortWithinPartitions("c", "salt", F.col("m").asc_nulls_first())
    return materialise(rows.mapInArrow(run, "c long, salt int, m long"))


def _plausible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and bit sketches allow a link."""

    def keep(own: int, bits: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(flat.view(np.uint64).reshape(len(n), -1) ^ bits.view(np.uint64)).sum(1, dtype=np.int64)
        return (np.minimum(n, own) * den >= np.maximum(n, own) * num) & (far * (den + num) <= (n + own) * (den - num))

    return _against(pairs, sketches, "sketch", keep)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(c, m, salt)`` whose exact similarity reaches the threshold, and the sets of all that were compared."""
    wanted = pairs.select(F.explode(F.array("c", "m")).alias("node"))
    sets = _of_nodes(docs, nodes, wanted, size, "array<long>", "shingles", lambda s: s.view(np.int64))

    def keep(own: int, held: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
        held, flat = held.view(np.uint64), flat.view(np.uint64)
        at = np.minimum(np.searchsorted(held, flat), own - 1)
        both = np.add.reduceat((held[at] == flat).astype(np.int64), np.cumsum(n) - n)
        return both * den >= (n + own - both) * num

    return _against(pairs, sets, "shingles", keep), sets


def _pairs(df: DataFrame, c: str, m: str, size: str | None = None) -> DataFrame:
    """Distinct pairs, dealt by their member to as many salts as the largest group of the pair has ``_STAR`` members."""
    own = df.select(F.col(c).alias("c"), F.col(m).alias("m"), (F.col(size) if size else F.lit(1)).alias("size"))
    salts = F.least(F.ceil(F.max("size") / _STAR), F.lit(4 * _SALTS))
    return own.groupBy("c", "m").agg(F.pmod(F.xxhash64("m"), salts).cast("int").alias("salt"))


def _keyed(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with ``few``, one row per key, on a key that may hold a large part of the rows: its rows are dealt to salts by node.

    ``few`` is repeated for each salt, so it is never broadcast.
    """
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(_SALTS)).cast("int")).join(dealt(salted), [key, "_salt"], how).drop("_salt")


def _crossing(members: DataFrame, labels: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """In large groups the pairs of different components that pass the bit sketch."""
    named = members.join(dealt(labels.select(F.col("v").alias("node"), "label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    centres = members.select("centre").distinct().join(dealt(labels.select(F.col("v").alias("centre"), F.col("label").alias("own"))), "centre")
    named = _keyed(named, centres, "centre", "left").withColumn("rest", F.col("label") != F.coalesce("own", "centre")).drop("own", "centre")
    named = materialise(named)
    totals = named.groupBy("sig").agg(F.count("*").alias("total"), F.count_if("rest").alias("open")).filter("open > 0")
    named = _keyed(named, totals, "sig", "inner").join(dealt(sketches), "node")
    over = lambda c: F.ceil(F.col(c) / _BLOCK).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), over(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), over(c) - 1))
    ask = named.filter("rest").select("sig", "node", "label", "n", "sketch", F.lit(True).alias("ask"), place("open").alias("i"), every("total").alias("j"))
    give = named.select("sig", "node", "label", "n", "sketch", F.lit(False).alias("ask"), every("open").alias("i"), place("total").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        node, label, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n"))
        bits = _flat(table, "sketch").view(np.uint64).reshape(len(node), _BITS // 64)  # unsigned: the count of a negative number is another
        q, t = np.flatnonzero(ask), np.flatnonzero(~ask)
        out = [np.zeros((0, 2), np.int64)]
        for i in q:
            both = n[t] + n[i]
            fit = (label[t] != label[i]) & (np.minimum(n[t], n[i]) * den >= np.maximum(n[t], n[i]) * num)
            at = t[fit]
            far = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            at = at[far * (den + num) <= both[fit] * (den - num)]
            out.append(np.stack([np.minimum(node[at], node[i]), np.maximum(node[at], node[i])], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return ask.unionByName(give).groupBy("sig", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _tally(batches: list[pa.RecordBatch], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of two blocks of a component, or of one with itself, and how many rows they link to in the other."""
    table = pa.Table.from_batches(batches)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    node, weight = (table.column(c).to_numpy() for c in ("node", "weight"))
    n = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in table.column("shingles").chunks]).astype(np.int64)
    flat, end = _flat(table, "shingles"), np.cumsum(n)
    m = int(np.count_nonzero(table.column("i").to_numpy() == lo))
    first = 0 if lo == hi else m
    cut = int(end[m - 1]) if m else 0
    links = np.zeros(len(node), np.int64)
    if not m or first == len(node):
        return node, links
    vocabulary, place = np.unique(flat[cut if first else 0 :], return_inverse=True)
    owner = np.repeat(np.arange(len(node) - first), n[first:])[np.argsort(place, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(place))])
    at = np.minimum(np.searchsorted(vocabulary, flat[:cut]), len(vocabulary) - 1)
    known = vocabulary[at] == flat[:cut]
    for q in range(m):
        own = slice(end[q] - n[q], end[q])
        held = at[own][known[own]]
        count = start[held + 1] - start[held]
        total = np.cumsum(count)
        entries = np.arange(total[-1] if len(total) else 0) + np.repeat(start[held] - (total - count), count)
        both = np.bincount(owner[entries], minlength=len(node) - first)
        hit = both * den >= (n[first:] + n[q] - both) * num
        if not first:
            hit[q] = False
        links[q] += weight[first:][hit].sum()
        if first:
            links[first:][hit] += weight[q]
    return node, links


def _link_counts(sets: DataFrame, labels: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``node, links``: rows of all other sets that link with a set, for each with a link."""
    members = sets.join(dealt(labels.select(F.col("v").alias("node"), "label")), "node").join(dealt(nodes.select("node", F.col("rows").alias("weight"))), "node")
    blocks = members.groupBy("label").agg(F.ceil(F.sum("n") / _BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = members.join(F.broadcast(materialise(blocks.filter("blocks > 1"))), "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = members.select("label", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", F.col("weight").cast("long").alias("weight"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            done = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if held and tuple(keys[:, i]) != key:
                    done.append(_tally(held, num, den))
                    held = []
                key = tuple(keys[:, i])
                held.append(batch.slice(i, j - i))
            if done:
                yield pa.record_batch({"node": np.concatenate([x[0] for x in done]), "links": np.concatenate([x[1] for x in done])})
        if held:
            node, links = _tally(held, num, den)
            yield pa.record_batch({"node": node, "links": links})

    parts = keyed.repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi", "i").mapInArrow(run, "node long, links long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def ngram_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, num: int = NUM, den: int = DEN, dense: int = DENSE, links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest doc_id that links lead to.

    With ``links`` also ``n_links``: the other rows, copies included, that the row itself links to.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for seed in range(1, 9):
        small = _SMALL if seed < 8 else 1 << 62  # the last one has no bands, so every set fits
        rows = materialise(_nodes(docs, size, num, den, seed, small))
        seen = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("fits").alias("fits"), F.count("*").alias("rows"))
        nodes = materialise(seen)
        if nodes.filter("c0 != c1 or n0 != n1").first() is not None:
            raise RuntimeError("two different sets have one identity of 64 bits")
        if nodes.filter("not fits").isEmpty():
            break
    shingles = nodes.agg(F.sum("n0")).first()[0] or 0
    parts = max(2 * partitions(spark), int(shingles // _PART_SHINGLES))
    share = spark.sparkContext.broadcast
    hot = share(bloom.build(materialise(_hot_symbols(docs, size, num, den, seed, small, dense, parts)), "h"))
    groups = materialise(_groups(docs, size, num, den, seed, small, hot, dense, parts))
    members = groups.filter("kind = 2").select("sig", F.col("a").alias("node"))
    shared = members.groupBy("node").agg(F.count("*").alias("shared"))
    best = members.join(dealt(shared), "node").groupBy("sig").agg(F.max_by("node", F.struct("shared", "node")).alias("centre"), F.count("*").alias("size"))
    members = materialise(_keyed(members, materialise(best), "sig", "inner"))
    stars = materialise(_pairs(groups.filter("kind = 0"), "a", "b").unionByName(_pairs(members.filter("node != centre"), "centre", "node", "size")))
    others = groups.filter("kind = 1").select("a", "b").distinct()
    wanted = groups.select(F.explode(F.array("a", "b")).alias("node"))
    sketches = _of_nodes(docs, nodes, wanted, size, "array<long>", "sketch", _bit_sketch)
    edges, sets = _verified(_plausible(stars, sketches, num, den), docs, nodes, size, num, den)
    labels = connected_components(edges.select(F.col("c").alias("u"), F.col("m").alias("v")))
    of = lambda c: dealt(labels.select(F.col("v").alias(c), F.col("label").alias(f"l{c}")))
    apart = others.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    crossing = _crossing(members, labels, sketches, num, den)
    second = _plausible(_pairs(apart, "a", "b"), sketches, num, den).unionByName(_pairs(crossing.withColumn("size", F.lit(16 * _STAR)), "a", "b", "size"))
    second = materialise(second.dropDuplicates(["c", "m"]))
    more, late = (edges.limit(0), sets.limit(0)) if second.isEmpty() else _verified(second, docs, nodes, size, num, den)
    if not more.isEmpty():
        whole = edges.unionByName(more).select(F.col("c").alias("u"), F.col("m").alias("v"))
        labels = connected_components(whole)
    named = nodes.select("node", "rep", "rows").join(dealt(labels.withColumnRenamed("v", "node")), "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(dealt(least), "label")
    columns = [F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if links:
        sets = sets.unionByName(late.join(dealt(sets.select("node")), "node", "left_anti"))
        found = found.join(dealt(_link_counts(sets, labels, nodes, num, den)), "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    else:
        found = found.select("node", "component_id")
    out = rows.select("doc_id", "n", "node").join(dealt(found), "node", "left")
    return out.select("doc_id", *columns)


def mixed(df: DataFrame, column: str) -> DataFrame:
    """``column`` hashed as ``mix64`` does it, for a bit filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({column: mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)})

    return df.select(column).mapInArrow(run, f"{column} long")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, all its columns.

    Documents without words link with nothing, so all of them stay. Rows that repeat both id and text
    of the document that stays are one document too.
    """
    found = ngram_components(docs, id, text)
    name = unused(docs, "_stay")
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dealt(stay), F.col(id).cast("long").eqNullSafe(F.col(name)), "left_semi").dropDuplicates([id, text])
