"""Spelling variants: words one edit apart, grouped below their most frequent neighbour.

Each word's deletions and replacements are generated as hashes, which a table of random numbers by place and code point lets change in
one step, and probed against blocked Bloom filters of the vocabulary, one shard for each word length. Only edits that the filter has
are spelt out and shuffled to an exact join with the vocabulary, which removes what the filter let through by mistake. An insertion is another word's
deletion, and a replacement is generated from the end with the larger code point, so every pair comes up once and is then told to both words.

The filters of a pass hold at most ``FILTER_BYTES``; a vocabulary that needs more is probed in several passes, each with other lengths
or other hash classes of a length, so nothing that is broadcast grows with the data and nothing is left out.

Cases: null texts have no words; a null id is an id like any other (hashed as the empty text). Repeated rows count as often as they
stand. Texts and words may be of any length. Ties go to the word first in code-point order. Empty tables give empty results; extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded, materialise, partitions
from watchloom.llm.text_hash import mix64

#: Words are runs of these letters; only A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]"
LENGTH, LEAST, RATIO, DELETED = 6, 5, 5, 199
#: Bytes of the filters that one pass broadcasts, bits for each word in them, and the least number of 64-bit blocks of a shard.
FILTER_BYTES, BITS, BLOCKS = 2**24, 20, 64
#: Counts that a task holds before it hands them on, words that a task probes, cells of a matrix of words, bytes of a batch of spelt-out edits.
HELD, DEALT, CELLS, BYTES = 2**18, 20_000, 2**14, 2**21
_PLACE, _LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, deleted: int = DELETED) -> DataFrame:
    """``word, n``: words of at least ``length`` code points with at least ``least`` occurrences.

    Of a run whose checksum with its document's id ``deleted`` divides, the code point at the checksum's place is left out first.
    """
    letters = re.compile(f"{RUN}{{{length},}}")

    def emit(counts: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1)):
                seed = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for word, n in Counter(letters.findall(body.as_py().lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % deleted == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    rows = bounded(docs.sparkSession) and docs.filter(F.col(text).isNotNull()).select(F.col(id).cast("string"), F.col(text).cast("binary"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _numbers(codes: np.ndarray, place) -> np.ndarray:
    """The random number of a code point at a place; a word's hash is the exclusive or over its places."""
    return mix64(codes.astype(np.uint64) * _LETTER + np.asarray(place, np.uint64) * _PLACE)


def _matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows of the list, code points)`` of words of equal length, in pieces."""
    size = np.array([len(w) for w in words])
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        step = max(1, CELLS // int(length))
        for k in range(0, len(own), step):
            rows = own[k : k + step]
            codes = np.frombuffer("".join(words[r] for r in rows).encode("utf-32-le"), "<u4").reshape(len(rows), length)
            yield rows, codes


class Filters:
    """Bloom filters of one pass: a shard is the words of a length, or those of them in a hash class."""

    def __init__(self, shards: list[tuple[int, int, int, int]]):
        """``shards``: length, class, classes of that length, blocks."""
        self.shards, at = {}, 0
        for length, part, parts, blocks in shards:
            self.shards[length, part] = (parts, at, blocks)
            at += blocks
        self.classes = {length: [(part, *shard) for (own, part), shard in self.shards.items() if own == length] for length, _ in self.shards}
        self.words = np.zeros(at, np.uint64)

    def places(self, length: int, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(indices into h, block, bits)`` by shard."""
        for part, parts, at, blocks in self.classes.get(length, ()):
            own = np.arange(len(h)) if parts == 1 else np.flatnonzero((h >> np.uint64(24)) % np.uint64(parts) == part)
            x = h[own]
            bits = np.zeros(len(x), np.uint64)
            for k in range(4):
                bits |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
            yield own, at + (((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64), bits

    def has(self, length: int, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that the filters of this length have."""
        found = [own[(self.words[block] & bits) == bits] for own, block, bits in self.places(length, h)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def passes(lengths: dict[int, int], filter_bytes: int = FILTER_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """Shards by pass for so many words of each length."""
    limit, out, left = filter_bytes // 8, [], 0
    for length, count in sorted(lengths.items()):
        blocks = max(BLOCKS, count * BITS // 64 + 1)
        parts = -(-blocks // limit)
        for part in range(parts):
            own = min(limit, max(BLOCKS, -(-blocks // parts)))
            if own > left:
                out.append([])
                left = limit
            out[-1].append((length, part, parts, own))
            left -= own
    return out


def build_filters(vocabulary: DataFrame, shards: list[tuple[int, int, int, int]]) -> Filters:
    """The filters of a pass, filled by an aggregation of their blocks."""
    empty = Filters(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _matrices(batch.column(0).to_pylist()):
                h = np.bitwise_xor.reduce(_numbers(codes, np.arange(codes.shape[1])[None]), axis=1)
                for _, block, bits in empty.places(codes.shape[1], h):
                    yield pa.record_batch([block, bits.view(np.int64)], names=["block", "bits"])

    rows = vocabulary.select("word").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.words[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return empty


def _edits(codes: np.ndarray, letters: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
    """``(rows, place, new letters or None for a deletion)`` of the edits that the filters have."""
    m, length = codes.shape
    number = _numbers(codes, np.arange(length)[None])
    whole = np.bitwise_xor.reduce(number, axis=1)
    if length in filters.classes:
        for k in range(length):
            row, letter = np.nonzero(codes[:, k, None] > letters[None])
            h = (whole ^ number[:, k])[row] ^ _numbers(letters, k)[letter]
            hit = filters.has(length, h)
            if len(hit):
                yield row[hit], k, letters[letter[hit]]
    if length - 1 in filters.classes:
        moved = np.zeros((m, length + 1), np.uint64)  # hash of the letters from k on, one place further left
        moved[:, 1:length] = _numbers(codes[:, 1:], np.arange(length - 1)[None])
        moved = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
        before = np.zeros(m, np.uint64)
        for k in range(length):
            # of a run of one letter the first is deleted
            row = np.flatnonzero(codes[:, k] != codes[:, k - 1]) if k else np.arange(m)
            hit = row[filters.has(length - 1, before[row] ^ moved[row, k + 1])]
            if len(hit):
                yield hit, k, None
            before = before ^ number[:, k]


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, n, near, near_n``: every two words of ``vocabulary(word, n)`` that are one edit apart, both ways."""
    spark = bounded(vocabulary.sparkSession)
    lengths = {r.length: r.words for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("words")).collect()}
    used = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # letters of RUN
    letters = np.array(sorted(ord(r.c) for r in used if r.c), np.uint32)
    dealt = vocabulary.repartition(max(partitions(spark), sum(lengths.values()) // DEALT), "word")
    found = None
    for shards in passes(lengths, filter_bytes):
        filters = spark.sparkContext.broadcast(build_filters(vocabulary, shards))

        def run(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, counts = batch.column(0).to_pylist(), batch.column(1)
                new, source, held = [], [], 0
                for own, codes in _matrices(words):
                    for rows, k, put in _edits(codes, letters, filters.value):
                        for j, r in enumerate(own[rows]):
                            word = words[r]
                            new.append(word[:k] + (chr(put[j]) if put is not None else "") + word[k + 1 :])
                            source.append(r)
                            held += len(word) + 16
                            if held > BYTES:
                                yield pa.record_batch([pa.array(new), pa.array([words[s] for s in source]), counts.take(pa.array(source))], names=["near", "word", "n"])
                                new, source, held = [], [], 0
                if new:
                    yield pa.record_batch([pa.array(new), pa.array([words[s] for s in source]), counts.take(pa.array(source))], names=["near", "word", "n"])

        edits = dealt.select("word", "n").mapInArrow(run, "near string, word string, n long")
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    real = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{'n' if a == 'word' else 'near_n'}").alias("n"), F.col(b).alias("near"), F.col(f"{'near_n' if a == 'word' else 'n'}").alias("near_n"))
    return real.select(F.inline(F.array(way("word", "near"), way("near", "word"))))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """``word, root`` for ``forms(word, form)`` without cycles and with chains of at most ``hops`` links, by doubling."""
    root, reach = materialise(forms.select("word", F.col("form").alias("root"))), 1
    while reach < hops:
        further = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root, reach = materialise(root.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))), 2 * reach
    return root


def variants(vocabulary: DataFrame, ratio: int = RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``vocabulary(word, n)``; it should be a table, as it is read several times."""
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), "near")))
    each = near_pairs(vocabulary, filter_bytes).unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("b"))
    much = -F.col("b.k") >= ratio * F.col("n")
    each = materialise(each.select("word", F.when(much, F.col("b.near")).alias("form"), "n", "n_near", F.when(much, -F.col("b.k")).alias("form_n")))
    ends = each.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    hops, n = 0, ends.least or 1
    while n * ratio <= (ends.most or 0):  # each form has ``ratio`` times the occurrences of its word
        hops, n = hops + 1, n * ratio
    found = roots(each.filter(F.col("form").isNotNull()), hops)
    return each.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of all words of the texts."""
    return variants(materialise(word_counts(docs, id, text)))
