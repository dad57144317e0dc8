"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of ASCII letters, digits and all other than ASCII characters, ASCII upper case lowered. A word's input is its embedding, if
the sample's vocabulary has it, beside the mean embedding of its hashed byte trigrams. Windows of
``WINDOW`` words overlap by half and cover the whole text; each is read in both directions, pooled
by attention and scored. A document's score is that of its highest window; a text without words is
scored as one empty window.

Training is on the driver, on a bounded sample of whole labelled texts: of each class, in the order of the hashes of
their ids, at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` bytes together; a text that does not fit is passed over. A document with both labels is toxic; rows that repeat
an id and text are one. Labels belong to documents, so each round picks the window with the highest
score of each document and learns on these. Word embeddings start from the words' log odds in the sample, and
the bias is set at the end so that 0.5 separates the sample best. Without labels of both classes every document gets the
one there is, or 0.

Null texts count as empty, texts may be of any length, a null id is not held out, other columns play no part, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded
from watchloom.llm.text_hash import mix64, string_buffers, text_slices, words

#: Rows and bytes of each class in the training sample, at most.
SAMPLE, SAMPLE_BYTES = 1500, 6_000_000
VOCABULARY = 20_000
WINDOW, STEP = 48, 24
_EMBED, _CHARS, _HIDDEN, _ATTEND = 8, 8, 8, 8
_BUCKETS = 4096
_CHUNK = 4096


_LETTERS = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Text:
    """Words of some documents as rows of a table of distinct words, and their windows."""

    hashes: np.ndarray  # distinct words
    gram: np.ndarray  # trigram buckets of the distinct words, in order
    gram_first: np.ndarray
    word: np.ndarray  # each word's row
    start: np.ndarray  # windows: first word, length, document
    size: np.ndarray
    doc: np.ndarray


def read(raw: np.ndarray, offsets: np.ndarray) -> Text:
    raw = _LETTERS[raw]
    w = words(raw, offsets, lower=True)
    hashes, at, word = np.unique(w.hash, return_index=True, return_inverse=True)
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    lower = np.concatenate([[0], lower, [0]]).astype(np.uint64)
    s, n = w.start[at], w.end[at] - w.start[at]
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    k = np.arange(int(first[-1])) - np.repeat(first[:-1], n)
    p = np.repeat(s, n) + k + 1
    left = np.where(k > 0, lower[p - 1], 0)
    right = np.where(k < np.repeat(n, n) - 1, lower[np.minimum(p + 1, len(lower) - 1)], 0)
    gram = (mix64((left << np.uint64(16)) | (lower[p] << np.uint64(8)) | right) % np.uint64(_BUCKETS)).astype(np.int32)
    count = np.diff(w.first)
    windows = np.maximum(1, -(-(count - WINDOW) // STEP) + 1)
    doc = np.repeat(np.arange(len(count)), windows)
    order = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = w.first[doc] + order * STEP
    size = np.minimum(WINDOW, w.first[doc + 1] - start)
    return Text(hashes, gram, first, word, start, size, doc)


class Network:
    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.15, s).astype(np.float32)
        self.vocabulary = vocabulary
        d = _EMBED + _CHARS
        self.p = {"word": f(len(vocabulary) + 1, _EMBED) * 0.3, "char": f(_BUCKETS, _CHARS), "A": f(2 * _HIDDEN, _ATTEND) * 2, "v": f(_ATTEND) * 2, "w": f(2 * _HIDDEN) * 2, "b": np.array([-1.0], np.float32)}
        self.p["word"][1:, 0] = odds
        for k in "fb":
            self.p |= {f"X{k}": f(d, 3 * _HIDDEN) * 2, f"c{k}": np.zeros(3 * _HIDDEN, np.float32), f"U{k}": f(_HIDDEN, 3 * _HIDDEN) * 2}

    def inputs(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        """Input vector of each distinct word, and its row of the vocabulary (0: unknown)."""
        at = np.minimum(np.searchsorted(self.vocabulary, t.hashes), max(len(self.vocabulary) - 1, 0))
        row = np.where(self.vocabulary[at] == t.hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(t.hashes), np.int64)
        if not len(t.hashes):
            return np.zeros((0, _EMBED + _CHARS), np.float32), row
        chars = np.add.reduceat(self.p["char"][t.gram], t.gram_first[:-1]) / np.diff(t.gram_first)[:, None]
        return np.concatenate([self.p["word"][row], chars], 1).astype(np.float32), row

    def _run(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, k: str, keep: bool):
        """States of one direction; x holds projected inputs of distinct words, the last row is padding."""
        n, steps = at.shape
        H, U = _HIDDEN, self.p[f"U{k}"]
        h = np.zeros((n, H), np.float32)
        out, saved = np.zeros((steps, n, H), np.float32), []
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            g, m = x[at[:, t]], mask[:, t : t + 1]
            zr = _sigmoid(g[:, : 2 * H] + h @ U[:, : 2 * H])
            z, r = zr[:, :H] * m, zr[:, H:]
            c = np.tanh(g[:, 2 * H :] + (r * h) @ U[:, 2 * H :])
            new = h + z * (c - h)
            if keep:
                saved.append((t, h, zr[:, :H], r, c))
            h = out[t] = new
        return out, saved

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        runs = {}
        for k in "fb":
            g = np.concatenate([x @ self.p[f"X{k}"] + self.p[f"c{k}"], np.zeros((1, 3 * _HIDDEN), np.float32)])
            runs[k] = self._run(g, at, mask, k, keep)
        states = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        u = np.tanh(states @ self.p["A"])
        e = np.where(mask.T > 0, u @ self.p["v"], -1e9)
        a = np.exp(e - e.max(0)) * mask.T
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = (a[:, :, None] * states).sum(0)
        return pooled @ self.p["w"] + self.p["b"][0], (runs, states, u, a, pooled)

    def gather(self, t: Text, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(WINDOW)
        mask = k < t.size[which][:, None]
        at = np.where(mask, np.append(t.word, len(t.hashes))[np.minimum(t.start[which][:, None] + k, len(t.word))], len(t.hashes))
        return at, mask.astype(np.float32)

    def logits(self, t: Text) -> np.ndarray:
        """Of every window."""
        x, _ = self.inputs(t)
        out = np.zeros(len(t.doc), np.float32)
        for i in range(0, len(out), _CHUNK):
            which = np.arange(i, min(i + _CHUNK, len(out)))
            out[which] = self.forward(x, *self.gather(t, which))[0]
        return out

    def documents(self, t: Text, docs: int) -> np.ndarray:
        best = np.full(docs, -np.inf, np.float32)
        np.maximum.at(best, t.doc, self.logits(t))
        return best

    def gradients(self, t: Text, which: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x, row = self.inputs(t)
        at, mask = self.gather(t, which)
        logit, (runs, states, u, a, pooled) = self.forward(x, at, mask, True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["b"][0], g["w"] = d.sum(), pooled.T @ d
        dp = d[:, None] * self.p["w"]
        da = (states * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        du = de[:, :, None] * self.p["v"] * (1 - u * u)
        g["v"] = (de[:, :, None] * u).sum((0, 1))
        g["A"] = np.tensordot(states, du, ([0, 1], [0, 1]))
        ds = a[:, :, None] * dp + du @ self.p["A"].T
        H = _HIDDEN
        dx = np.zeros_like(x)
        for k, part in (("f", ds[:, :, :H]), ("b", ds[:, :, H:])):
            U, dg = self.p[f"U{k}"], np.zeros((len(x) + 1, 3 * H), np.float32)
            dh = np.zeros_like(part[0])
            for s, h, z, r, c in reversed(runs[k][1]):
                m = mask[:, s : s + 1]
                dh = dh + part[s]
                dz = dh * m * (c - h) * z * (1 - z)
                dc = dh * m * z * (1 - c * c)
                drh = dc @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                zr = np.concatenate([dz, dr], 1)
                g[f"U{k}"][:, : 2 * H] += h.T @ zr
                g[f"U{k}"][:, 2 * H :] += (r * h).T @ dc
                np.add.at(dg, at[:, s], np.concatenate([zr, dc], 1))
                dh = dh * (1 - m * z) + drh * r + zr @ U[:, : 2 * H].T
            dg = dg[:-1]
            g[f"X{k}"], g[f"c{k}"] = x.T @ dg, dg.sum(0)
            dx += dg @ self.p[f"X{k}"].T
        np.add.at(g["word"], row, dx[:, :_EMBED])
        g["word"][0] = 0
        n = np.diff(t.gram_first)
        np.add.at(g["char"], t.gram, np.repeat(dx[:, _EMBED:] / n[:, None], n, axis=0))
        return g


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in self.p.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            x -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)


def _some(t: Text, which: np.ndarray) -> tuple[Text, np.ndarray]:
    """The part of a text that some windows need, so that a step costs what its windows hold."""
    k = np.arange(WINDOW)
    own = k < t.size[which][:, None]
    rows, word = np.unique(t.word[(t.start[which][:, None] + k)[own]], return_inverse=True)
    n = np.diff(t.gram_first)[rows]
    first = np.concatenate([[0], np.cumsum(n)])
    grams = np.repeat(t.gram_first[rows], n) + np.arange(int(n.sum())) - np.repeat(first[:-1], n)
    start = np.cumsum(t.size[which]) - t.size[which]
    return Text(t.hashes[rows], t.gram[grams], first, word, start, t.size[which], t.doc[which]), np.arange(len(which))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 10, batch: int = 128, seed: int = 7) -> Network:
    """Train on whole labelled documents."""
    raw, offsets = string_buffers(pa.array(texts, pa.string()))
    t = read(raw, offsets)
    toxic = np.asarray(toxic, np.float32)
    docs = len(texts)
    count = np.bincount(t.doc, minlength=docs)
    if not docs or toxic.min() == toxic.max() or not len(t.hashes):
        net = Network(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        net.p["w"][:] = 0
        net.p["b"][0] = -4.0 if not docs or toxic.mean() < 0.5 else 4.0
        return net
    first = np.searchsorted(t.doc, np.arange(docs))
    doc_of_word = np.repeat(np.arange(docs), np.diff(words(_LETTERS[raw], offsets, lower=True).first))
    pairs = np.unique(doc_of_word * np.int64(len(t.hashes)) + t.word)
    of_doc, of_word = pairs // len(t.hashes), pairs % len(t.hashes)
    df = np.bincount(of_word, minlength=len(t.hashes))
    bad = np.bincount(of_word, toxic[of_doc], len(t.hashes))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((df - bad + 0.5) / (docs - toxic.sum() + 1))
    odds = odds * np.minimum(df, 8) / 8
    chosen = np.sort(np.argsort(-df, kind="stable")[:VOCABULARY])
    chosen = chosen[df[chosen] > 1]
    net = Network(t.hashes[chosen], (odds[chosen] / 2).astype(np.float32), seed)
    # the first choice of windows: those with the word of the highest odds
    own = np.append(odds, -99.0)[net.gather(t, np.arange(len(t.doc)))[0]]
    value = own.max(1)
    adam, r = _Adam(net.p, 0.02), np.random.default_rng(seed)
    for step in range(rounds):
        if step > 1:
            value = net.logits(t)
        adam.rate = 0.02 if step < rounds // 2 else 0.006
        best = np.array([first[d] + int(value[first[d] : first[d] + count[d]].argmax()) for d in range(docs)])
        clean = np.flatnonzero(toxic == 0)
        other = first[clean] + (r.random(len(clean)) * count[clean]).astype(np.int64)
        which, y = np.concatenate([best, other]), np.concatenate([toxic, np.zeros(len(other), np.float32)])
        order = r.permutation(len(which))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            adam.step(net.gradients(*_some(t, which[own]), y[own]))
    score = np.full(docs, -np.inf, np.float32)
    np.maximum.at(score, t.doc, net.logits(t))
    order = np.argsort(score)
    wrong = np.concatenate([[(toxic == 0).sum()], (toxic == 0).sum() - np.cumsum(np.where(toxic[order] == 0, 1, -1))])
    k = np.flatnonzero(wrong == wrong.min())
    k = int(k[len(k) // 2])
    edges = np.concatenate([[score[order[0]] - 1], score[order], [score[order[-1]] + 1]])
    net.p["b"][0] -= (edges[k] + edges[k + 1]) / 2
    return net


def _fitting(rows: list, size: int, most: int) -> list:
    """Rows in order, as many as stay within a number and their bytes together; one that does not fit is passed over."""
    out, held = [], 0
    for r in rows:
        if len(out) < size and held + r["_bytes"] <= most:
            out.append(r)
            held += r["_bytes"]
    return out


def training_sample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Labelled texts of each class, bounded in number and bytes, of rows whose crc32(id as text) mod 5 is not 0."""
    key = F.col(id).cast("string")
    own = labels.filter(F.col(label).isin(0, 1) & (F.crc32(key) % 5 != 0)).groupBy(F.col(id).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    own = own.join(docs.select(F.col(id).cast("long").alias("_id")), "_id", "left_semi")  # labels of documents that are not there take no place
    few = [own.filter(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(2 * size) for c in (0, 1)]
    small = F.broadcast(few[0].unionByName(few[1]))  # at most 4 * size rows
    found = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text")).join(small, "_id")
    # first which rows, by ids and lengths alone, at most ``size`` a class for each of the ids
    told = found.select("_id", "_label", F.xxhash64("_text").alias("_hash"), F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_bytes")).distinct()
    by = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id", "_hash")
    light = told.filter(F.col("_bytes") <= most).withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= 2 * size).orderBy("_label", "_k").collect()
    chosen = [r for c in (0, 1) for r in _fitting([r for r in light if r["_label"] == c], size, most)]
    if not chosen:
        return [], np.zeros(0, np.float32)
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(r["_id"], r["_hash"]) for r in chosen], "_id long, _hash long"))  # at most 2 * size rows
    texts = found.withColumn("_hash", F.xxhash64("_text")).join(picked, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    rows = texts.orderBy(F.xxhash64("_id"), "_id", "_hash").collect()  # at most 2 * most bytes of text
    return [r["_text"] or "" for r in rows], np.array([r["_label"] for r in rows], np.float32)


def score_table(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null texts count as empty."""
    net = bounded(docs.sparkSession).sparkContext.broadcast(fit(*training_sample(docs, labels, id, text, label, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in text_slices(batch, "text"):
                score = _sigmoid(net.value.documents(read(raw, off), j - i).astype(np.float64))
                yield pa.record_batch(
                    {"doc_id": batch.column(0).slice(i, j - i), "held_out": batch.column(1).slice(i, j - i), "score": score, "predicted": (score >= 0.5).astype(np.int32)}
                )

    held = F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
