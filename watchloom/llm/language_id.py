"""Language identification by rank-order n-gram profiles.

A text becomes words of lower-cased letters, each between two borders. Its profile is the list of its
most frequent 1-, 2- and 3-grams inside words, ties by code points. A language's profile is the same
over all training documents of that language. The out-of-place distance adds, for each n-gram of the
document, the difference of the two ranks, or the profile length where the language lacks it; the
least distance wins, ties to the name that sorts first.

Counting goes over every training document: n-grams are counted per Arrow batch and language, and
summed by a shuffle; only the top of each language goes to the driver and to all tasks (``size`` rows for each
label, at most ``MAX_LANGS`` labels at a time: more are tried in turns).

A null text, or one without letters, is ``und`` with the score 0; so is every text if no row has a label to learn from. Texts are
read whole, rows that repeat fare alike, a null id is not held out, other columns play no part, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from watchloom.llm.storage import bounded, materialise

PROFILE = 400
DOCUMENT_PROFILE = 300
UNKNOWN = "und"
#: Labels whose profiles are held at a time.
MAX_LANGS = 2000
_BITS = np.uint64(21)
_BORDER = np.uint64(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a whole text; a border is the code point 1."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = np.full(len(code) + 2, _BORDER)
    c[1:-1] = np.where(letter, code, _BORDER)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != _BORDER) | (c[:-1] != _BORDER)
    c = c[keep]
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    found = np.concatenate([c[c != _BORDER], two, three[c[1:-1] != _BORDER]])
    return np.unique(found, return_counts=True)


def decode(gram: int) -> str:
    """An n-gram as text, borders as ``_``."""
    parts = [p for p in ((gram >> s) & 0x1FFFFF for s in (42, 21, 0)) if p]
    return "".join("_" if p == 1 else chr(p) for p in parts)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:size]]


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``(lang, rank, gram)`` learned from all rows whose label is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                grams, n = _sum(parts)
                yield pa.record_batch({"lang": pa.array([name] * len(grams), pa.string()), "gram": grams.view(np.int64), "n": n})
            held.clear()

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                own = held.setdefault(name.as_py(), [])
                own.append(ngrams(t.as_py()))
                if len(own) == 256:
                    own[:] = [_sum(own)]
            if sum(len(g) for parts in held.values() for g, _ in parts) > 2_000_000:
                yield from flush()
        yield from flush()

    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= size).select("lang", "rank", "gram")


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


class Model:
    """Profiles as arrays sorted by n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size, self.langs, self.tables = size, sorted({r[0] for r in rows}), []
        for name in self.langs:
            own = sorted((np.uint64(g), rank) for lang, rank, g in rows if lang == name)
            self.tables.append((np.array([g for g, _ in own], np.uint64), np.array([r for _, r in own])))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        ranks = np.arange(1, len(grams) + 1)
        out = []
        for known, rank in self.tables:
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            out.append(int(np.where(known[at] == grams, np.minimum(np.abs(rank[at] - ranks), self.size), self.size).sum()))
        return np.array(out)

    def predict(self, text: str | None, size: int = DOCUMENT_PROFILE) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        top = _top(grams, counts, size)
        far = self.distances(top)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(top)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> list[Model]:
    """Models of at most ``MAX_LANGS`` labels each; one without any if no row has a label."""
    names = Window.partitionBy(F.lit(0)).orderBy("lang")
    found = materialise(profiles(labelled, text, lang, size))
    turns = materialise(found.select("lang").distinct().withColumn("turn", F.floor((F.row_number().over(names) - 1) / MAX_LANGS)))
    last = turns.agg(F.max("turn")).first()[0]
    out = []
    for k in range(0 if last is None else last + 1):
        rows = found.join(turns.filter(F.col("turn") == k), "lang").collect()  # at most MAX_LANGS * size rows
        out.append(Model([(r.lang, r["rank"], r.gram) for r in rows], size))
    return out or [Model([], size)]


def identify(docs: DataFrame, models: list[Model], text: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1; ``und`` and 0 without letters."""
    spark = bounded(docs.sparkSession)
    docs = docs.drop(lang_col, score_col)
    schema = StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])

    def turn(model: Model, first: bool):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shared.value.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
                if not first:  # a closer language of an earlier turn stays; names go up from turn to turn
                    before = zip(batch.column(lang_col).to_pylist(), batch.column(score_col).to_pylist())
                    found = [new if new[1] > old[1] else old for new, old in zip(found, before)]
                    batch = batch.select([c for c in batch.schema.names if c not in (lang_col, score_col)])
                batch = batch.append_column(lang_col, pa.array([x[0] for x in found], pa.string()))
                yield batch.append_column(score_col, pa.array([x[1] for x in found], pa.float64()))

        return run

    for k, model in enumerate(models):
        docs = docs.mapInArrow(turn(model, k == 0), schema)
    return docs


def training_part(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows that may be learned from: crc32 of the id's text modulo 4 is not 2; a null id isn't one."""
    return docs.filter(F.crc32(F.col(id).cast("string")) % 4 != 2)


def predict_table(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by profiles of the training part."""
    models = fit(training_part(docs, id), text, lang)
    held = F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return identify(rows, models).select("doc_id", "held_out", "lang_pred", "score")
