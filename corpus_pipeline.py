"""Corpus pipeline: language ID, near-duplicate join, passage dedup, mixing and tokenisation.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; between stages the rows are written as Parquet
to the shared folder and read again. All stages but the last return the columns of ``documents``.

All stages take null ids, texts, languages and sources, empty and very long texts, rows that repeat and columns with the names used
inside; what becomes of them is said with each stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import bpe, language_id, mixing, ngram_join, substring_dedup
from watchloom.llm.storage import materialise, unused
from watchloom.session import ship

#: Name of the vocabulary among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: A document is drawn at most this often, and no source is cut below one whole epoch.
MAX_EPOCHS = 2.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (null or no letters) or in another than their label says go; unlabelled ones get the prediction.

    Repeated rows fare alike. If no row of the training part has a label, nothing is known and nothing goes.
    """
    ship(spark)
    models = language_id.fit(language_id.training_part(docs))
    if not models[0].langs:
        return docs
    name, score = unused(docs, "_lang"), unused(docs, "_score")
    found = language_id.identify(docs, models, lang_col=name, score_col=score)
    kept = found.filter((F.col(name) != language_id.UNKNOWN) & (F.col("lang").isNull() | (F.col("lang") == F.col(name))))
    return kept.withColumn("lang", F.coalesce("lang", name)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest id, null first.

    Texts without words link with nothing and stay. Of rows that repeat id and text one stays.
    """
    ship(spark)
    return ngram_join.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that stand earlier too are cut; ``n_chars`` follows the text.

    A null text stays null, with null characters. Rows that repeat id and text fare alike; a text may become empty, its row stays.
    """
    ship(spark)
    cut = substring_dedup.dedup_texts(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit, each row at least once; rows are draws.

    A null source is one of its own; texts without words are drawn with the epoch they lie in.
    """
    ship(spark)
    return mixing.redrawn(docs, max_epochs=MAX_EPOCHS, keep_all=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``documents`` with ``tokens`` (ids), ``n_tokens`` and ``decoded``, the text that the ids give back; a null text has no tokens.

    Draws of a row are neighbours, and of equal neighbours one is encoded.
    """
    import public_tokenizers

    ship(spark)
    return bpe.encode_table(docs, public_tokenizers.path(VOCABULARY)).withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: No SQL: language profiles and byte-pair encoding are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
