"""JSON payloads as variants: parsed once, read by typed paths, with what does not parse in quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions import text as X

#: Fields of a player page with their types.
PLAYER_FIELDS = {name: (path, "array<string>" if name == "keywords" else "string") for name, path in X.PLAYER_PATHS.items()}


def parsed(df: DataFrame, json: Column, name: str = "payload") -> DataFrame:
    """``df`` with the payload as a variant and ``fault``: null, ``missing`` for no text, ``malformed`` for one that is no JSON.

    The text is parsed once, however many fields are read from the variant later on.
    """
    out = df.withColumn("_json", json).withColumn(name, F.try_parse_json("_json"))
    fault = F.when(F.col("_json").isNull(), "missing").when(F.col(name).isNull(), "malformed")
    return out.withColumn("fault", fault).drop("_json")


def typed(df: DataFrame, fields: dict[str, tuple[str, str]], name: str = "payload") -> DataFrame:
    """``df`` with a column for each ``field: (path, type)``; null where the path is not there or holds another type. The variant goes."""
    return df.withColumns({field: F.try_variant_get(name, path, kind) for field, (path, kind) in fields.items()}).drop(name)


def page_fields(pages: DataFrame, html: str = "html", variable: str = X.PLAYER, fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Fields of the object that pages assign to ``variable`` beside the pages' columns, and ``fault``; a ``description`` is cut to 500 characters."""
    out = typed(parsed(pages, X.embedded_json(F.col(html), variable)), fields or PLAYER_FIELDS)
    return out.withColumn("description", F.nullif(F.substring("description", 1, 500), F.lit(""))) if "description" in out.columns else out


def faults(df: DataFrame) -> DataFrame:
    """The quarantine: rows whose payload is missing or malformed."""
    return df.filter(F.col("fault").isNotNull())
