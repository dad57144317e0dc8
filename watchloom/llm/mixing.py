"""Temperature mixing of sources.

A source with the token share p gets a weight proportional to ``p ** a``. The exponent is bisected: the largest
one at which the weights still have the target entropy (a fraction of the largest possible), and
never one below which a source would be repeated more than ``max_epochs`` times within the budget; the repetition limit wins.
What the bisection needs are four numbers: the sums of ``p ** a`` and ``p ** a * ln p``, and the smallest and the largest source.
Up to ``MAX_SOURCES`` totals are summed on the driver, more by Spark.

Realisation. A source is an endless stream of permutations of its documents, one per epoch, ordered by
the MD5 of seed, epoch and doc_id. It gives the documents that start before its quota of tokens, weight times
budget. The stream is cut into blocks so that block b of the mixture holds the next ``weight * block_tokens``
tokens of every source. Places in a stream are running sums, taken in two steps, over hash
buckets and inside each bucket, so no task sees a whole source. Draws are settled on rows without texts; a text is
shuffled once, and its draws leave side by side.

A null source is a source of its own. Null and empty texts have no tokens and come with the epoch they lie
in; a source without any token is given once if there is a budget. With ``keep_all`` each row is drawn at least once. Rows that repeat a doc_id are ordered by the hash of their text;
rows that repeat text and source too are drawn each for itself. Texts may be of any length, columns may have any names but ``_row``, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.storage import materialise

ENTROPY = 0.95
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 100_000
#: The totals of this many sources go to the driver and all tasks; those of more stay a table.
MAX_SOURCES = 100_000
_DIGITS = 3


@dataclass
class Plan:
    exponent: float
    weights: dict
    budget: float


def count_tokens(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(totals: dict, exponent: float) -> dict:
    whole = sum(totals.values())
    raw = {s: (t / whole) ** exponent if t else 0.0 for s, t in sorted(totals.items(), key=lambda x: (x[0] is None, x[0]))}
    norm = sum(raw.values())
    return {s: r / norm for s, r in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def _bisect(holds, low: float, high: float) -> tuple[float, float]:
    """``holds`` is true from low up to a border; both sides of it."""
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low, high


def plan(totals: dict, target_entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None, keep_all: bool = False) -> Plan:
    """Exponent and weights; ``keep_all`` takes the least budget at which no source is cut short of one epoch."""
    own = {s: t for s, t in totals.items() if t}
    if not own:
        return Plan(1.0, {s: 0.0 for s in totals}, 0.0)

    def epochs(a: float) -> tuple[float, float]:
        w = weights(own, a)
        b = max(t / w[s] for s, t in own.items()) if keep_all else float(budget or sum(own.values()))
        return max(w[s] * b / t for s, t in own.items()), b

    goal = target_entropy * math.log(len(own))
    by_entropy = 1.0 if entropy(weights(own, 1.0)) >= goal else _bisect(lambda a: entropy(weights(own, a)) >= goal, 0.0, 1.0)[0]
    if epochs(by_entropy)[0] <= max_epochs:
        a = by_entropy
    else:
        a = _bisect(lambda x: epochs(x)[0] > max_epochs, by_entropy, 1.0)[1]
    a = round(a, 9)
    return Plan(a, {s: 0.0 for s in totals} | weights(own, a), epochs(a)[1])


def source_totals(docs: DataFrame, source: str = "source", text: str = "text") -> dict:
    """Tokens of each source, for as many sources as fit the driver."""
    return {r.s: r.t for r in _totals(docs, source, text).collect()}


def _totals(docs: DataFrame, source: str, text: str) -> DataFrame:
    return docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.sum(count_tokens(text)).alias("t"))


def _sums(totals: DataFrame, whole: float):
    """The sums of ``p ** a`` and ``p ** a * ln p`` over a table of totals, as a function of ``a``."""

    def at(a: float) -> tuple[float, float]:
        p = F.col("t") / whole
        r = totals.filter("t > 0").agg(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.ln(p))).first()
        return float(r[0]), float(r[1])

    return at


def _plan_table(totals: DataFrame, target_entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None, keep_all: bool = False) -> tuple[float, float, float, float]:
    """``plan`` over a table: exponent, norm of the weights, all tokens, budget."""
    n, whole, low, high = totals.filter("t > 0").agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    if not n:
        return 1.0, 1.0, 1.0, 0.0
    sums = _sums(totals, float(whole))

    def entropy_at(a: float) -> float:
        z, s = sums(a)
        return math.log(z) - a * s / z

    def epochs(a: float) -> tuple[float, float]:
        # for exponents up to 1 the largest source is repeated least and the smallest most
        z = sums(a)[0]
        rate = lambda t: (t / whole) ** a / z / t
        b = 1 / rate(high) if keep_all else float(budget or whole)
        return rate(low) * b, b

    goal = target_entropy * math.log(n)
    a = 1.0 if entropy_at(1.0) >= goal else _bisect(lambda x: entropy_at(x) >= goal, 0.0, 1.0)[0]
    if epochs(a)[0] > max_epochs:
        a = _bisect(lambda x: epochs(x)[0] > max_epochs, a, 1.0)[1]
    a = round(a, 9)
    return a, sums(a)[0], float(whole), epochs(a)[1]


def _quotas(docs: DataFrame, source: str, text: str, **limits) -> tuple[DataFrame, bool]:
    """``_s, _total, _weight, _quota, _epochs`` of each source, and whether they are few."""
    spark, keep_all = docs.sparkSession, limits.get("keep_all", False)
    totals = materialise(_totals(docs, source, text))
    first = totals.limit(MAX_SOURCES + 1).collect()
    if len(first) <= MAX_SOURCES:
        held = {r.s: r.t for r in first}
        p = plan(held, **limits)
        rows = [(s, t, float(p.weights[s]), math.floor(p.weights[s] * p.budget)) for s, t in held.items()]
        table = spark.createDataFrame(rows, "_s string, _total long, _weight double, _quota long")
    else:
        a, norm, whole, budget = _plan_table(totals, **limits)
        weight = F.when(F.col("t") > 0, F.pow(F.col("t") / whole, F.lit(a)) / norm).otherwise(0.0)
        table = totals.select(F.col("s").alias("_s"), F.col("t").alias("_total"), weight.alias("_weight"), F.floor(weight * budget).cast("long").alias("_quota"))
    if keep_all:  # a product a hair below the total is the total
        table = table.withColumn("_quota", F.greatest("_quota", "_total"))
    return table.withColumn("_epochs", F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide("_quota", "_total")), F.lit(1)).cast("int"))), len(first) <= MAX_SOURCES


def _drawn(docs: DataFrame, carried: list[str], id: str, text: str, source: str, seed: int, block_tokens: int, **limits) -> DataFrame:
    """One row per draw: ``_columns``, a struct of the ``carried`` ones, and ``_tokens, _epoch, _start, _block, _order``."""
    keep_all = limits.get("keep_all", False)
    table, few = _quotas(docs, source, text, **limits)
    # a row's identity, never null; the count tells apart rows that repeat it
    key = ["_group", "_doc", "_hash"]
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    own = [told(source).alias("_group"), told(id).alias("_doc"), F.xxhash64(text).alias("_hash")]
    light = docs.select(*own, F.col(id).alias("_id"), count_tokens(text).alias("_tokens")).groupBy(*key).agg(F.min("_id").alias("_id"), F.min("_tokens").alias("_tokens"), F.count("*").alias("_copies"))
    table = table.withColumn("_group", F.coalesce(F.concat(F.lit("="), "_s"), F.lit(""))).drop("_s")
    rows = light.join(F.broadcast(table) if few else table, "_group")
    drawn = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
    drawn = drawn.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_epoch").cast("string"), F.lit(":"), F.substring("_doc", 2, 1 << 30))))
    drawn = drawn.withColumn("_bucket", F.substring("_order", 1, _DIGITS))
    drawn = drawn.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    keys = ["_group", "_epoch", "_bucket"]
    sums = drawn.groupBy(*keys).agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_group", "_epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy("_order", "_id", "_hash", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(offsets, keys)
    placed = placed.withColumn("_start", F.col("_epoch") * F.col("_total") + F.col("_before") + F.col("_inside"))
    first = F.col("_epoch") == 0
    kept = placed.filter((F.col("_start") < F.col("_quota")) | (first & ((F.col("_total") == 0) | F.lit(keep_all))))
    block = F.coalesce(F.floor(F.try_divide(F.col("_start"), F.col("_weight") * block_tokens)), F.lit(0)).cast("long")
    # all draws of a row together, back to its text; rows that repeat an identity, if any, are numbered for it
    each = F.sort_array(F.collect_list(F.struct("_epoch", "_start", block.alias("_block"), "_order"))).alias("_draws")
    draws = materialise(kept.groupBy(*key, "_row").agg(F.min("_tokens").alias("_tokens"), F.max("_copies").alias("_copies"), each))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_columns"), *own)
    out = named.join(draws.filter("_copies = 1").drop("_copies", "_row"), key).select("_columns", "_tokens", "_draws")
    several = draws.filter("_copies > 1").drop("_copies")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))).cast("long")
    numbered = named.join(several.select(*key).distinct(), key, "left_semi").withColumn("_row", number)
    out = out.unionByName(numbered.join(several, [*key, "_row"]).select("_columns", "_tokens", "_draws"))
    return out.select("_columns", "_tokens", F.explode("_draws").alias("_d")).select("_columns", "_tokens", "_d._epoch", "_d._start", "_d._block", "_d._order")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block_tokens: int = BLOCK_TOKENS, **limits) -> DataFrame:
    """``docs`` as they are drawn, one row per draw, with ``_tokens, _epoch, _start, _block, _order``; columns of ``docs`` with one of these names give way."""
    added = ("_tokens", "_epoch", "_start", "_block", "_order")
    carried = [c for c in docs.columns if c.lower() not in added]
    return _drawn(docs, carried, id, text, source, seed, block_tokens, **limits).select("_columns.*", *added)


def redrawn(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block_tokens: int = BLOCK_TOKENS, **limits) -> DataFrame:
    """``docs`` as they are drawn, with their own columns whatever these are called."""
    return _drawn(docs, docs.columns, id, text, source, seed, block_tokens, **limits).select("_columns.*")


def mix_table(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **limits) -> DataFrame:
    """``doc_id, source, epoch, n_tokens, block, start_token, order_key`` of every draw."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    drawn = _drawn(rows, ["doc_id", "source"], "doc_id", "text", "source", limits.pop("seed", 0), limits.pop("block_tokens", BLOCK_TOKENS), **limits)
    return drawn.select("_columns.doc_id", "_columns.source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_block").alias("block"), F.col("_start").alias("start_token"), F.col("_order").alias("order_key"))
