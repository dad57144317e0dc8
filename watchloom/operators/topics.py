"""Topic columns, and their aggregates. Entities and nouns come from tables that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions import text as X


_NO_NAMES = "array<string>"


def _none() -> Column:
    return F.array().cast(_NO_NAMES)


def entities(docs: DataFrame, id: str, text: str, gazetteer: DataFrame, words: int = 4) -> DataFrame:
    """``id, entities``: phrases of up to ``words`` words that the gazetteer ``(phrase, label)`` lists; longer ones hide those they hold."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), lambda t: t != "")
    split = docs.select(F.col(id), tokens.alias("ts"))
    # each word with those that follow it; the join on the first word leaves few of them
    ahead = F.transform("ts", lambda t, p: F.struct(p.alias("pos"), t.alias("first"), F.array_join(F.slice("ts", p + 1, words), " ").alias("ahead")))
    each = split.select(id, F.explode(ahead).alias("g")).select(id, "g.*")
    listed = gazetteer.select(F.lower("phrase").alias("phrase")).distinct()
    parts = F.split("phrase", " ")
    listed = listed.select("phrase", F.get(parts, F.lit(0)).alias("first"), F.size(parts).alias("n")).filter(F.col("n") <= words)
    hits = each.join(listed, "first").filter(F.startswith(F.concat("ahead", F.lit(" ")), F.concat("phrase", F.lit(" "))))
    reach = F.max(F.col("pos") + F.col("n")).over(Window.partitionBy(id).orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    kept = hits.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("pos") + F.col("n") > F.col("reach")))
    first = kept.groupBy(id, "phrase").agg(F.min("pos").alias("pos"))
    return first.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phrase"))), lambda s: s["phrase"]).alias("entities"))


def nouns(docs: DataFrame, id: str, text: str, lexicon: DataFrame, language: str | None = None) -> DataFrame:
    """``id, nouns``: distinct words that the lexicon ``(word)`` lists, in order, of two characters and more.

    Stop words and numbers are left out, weak nouns too unless the column ``ner``, where there is one, has them in an
    entity; for rows whose ``language`` is hindi only that language's stop words are.
    """
    ner = F.coalesce(F.col("ner"), _none()) if "ner" in docs.columns else _none()
    held = F.flatten(F.transform(ner, lambda e: F.split(F.lower(e), " ")))
    hindi = F.coalesce(F.col(language) == "hindi", F.lit(False)) if language else F.lit(False)
    each = docs.select(id, held.alias("held"), hindi.alias("hindi"), F.posexplode(F.split(F.col(text), r"(?U)\s+")).alias("place", "token"))
    # a dash inside a token makes two words of it
    each = each.select(id, "held", "hindi", "place", F.posexplode(F.split(F.lower(X.sanitise_topic(F.col("token"))), " ")).alias("part", "word"))
    stop = F.col("word").isin(*X.STOP_WORDS) | F.col("word").rlike(r"^\p{Nd}+$")
    weak = F.col("word").isin(*X.WEAK_NOUNS) & ~F.array_contains("held", F.col("word"))
    out = F.when(F.col("hindi"), F.col("word").isin(*X.HINDI_STOP_WORDS)).otherwise(stop | weak)
    hits = each.filter((F.length("word") >= 2) & ~out).join(lexicon.select(F.lower("word").alias("word")).distinct(), "word")
    first = hits.groupBy(id, "word").agg(F.min(F.struct("place", "part")).alias("pos"))
    return first.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("nouns"))


def enrich(docs: DataFrame, text: str, language: str, id: str | None = None, gazetteer: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``text_v1, hashtags, micro_topics`` for any text column; entity and noun columns are used if there.

    ``text_v1`` is made for hinglish rows only and is what their entities and nouns come from; those of hindi rows come
    from the normalised text, all others from the text itself. With a gazetteer ``ner`` and with a lexicon ``nouns`` are
    made here; ``id`` is then a column that no two rows share.
    """
    c = F.col(text)
    out = docs.withColumn("text_v1", F.when(F.col(language) == "hinglish", X.text_v1(c))).withColumn("hashtags", X.hashtags(c))
    if (gazetteer is not None or lexicon is not None) and id is None:
        raise ValueError("entities and nouns need the id column of the rows")
    source = F.when(F.col(language) == "hinglish", F.col("text_v1")).when(F.col(language) == "hindi", X.normalise(c)).otherwise(c)
    if gazetteer is not None:
        bare = out.select(id, F.regexp_replace(source, r"\.?#[\p{L}\p{N}_]*", " ").alias("_bare"))
        found = entities(bare, id, "_bare", gazetteer).withColumnRenamed("entities", "ner")
        clean = F.transform("ner", lambda e: F.lower(X.sanitise_topic(e)))
        found = found.withColumn("ner", F.array_distinct(F.filter(clean, lambda e: F.length(e) >= 2)))
        out = out.drop("ner").join(found, id, "left").withColumn("ner", F.coalesce("ner", _none()))
    if lexicon is not None:
        own = out.select(id, F.col(language).alias("_language"), source.alias("_source"), *(["ner"] if "ner" in out.columns else []))
        out = out.drop("nouns").join(nouns(own, id, "_source", lexicon, "_language"), id, "left").withColumn("nouns", F.coalesce("nouns", _none()))
    ner = F.coalesce(F.col("ner"), _none()) if "ner" in out.columns else _none()
    own = F.coalesce(F.col("nouns"), _none()) if "nouns" in out.columns else _none()
    return out.withColumn("micro_topics", X.merge_topics(F.col("hashtags"), ner, own))


def enrich_events(events: DataFrame, id: str | None = None, gazetteer: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Topics of active watches; null for all other events."""
    own = (F.col("type") == "watch") & (F.col("engagement") == "active")
    out = enrich(events, "text_clean", "language_type", id, gazetteer, lexicon)
    made = [c for c, t in (("ner", gazetteer), ("nouns", lexicon)) if t is not None]
    return out.withColumns({c: F.when(own, F.col(c)) for c in ("text_v1", "hashtags", "micro_topics", *made)})


def report(events: DataFrame) -> DataFrame:
    """How many events and active watches a user has, how many of them have topics, and the topics of each kind."""
    total = lambda c: F.sum(F.greatest(F.size(c), F.lit(0)) if c in events.columns else F.lit(0)).cast("long").alias(c)
    active = F.count_if((F.col("type") == "watch") & (F.col("engagement") == "active"))
    return events.groupBy("user_id").agg(F.count("*").alias("events"), active.alias("active_watches"), F.count_if(F.size("micro_topics") > 0).alias("with_topics"), *[total(c) for c in ("hashtags", "ner", "nouns", "micro_topics")])


def top_topics(rows: DataFrame, topics: str, keys: tuple[str, ...] = (), seq: str = "seq", n: int = 50) -> DataFrame:
    """The n most frequent topics of each key, ties to the first seen, with the number of distinct ones.

    First the n best of each of 256 hash groups, then the n best of those, so no task ranks all topics of a key.
    """
    each = rows.select(*keys, seq, F.posexplode(topics).alias("pos", "topic"))
    counts = each.groupBy(*keys, "topic").agg(F.count("*").alias("n"), F.min(F.struct(seq, "pos")).alias("s")).withColumn("_g", F.pmod(F.xxhash64("topic"), F.lit(256)))
    few = counts.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(F.desc("n"), "s"))).filter(F.col("_k") <= n)
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    ranked = few.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "s"))).filter(F.col("rank") <= n)
    total = counts.groupBy(*keys).agg(F.count("*").alias("distinct"))
    ranked = ranked.join(total, list(keys)) if keys else ranked.crossJoin(F.broadcast(total))  # one row
    return ranked.select(*keys, "rank", "topic", "n", "distinct")
