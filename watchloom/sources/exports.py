"""Viewing-history exports: archives, their members, and the canonical event table.

Archives are read by the ``binaryFile`` source, one row each, and unpacked in Arrow batches; a user's archive is
bounded by what one export holds. Everything after that is DataFrame expressions.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions import text as X
from watchloom.functions.clock import micros, zoneless

# File names of an export, and schemas of its members.
TARGETS = ("watch-history.json", "search-history.json", "subscriptions.csv")
WATCH = "array<struct<title:string,titleUrl:string,time:string,subtitles:array<struct<name:string,url:string>>,details:array<struct<name:string>>>>"
SEARCH = "array<struct<title:string,time:string>>"
_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]"
ADS = "From Google Ads"


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), "content")


def members(found: DataFrame, targets: tuple[str, ...] = TARGETS, with_content: bool = True) -> DataFrame:
    """``archive, member, pos, filename, content, size_bytes, error``; a broken archive gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t.lower() for t in targets}
        for batch in batches:
            for archive, content in zip(*(batch.column(k) for k in (0, 1))):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for pos, info in enumerate(z.infolist()):
                            name = info.filename.rsplit("/", 1)[-1]
                            body = error = None
                            if with_content and name.lower() in wanted:
                                try:
                                    body = z.read(info)
                                except (RuntimeError, zipfile.BadZipFile, OSError, NotImplementedError) as e:
                                    error = type(e).__name__
                            rows.append((archive.as_py(), info.filename, pos, name, body, info.file_size, error))
                except zipfile.BadZipFile:
                    rows = [(archive.as_py(), None, None, None, None, None, "BadZipFile")]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string())
                names = ("archive", "member", "pos", "filename", "raw", "size_bytes", "error")
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=list(names))

    return found.mapInArrow(run, "archive string, member string, pos long, filename string, raw binary, size_bytes long, error string")


def locate(found: DataFrame, targets: tuple[str, ...] = TARGETS, match: str = "first") -> DataFrame:
    """For each archive and target the member: exact name and first match, or ``last_ci``: any case and last match; null if missing."""
    key = F.col("filename") if match == "first" else F.lower("filename")
    pick = F.min_by if match == "first" else F.max_by
    member = F.struct("member", "pos", "raw", "size_bytes", "error")
    best = [pick(member, F.when(key == t, F.col("pos"))).alias(f"m{k}") for k, t in enumerate(targets)]
    each = found.groupBy("archive").agg(F.count("member").alias("members"), *best)
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"m{k}").alias("m")) for k, t in enumerate(targets)])
    return each.select("archive", "members", F.inline(rows)).select("archive", "target", "members", "m.*", F.col("m").isNull().alias("missing"))


def decoded(raw: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), F.decode(raw, "ISO-8859-1"))


def extract(found: DataFrame, match: str = "first") -> DataFrame:
    """``archive, filename, content_type, content, size_bytes`` of the members that are there.

    With ``match="last_ci"`` a member must be UTF-8; one that is not is left out, the archive's others stay.
    """
    own = locate(found, match=match).filter(~F.col("missing") & F.col("raw").isNotNull())
    if match == "last_ci":
        own = own.filter(F.is_valid_utf8(F.col("raw").cast("string")))
    kind = F.when(F.col("target").endswith(".json"), "application/json").otherwise("text/csv")
    return own.select("archive", F.col("target").alias("filename"), kind.alias("content_type"), decoded(F.col("raw")).alias("content"), "size_bytes")


_QUOTED = r'"(?:[^"]++|"")*+"'


def csv_records(content: Column) -> Column:
    """Records of a CSV text as arrays of fields; quoted fields may hold commas, quotes and line ends. Blank lines are left out."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\x{FEFF}", "")
    records = F.regexp_extract_all(body, F.lit(rf'((?:[^"\r\n]++|{_QUOTED}|")++)'), 1)
    plain = lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    fields = lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(f",({_QUOTED}|[^,]*+)"), 1), plain)
    return F.transform(records, fields)


def _parsed(c: Column, pattern: str) -> Column:
    """Read as UTC, whatever the session's zone, which may lack an hour that UTC has."""
    return zoneless(F.unix_micros(F.try_to_timestamp(F.concat(c, F.lit("Z")), F.lit(pattern + "X"))))


def parse_time(c: Column) -> Column:
    return _parsed(F.regexp_replace(c, "Z$", ""), _TIME)


def lenient_time(c: Column) -> Column:
    """``parse_time``, and a date and time with a space between them."""
    return F.coalesce(parse_time(c), _parsed(c, "yyyy-MM-dd HH:mm:ss"))


def local_columns(df: DataFrame, zone: str = "tz") -> DataFrame:
    local = F.convert_timezone(F.lit("UTC"), F.col(zone), F.col("ts_utc"))
    return df.withColumn("ts_local", local).withColumns(
        {"date_local": F.to_date("ts_local"), "hour_local": F.hour("ts_local"), "day_of_week": F.weekday("ts_local"), "day_name": F.date_format("ts_local", "EEEE"), "month_local": F.month("ts_local")}
    )


def local_info(df: DataFrame, zone: str = "tz") -> DataFrame:
    """``local_columns`` and the same in words: ISO time with its offset, and the date."""
    out = local_columns(df, zone)
    minutes = ((micros(out, "ts_local") - micros(out, "ts_utc")) / 60_000_000).cast("int")
    part = lambda x: F.lpad(F.abs(x).cast("string"), 2, "0")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), part((minutes / 60).cast("int")), F.lit(":"), part(minutes % 60))
    fraction = F.when(F.date_format("ts_local", "SSSSSS") != "000000", F.date_format("ts_local", ".SSSSSS")).otherwise("")
    iso = F.concat(F.date_format("ts_local", "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset)
    return out.withColumns({"timestamp_local": iso, "date_text": F.date_format("ts_local", "yyyy-MM-dd")})


COLUMNS = ("user_id", "seq", "type", "engagement", "time_raw", "ts_utc", "text_raw", "text_clean", "language_type", "language_confidence", "channel", "channel_clean", "channel_url", "video_url", "video_id")
_ENTRY = "array<struct<title:string,video_url:string,time:string,channel:string,channel_url:string>>"


def _watched(content: Column) -> Column:
    """Entries of a watch history, of which adverts and posts are null."""
    ad = lambda e: F.coalesce(F.exists(e["details"], lambda d: d["name"] == ADS), F.lit(False))
    post = lambda e: F.coalesce(F.contains(e["titleUrl"], F.lit("/post/")), F.lit(False))
    first = lambda e: F.get(e["subtitles"], F.lit(0))
    return F.transform(F.from_json(content, WATCH), lambda e: F.when(~ad(e) & ~post(e), F.struct(e["title"], e["titleUrl"], e["time"], first(e)["name"], first(e)["url"])))


def _searched(content: Column) -> Column:
    empty = F.lit(None).cast("string")
    return F.transform(F.from_json(content, SEARCH), lambda e: F.struct(e["title"], empty, e["time"], empty, empty))


def _subscribed(content: Column) -> Column:
    """Records of a subscription list; the title, or the id where it is empty, is the channel."""
    empty = F.lit(None).cast("string")
    field = lambda records, r, name: F.get(r, F.array_position(F.get(records, F.lit(0)), F.lit(name)).cast("int") - 1)

    def entry(records: Column, r: Column) -> Column:
        return F.struct(empty, empty, empty, F.coalesce(F.nullif(field(records, r, "Channel Title"), F.lit("")), field(records, r, "Channel Id")), field(records, r, "Channel Url"))

    # a list of one, so that the records are parsed once and named
    return F.get(F.transform(F.array(csv_records(content)), lambda records: F.transform(F.slice(records, 2, 2**30), lambda r: entry(records, r))), F.lit(0))


def entries(files: DataFrame, *more: str) -> DataFrame:
    """Canonical rows of all members of ``files(user_id, filename, content)`` in one pass; columns named in ``more`` are carried along."""
    listed = F.ltrim("content").startswith("[")
    found = (
        F.when((F.col("filename") == TARGETS[0]) & listed, _watched(F.col("content")).cast(_ENTRY))
        .when((F.col("filename") == TARGETS[1]) & listed, _searched(F.col("content")).cast(_ENTRY))
        .when(F.col("filename") == TARGETS[2], _subscribed(F.col("content")).cast(_ENTRY))
    )
    kind = F.when(F.col("filename") == TARGETS[0], "watch").when(F.col("filename") == TARGETS[1], "search").otherwise("subscribe")
    each = files.select("user_id", *more, kind.alias("type"), F.posexplode(found).alias("seq", "e")).filter(F.col("e").isNotNull()).select("user_id", *more, "type", "seq", "e.*")
    watch, title = F.col("type") == "watch", F.col("title")
    rows = each.withColumns({
        "engagement": F.when(watch, X.engagement(title)), "time_raw": F.col("time"), "ts_utc": parse_time(F.col("time")), "text_raw": F.when(watch, X.raw_text(title, "watch")).when(F.col("type") == "search", X.raw_text(title, "search")),
        "text_clean": X.clean_text(title), "channel_clean": F.lower("channel"), "video_id": X.video_id(F.col("video_url")),
    })
    said = X.language(F.col("text_clean"))
    spoken = F.col("type") != "subscribe"
    rows = rows.withColumns({"language_type": F.when(spoken, said["type"]), "language_confidence": F.when(spoken, said["confidence"])})
    return rows.select(*COLUMNS, *more)


def watch_branch(files: DataFrame) -> DataFrame:
    return entries(files.filter(F.col("filename") == TARGETS[0]))


def search_branch(files: DataFrame) -> DataFrame:
    return entries(files.filter(F.col("filename") == TARGETS[1]))


def subscription_branch(files: DataFrame) -> DataFrame:
    return entries(files.filter(F.col("filename") == TARGETS[2]))


def events(files: DataFrame, zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical events of all users, and quarantined users with an unknown time zone.

    ``files`` has ``user_id, filename, content`` and, with ``zones(tz)`` given, ``tz``. The events read ``files`` once.
    """
    told = files if "tz" in files.columns else files.withColumn("tz", F.lit("UTC"))
    good = told.join(F.broadcast(zones), "tz", "left_semi") if zones is not None else told  # a list of all zones, about 600 rows
    bad = told.select("user_id", "tz").distinct()
    bad = bad.join(F.broadcast(zones), "tz", "left_anti") if zones is not None else bad.limit(0)
    return local_columns(entries(good, "tz")), bad


def report_events(found: DataFrame) -> DataFrame:
    """Canonical events as the reports take them: ``ts`` is the local time, or the instant where that is missing, and ``ts_utc`` the instant."""
    return found.select(F.coalesce("ts_local", "ts_utc").alias("ts"), *[c for c in found.columns if c not in ("ts", "ts_local")])


# The areas whose zones are in common use, and common names that a zone table does not list.
AREAS = ("Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Canada", "Europe", "Indian", "Pacific", "US")
COMMON = (
    "Canada/Atlantic", "Canada/Central", "Canada/Eastern", "Canada/Mountain", "Canada/Newfoundland", "Canada/Pacific", "GMT",
    "US/Alaska", "US/Arizona", "US/Central", "US/Eastern", "US/Hawaii", "US/Mountain", "US/Pacific", "UTC",
)


def time_zones(spark: SparkSession, common: bool = False, zone_table: str | None = None) -> DataFrame:
    """All zone names the session's Java knows, or the ``common`` ones; sorted, about 600 rows.

    Common are the places of ``zone_table``, the path of the time zone database's ``zone.tab``, with the names of ``COMMON``. Without the table
    they are all places in an area, which takes older spellings in too.
    """
    known = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    if common and zone_table:
        lines = spark.read.text(zone_table).filter(~F.col("value").startswith("#")).select(F.get(F.split("value", "\t"), F.lit(2)).alias("tz"))
        named = lines.filter(F.col("tz").isNotNull()).unionByName(spark.createDataFrame([(z,) for z in COMMON], "tz string"))
        return named.join(F.broadcast(spark.createDataFrame([(z,) for z in known], "tz string")), "tz", "left_semi").distinct().orderBy("tz")
    if common:
        known = [z for z in known if z in ("UTC", "GMT") or z.split("/")[0] in AREAS and "/" in z]
    return spark.createDataFrame([(z,) for z in known], "tz string")


def stats(df: DataFrame) -> DataFrame:
    kind = lambda t: F.count_if(F.col("type") == t).alias(f"total_{t}")
    langs = [F.count_if(F.col("language_type") == x).alias(x) for x in X.LANGUAGES]
    return df.groupBy("user_id").agg(kind("watch"), kind("search"), kind("subscribe"), F.count("*").alias("total_events"), *langs)


def preview(files: DataFrame, n: int = 50) -> DataFrame:
    """First entries of each member: ``archive, filename, total, has_more, headers, rows, error``.

    A JSON list has as many entries as it is long, an object is one entry, any other value has no total; rows of a CSV are JSON objects.
    """
    is_csv = F.col("content_type") == "text/csv"
    start = F.substring(F.ltrim("content"), 1, 1)
    valid = F.try_parse_json("content").isNotNull()
    json = F.when(valid & (start == "["), F.from_json("content", "array<string>")).when(valid & (start == "{"), F.array("content"))
    parsed = files.withColumn("_r", F.when(is_csv, csv_records(F.col("content")))).withColumn("headers", F.coalesce(F.get("_r", F.lit(0)), F.when(is_csv, F.array().cast("array<string>"))))
    named = F.transform(F.slice("_r", 2, n), lambda r: F.to_json(F.map_from_arrays("headers", F.transform("headers", lambda h, k: F.get(r, k)))))
    total = F.when(is_csv, F.greatest(F.size("_r") - 1, F.lit(0))).otherwise(F.size(json))
    error = F.when(~is_csv & ~valid, "Invalid JSON")
    rows = F.when(is_csv, named).otherwise(F.slice(json, 1, n))
    total = F.when(total >= 0, total)
    return parsed.select("archive", "filename", total.alias("total"), (F.coalesce(total, F.lit(0)) > n).alias("has_more"), "headers", rows.alias("rows"), error.alias("error"))
