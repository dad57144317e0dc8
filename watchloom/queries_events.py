"""Registered queries of the source, stream, join and store operators, with DuckDB equivalents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom import queries as base
from watchloom import sql
from watchloom.operators import activity, asof, cards, intervals, payloads, sessions, sketches, streaks
from watchloom.plans import cube
from watchloom.queries import _E, _ZONES, export_files
from watchloom.session import shared_dir, ship
from watchloom.sources import datasource, exports, store, versions
from watchloom.streaming import stateful, windows
from watchloom.streaming.sessions import stream_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


# Archives: written by the sink into the shared folder, read by the source, and reported on.


def _archived(s: SparkSession, d: str) -> str:
    """A folder with an archive per user: a page of no interest, the user's members, and an empty list under an upper-case name."""
    path = shared_dir(s)
    member = lambda name, body: F.array(F.struct(F.lit(name).alias("filename"), F.lit(body).alias("content")))
    own = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("x/"), "filename").alias("filename"), "content")))
    files = export_files(s, d).groupBy("user_id").agg(own.alias("own"))
    named = files.select(F.concat(F.col("user_id").cast("string"), F.lit(".zip")).alias("archive"), F.concat(member("archive_browser.html", ""), "own", member("y/WATCH-HISTORY.JSON", "[]")).alias("files"))
    datasource.register(s)
    named.write.format(datasource.FORMAT).mode("append").option("path", path).save()
    return path


def _digest(files: DataFrame) -> DataFrame:
    return files.select(F.concat("user_id", F.lit(".zip")).alias("archive"), "filename", "content_type", "size_bytes", F.md5("content").alias("content_md5"))


def _source(match: str):
    return lambda s, d: _digest(datasource.files(s.read.format(datasource.FORMAT).option("match", match).option("path", _archived(s, d)).load(), match=match))


_add("export_source", _source("first"), base.ORACLES["export_extract"])
_add("export_source_last", _source("last_ci"), base.ORACLES["export_extract_last"])


def _pushed(s: SparkSession, d: str) -> DataFrame:
    """Who has a subscription list, by a filter that reaches the reader."""
    found = s.read.format(datasource.FORMAT).option("path", _archived(s, d)).load().filter(F.col("filename") == exports.TARGETS[2])
    return found.select(F.regexp_extract("archive", r"([^/]*)$", 1).alias("archive"), "member", "members", "missing")


_add("export_pushdown", _pushed, f"""WITH {base._X}, m AS (SELECT user_id, count(*) + 2 AS members FROM f GROUP BY 1) SELECT m.user_id || '.zip' AS archive, 'x/' || f.filename AS member, members, f.filename IS NULL AS missing
FROM m LEFT JOIN f ON f.user_id = m.user_id AND f.filename = 'subscriptions.csv'""")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Members from the archives as a stream, kept by a file sink."""
    out, path = shared_dir(s), _archived(s, d)
    stream = _digest(datasource.files(s.readStream.format(datasource.FORMAT).option("path", path).load()))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_dir(s)).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


_add("export_source_stream", _streamed, base.ORACLES["export_extract"])


def _reported(s: SparkSession, d: str) -> DataFrame:
    """Events as the reports take them, straight from the archives; users with an unknown zone are in quarantine."""
    files = datasource.files(s.read.format(datasource.FORMAT).option("path", _archived(s, d)).load())
    files = files.withColumn("user_id", F.col("user_id").cast("long")).withColumn("tz", F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.col("user_id") % 4 + 1).cast("int")))
    return exports.report_events(exports.events(files, exports.time_zones(s))[0])


def _from_archives(f, watch: bool = True):
    return lambda s, d: f(activity.watches(_reported(s, d)) if watch else _reported(s, d))


_LW = f"{base._X}, {base._CANON}, lw AS (SELECT *, ts_local AS ts, hour(ts_local) AS h FROM l WHERE type = 'watch')"
_add("archive_summary", _from_archives(activity.summary, False), f"""WITH {_LW} SELECT user_id, count(*) FILTER (type = 'watch') AS watches, count(*) FILTER (type = 'search') AS searches, count(*) FILTER (type = 'subscribe') AS subscriptions, count(*) AS events,
 count(DISTINCT lower(channel)) FILTER (type = 'watch') AS channels, min(ts_local) AS first_ts, max(ts_local) AS last_ts, count(*) FILTER (language_type = 'english') AS english, 0::BIGINT AS hindi, 0::BIGINT AS hinglish, 0::BIGINT AS unknown FROM l GROUP BY user_id""")


def _gaps(source: str, gap: int, utc: str = "ts_utc") -> str:
    """Sessions of ``source(user_id, seq, ts, utc)``: gaps by instants, times by the wall clock."""
    return f"""sa AS (SELECT *, CASE WHEN {utc} - lag({utc}) OVER (PARTITION BY user_id ORDER BY {utc}, seq) > INTERVAL {gap} MINUTE THEN 1 ELSE 0 END AS new FROM {source}),
sb AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY {utc}, seq ROWS UNBOUNDED PRECEDING) AS session FROM sa),
ss AS (SELECT user_id, session::BIGINT AS session, arg_min(ts, ({utc}, ts)) AS start_ts, arg_max(ts, ({utc}, ts)) AS end_ts, count(*) AS events, epoch_us(max({utc})) - epoch_us(min({utc})) AS us, us / 1000000 / 60 + 5 AS minutes FROM sb GROUP BY ALL)"""


_TIMES = """SELECT user_id, sessions, minutes, minutes / 60 AS hours, minutes / sessions AS mean_minutes, longest_minutes, days, minutes / days AS minutes_per_day FROM
 (SELECT user_id, count(*) AS sessions, sum(us)::BIGINT / 1000000 / 60 + 5 * count(*) AS minutes, max(minutes) AS longest_minutes FROM ss GROUP BY 1) JOIN (SELECT user_id, count(DISTINCT ts::DATE) AS days FROM {0} GROUP BY 1) USING (user_id)"""
_STATS = "SELECT user_id, watches, channels, days, sessions FROM (SELECT user_id, count(*) AS watches, count(DISTINCT {1}) AS channels, count(DISTINCT ts::DATE) AS days FROM {0} GROUP BY 1) JOIN (SELECT user_id, count(*) AS sessions FROM ss GROUP BY 1) USING (user_id)"
_FIRST = """SELECT user_id, arg_min({1}, ({2}, seq)) AS first_title, arg_min(ts, ({2}, seq)) AS first_ts, arg_max({1}, ({2}, seq)) AS last_title, arg_max(ts, ({2}, seq)) AS last_ts,
 strftime(arg_min(ts, ({2}, seq)), '%B %d, %Y') AS first_date, strftime(arg_max(ts, ({2}, seq)), '%B %d, %Y') AS last_date FROM {0} GROUP BY user_id"""
_add("archive_sessions", _from_archives(sessions.sessionise), f"WITH {_LW}, {_gaps('lw', 60)} SELECT * EXCLUDE (us) FROM ss")
_add("archive_time_spent", _from_archives(sessions.time_spent), f"WITH {_LW}, {_gaps('lw', 60)} {_TIMES.format('lw')}")
_add("archive_card_stats", _from_archives(cards.stats_overview), f"WITH {_LW}, {_gaps('lw', 60)} {_STATS.format('lw', 'lower(channel)')}")
_add("archive_card_first_last", _from_archives(cards.first_and_last), f"WITH {_LW} {_FIRST.format('lw', 'text_clean', 'ts_utc')}")

# Two clocks: events moved to the weeks in which clocks change, each user in one of four zones.

_PLACES = ("UTC", "Asia/Kolkata", "America/New_York", "Europe/Paris")


def _zoned(s: SparkSession, d: str) -> DataFrame:
    zone = F.element_at(F.array(*[F.lit(z) for z in _PLACES]), (F.col("user_id") % 4 + 1).cast("int"))
    moved = base.history(s, d).withColumn("ts_utc", F.col("ts") + F.expr("interval 293 days"))
    return activity.watches(moved.withColumn("ts", F.convert_timezone(F.lit("UTC"), zone, F.col("ts_utc"))))


_ZW = f"""{_E}, zu AS (SELECT user_id, seq, channel, channel_clean, ts + INTERVAL 293 DAY AS utc FROM w),
zw AS (SELECT *, hour(ts) AS h FROM (SELECT *, utc + to_minutes(CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 330 WHEN 2 THEN CASE WHEN utc < TIMESTAMP '2024-11-03 06:00:00' THEN -240 ELSE -300 END ELSE CASE WHEN utc < TIMESTAMP '2024-10-27 01:00:00' THEN 120 ELSE 60 END END) AS ts FROM zu))"""


def _by_zone(f):
    return lambda s, d: f(_zoned(s, d))


_add("zone_sessions", _by_zone(lambda w: sessions.sessionise(w, 360)), f"WITH {_ZW}, {_gaps('zw', 360, 'utc')} SELECT * EXCLUDE (us) FROM ss")
_add("zone_time_spent", _by_zone(lambda w: sessions.time_spent(w, 360)), f"WITH {_ZW}, {_gaps('zw', 360, 'utc')} {_TIMES.format('zw')}")
_add("zone_card_stats", _by_zone(cards.stats_overview), f"WITH {_ZW}, {_gaps('zw', 60, 'utc')} {_STATS.format('zw', 'channel_clean')}")
_add("zone_card_time", _by_zone(cards.time_spent_card), f"WITH {_ZW}, {_gaps('zw', 60, 'utc')}, t AS ({_TIMES.format('zw')}) SELECT user_id, round_even(hours, 1) AS hours, round_even(minutes, 0) AS minutes, round_even(minutes_per_day, 1) AS daily_minutes FROM t")
_add("zone_card_first_last", _by_zone(cards.first_and_last), f"WITH {_ZW} {_FIRST.format('zw', 'channel_clean', 'utc')}")
_add("zone_card_late_night", _by_zone(cards.late_night), f"WITH {_ZW}, t AS (SELECT user_id, count(*) AS n, arg_max(ts, (h, utc)) AS t FROM zw WHERE h < 5 GROUP BY 1) SELECT user_id, n, t AS latest_ts, strftime(t, '%-I:%M %p') AS latest, strftime(t, '%B %d') AS latest_date FROM t")
_add("zone_card_habits", _by_zone(lambda w: cards.habit_channels(w, 2, 7, 14)), f"""WITH {_ZW}, g AS (SELECT *, (epoch_us(utc) - lag(epoch_us(utc)) OVER (PARTITION BY user_id, channel_clean ORDER BY utc, seq)) // 86400000000 AS gap FROM zw),
c AS (SELECT user_id, channel_clean, count(*) AS n, arg_min(channel, seq) AS name, (epoch_us(max(utc)) - epoch_us(min(utc))) // 86400000000 AS span, avg(gap) AS mean_gap, min(seq) AS s FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean_gap - 0.1::DOUBLE * n, s) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM c WHERE n >= 2 AND span >= 7 AND mean_gap <= 14)
SELECT user_id, rank::INTEGER AS rank, name, n, span, mean_gap, total FROM k WHERE rank <= 5""")


# Streams: the events as a stream that is run to its end; what is closed by then is in the sink.


def _stream(s: SparkSession, d: str) -> DataFrame:
    return activity.watches(base.canonical(stream_table(ship(s), f"{d}/events.parquet")))


def _sunk(stream: DataFrame) -> DataFrame:
    s, path = stream.sparkSession, shared_dir(stream.sparkSession)
    stateful.append_to(stream, path)
    return stateful.appended(s, path, stream.schema)


_add("stream_closed_sessions", lambda s, d: _sunk(stateful.closing_sessions(_stream(s, d))), f"""WITH {base._sess(60)}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM w)
SELECT user_id, start_ts, end_ts, events FROM ss, m WHERE end_ts + INTERVAL 60 MINUTE < date_trunc('millisecond', mark)""")


def _all_sessions(s: SparkSession, d: str) -> DataFrame:
    """Closed sessions from the sink and open ones from the state: together all there are."""
    stream, path, state = stateful.closing_sessions(_stream(s, d)), shared_dir(s), shared_dir(s)
    stateful.append_to(stream, path, state)
    return stateful.appended(s, path, stream.schema).unionByName(stateful.open_sessions(s, state))


_add("stream_all_sessions", _all_sessions, base.ORACLES["session_stream"])


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    """A channel table: nations' suppliers by number, of which events know the first hundred."""
    return base._read(s, d, "supplier").join(F.broadcast(base._read(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("channel "), F.col("s_suppkey").cast("string")).alias("channel_clean"), F.col("n_name").alias("nation"))


def _windows(size: str, slide: str | None = None, by: tuple[str, ...] = ()):
    def run(s: SparkSession, d: str) -> DataFrame:
        twice = _stream(s, d).unionByName(_stream(s, d))  # each row comes twice
        report = windows.window_report(twice, _suppliers(s, d) if by else None, size, slide, by=by)
        return _sunk(report).drop("users")

    return run


_MARK = "m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM w)"
_add("stream_windows", _windows("1 day", by=("nation",)), f"""WITH {_E}, {_MARK}, c AS (SELECT 'channel ' || s_suppkey AS channel_clean, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT d::TIMESTAMP AS window_start, d::TIMESTAMP + INTERVAL 1 DAY AS window_end, nation, count(*) AS watches, count(*) FILTER (engagement = 'active') AS active FROM w LEFT JOIN c USING (channel_clean), m WHERE d::TIMESTAMP + INTERVAL 1 DAY <= mark GROUP BY ALL""")
_add("stream_sliding_windows", _windows("6 hours", "2 hours"), f"""WITH {_E}, {_MARK}, x AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(2 * k) AS window_start, engagement FROM w, range(3) AS r(k))
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS watches, count(*) FILTER (engagement = 'active') AS active FROM x, m WHERE window_start + INTERVAL 6 HOUR <= mark GROUP BY ALL""")

# As-of and interval joins.


def _asof(slices: str | None, tolerance: float | None = None):
    """Lines as rows by customer and date of shipment, the customer's orders as versions."""

    def run(s: SparkSession, d: str) -> DataFrame:
        o, line = base._read(s, d, "orders"), base._read(s, d, "lineitem")
        rows = o.select("o_orderkey", F.col("o_custkey").alias("customer")).join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("customer", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"))
        versions = o.select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("timestamp_ntz").alias("ordered"), "o_orderkey", "o_totalprice")
        return asof.asof_join(rows, asof.latest(versions, ["customer"], "ordered", "o_orderkey"), ["customer"], "shipped", "ordered", tolerance, slices)

    return run


_ASOF = """WITH r AS (SELECT o_custkey AS customer, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::TIMESTAMP AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
v AS (SELECT o_custkey AS customer, o_orderdate::TIMESTAMP AS ordered, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2)
SELECT r.*, {0} FROM r ASOF LEFT JOIN v ON r.customer = v.customer AND r.shipped >= v.ordered"""
_add("asof_orders", _asof(None), _ASOF.format("v.ordered, v.o_orderkey, v.o_totalprice"))
_add("asof_orders_sliced", _asof("90 days"), ORACLES["asof_orders"])
_add("asof_orders_recent", _asof("30 days", 40 * 86_400), _ASOF.format(", ".join(f"CASE WHEN r.shipped - v.ordered <= INTERVAL 40 DAY THEN v.{c} END AS {c}" for c in ("ordered", "o_orderkey", "o_totalprice"))))


def _sittings(s: SparkSession, d: str) -> DataFrame:
    """Sessions of at most six-hour gaps with their users' group of ten neighbours."""
    return sessions.sessionise(activity.watches(base.history(s, d)), 360).withColumn("circle", F.expr("user_id div 10"))


def _together(s: SparkSession, d: str) -> DataFrame:
    """Sessions of two users of a circle that overlap."""
    own = _sittings(s, d).select("circle", "user_id", "session", "start_ts", "end_ts")
    pairs = intervals.overlap_join(own, own, ["circle"], ("start_ts", "end_ts"), ("start_ts", "end_ts")).filter("a.user_id < b.user_id")
    return pairs.select("a.circle", F.col("a.user_id").alias("user_a"), F.col("a.session").alias("session_a"), F.col("b.user_id").alias("user_b"), F.col("b.session").alias("session_b"))


_SAT = f"{base._sess(360)}, si AS (SELECT user_id // 10 AS circle, * FROM ss)"
_add("overlapping_sessions", _together, f"""WITH {_SAT} SELECT a.circle, a.user_id AS user_a, a.session AS session_a, b.user_id AS user_b, b.session AS session_b FROM si a JOIN si b
 ON a.circle = b.circle AND a.user_id < b.user_id AND a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts""")


def _open_at_once(keys: tuple[str, ...]) -> str:
    k, on = "".join(f"{x}, " for x in keys), f"PARTITION BY {', '.join(keys)}" if keys else ""
    sl = ", ".join([*keys, "slice"])
    return f"""WITH {_SAT}, st AS (SELECT {k}tick, sum(x) AS x FROM (SELECT {k}epoch_us(start_ts) AS tick, 1 AS x FROM si UNION ALL SELECT {k}epoch_us(end_ts) + 1, -1 FROM si) GROUP BY ALL),
sw AS (SELECT *, tick // 3600000000 AS slice, sum(x) OVER ({on} ORDER BY tick ROWS UNBOUNDED PRECEDING) AS n FROM st),
tp AS (SELECT {sl}, max(n) AS top, min(tick) FILTER (n = m) AS top_at, arg_min(n - x, tick) AS open FROM (SELECT *, max(n) OVER (PARTITION BY {sl}) AS m FROM sw) GROUP BY {sl})
SELECT {k}make_timestamp(slice * 3600000000) AS slice_start, greatest(top, open)::BIGINT AS peak, make_timestamp(CASE WHEN open >= top THEN slice * 3600000000 ELSE top_at END) AS peak_ts FROM tp"""


_add("open_sessions", lambda s, d: intervals.concurrency(_sittings(s, d), "start_ts", "end_ts"), _open_at_once(()))
_add("open_sessions_by_circle", lambda s, d: intervals.concurrency(_sittings(s, d), "start_ts", "end_ts", ["circle"]), _open_at_once(("circle",)))

# Cube and sketches.

_SETS = ", ".join(f"({', '.join(axes)})" for axes in cube.LEVELS.values())
_NAMES = " ".join(f"WHEN {cube.level_id(x)} THEN '{x}'" for x in cube.LEVELS)
_CUBE = f"""WITH {_E}, c AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, dow AS weekday, h AS hour, engagement, seq FROM w)
SELECT CASE GROUPING(user_id, month, weekday, hour, engagement) {_NAMES} END AS level, user_id, month, weekday::INTEGER AS weekday, hour::INTEGER AS hour, engagement, count(*) AS n, min(seq) AS first_seq FROM c GROUP BY GROUPING SETS ({_SETS})"""
_add("activity_cube", base._watch(cube.activity_cube), _CUBE)


def _from_cube(axis: str, size: int) -> str:
    return f"WITH q AS ({_CUBE}), u AS (SELECT user_id, max(n) AS top FROM q WHERE level = 'user_{axis}' GROUP BY 1) SELECT u.user_id, k::INTEGER AS {axis}, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / top AS share FROM u CROSS JOIN range({size}) AS r(k) LEFT JOIN q ON q.level = 'user_{axis}' AND q.user_id = u.user_id AND q.{axis} = k"


_add("cube_hours", base._watch(lambda w: cube.filled(cube.activity_cube(w), "hour", 24)), _from_cube("hour", 24))
_add("cube_weekdays", base._watch(lambda w: cube.filled(cube.activity_cube(w), "weekday", 7)), _from_cube("weekday", 7))


def _kept_sketches(s: SparkSession, d: str) -> DataFrame:
    """Sketches of the days, written to an event store and read from it."""
    path = shared_dir(s)
    store.write_events(sketches.daily_sketches(activity.watches(base.history(s, d))), path)
    return store.read_events(s, path)


_SPAN = (dt.date(2024, 1, 5), dt.date(2024, 1, 20))


def _bounds(s: SparkSession, d: str) -> DataFrame:
    found = sketches.estimates(sketches.merged(_kept_sketches(s, d), *_SPAN))
    return sketches.within_bounds(found, sketches.exact(activity.watches(base.history(s, d)), *_SPAN))


_add("sketch_bounds", _bounds, f"WITH {_E} SELECT DISTINCT user_id, true AS n_ok, true AS channels_ok, true AS quantiles_ok, true AS top_ok FROM w WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
_add("sketch_exact", base._watch(lambda w: sketches.exact(w, *_SPAN).select("user_id", "n", "days", "channels", F.element_at("values", F.ceil(F.col("n") / 2).cast("int")).alias("median"), F.element_at("top", -1).alias("most"))), f"""WITH {_E}, r AS (SELECT * FROM w WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'), c AS (SELECT user_id, max(n) AS most FROM (SELECT user_id, channel_clean, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1)
SELECT user_id, count(*) AS n, count(DISTINCT d) AS days, count(DISTINCT channel_clean) AS channels, (list_sort(list(h * 60 + minute(ts)))[ceil(count(*) / 2)::INTEGER])::BIGINT AS median, any_value(most) AS most FROM r JOIN c USING (user_id) GROUP BY user_id""")


_add("inactive_periods_all", base._watch(lambda w: streaks.inactive_periods(streaks.daily(w))), base.ORACLES["inactive_periods"].replace("engagement = 'active')", "type = 'watch')"))

# Versioned tables: each query makes several versions and reads one or more of them.


def _suppliers_table(s: SparkSession, d: str) -> versions.VersionedTable:
    table = versions.VersionedTable(s, shared_dir(s), "s_suppkey", 16)
    table.append(base._read(s, d, "supplier").select("s_suppkey", "s_name", F.lit(1).cast("long").alias("fetched")))
    return table


def _version_rows(table: versions.VersionedTable) -> DataFrame:
    """Rows of all versions there are."""
    out = None
    for v in table.versions():
        rows = table.read(v).withColumn("version", F.lit(v))
        out = rows if out is None else out.unionByName(rows)
    return out


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Suppliers; then those with returns get the day of the last one as a name, and numbers past the last supplier are new."""
    table = _suppliers_table(s, d)
    line, most = base._read(s, d, "lineitem"), base._read(s, d, "supplier").count()
    seen = line.filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.concat(F.lit("returned "), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd")).alias("s_name"))
    added = seen.withColumn("s_suppkey", F.col("s_suppkey") + most)
    table.merge(seen.unionByName(added), count="fetched")
    return _version_rows(table)


_add("version_merge", _merged, """WITH n AS (SELECT l_suppkey AS k, 'returned ' || strftime(max(l_shipdate), '%Y-%m-%d') AS name FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT count(*) AS c FROM supplier)
SELECT 1 AS version, s_suppkey, s_name, 1::BIGINT AS fetched FROM supplier UNION ALL SELECT 2, s_suppkey, coalesce(name, s_name), CASE WHEN name IS NULL THEN 1 ELSE 2 END FROM supplier LEFT JOIN n ON k = s_suppkey UNION ALL SELECT 2, k + c, name, 1 FROM n, c""")


def _removed(s: SparkSession, d: str) -> DataFrame:
    """Suppliers, without those of the first nations, and with the first ones back again under another name."""
    table = _suppliers_table(s, d)
    gone = base._read(s, d, "supplier").filter("s_nationkey < 5").select("s_suppkey")
    table.delete(gone)
    table.append(gone.select("s_suppkey", F.lit("again").alias("s_name"), F.lit(0).cast("long").alias("fetched")))
    return _version_rows(table)


_add("version_delete", _removed, """SELECT 1 AS version, s_suppkey, s_name, 1::BIGINT AS fetched FROM supplier UNION ALL SELECT v, s_suppkey, s_name, 1 FROM supplier, (VALUES (2), (3)) AS x(v) WHERE s_nationkey >= 5
 UNION ALL SELECT 3, s_suppkey, 'again', 0 FROM supplier WHERE s_nationkey < 5""")


def _aged(s: SparkSession, d: str) -> DataFrame:
    """Raw members as they are after expiry, and as an older version still has them."""
    table = versions.VersionedTable(s, shared_dir(s), "token")
    made = base._read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("created_at"))
    table.append(export_files(s, d).join(made, "user_id").select(F.col("user_id").alias("token"), "filename", "content", "created_at"))
    table.expire(base._read(s, d, "events").agg(F.max("ts")).first()[0], 6)
    return _version_rows(table).select("version", "token", "filename", F.md5("content").alias("content_md5"))


_add("version_expire", _aged, f"""WITH {base._X}, k AS (SELECT user_id, max(ts) AS m FROM events GROUP BY 1), y AS (SELECT user_id AS token, filename, md5(content) AS content_md5, m FROM f JOIN k USING (user_id))
SELECT 1 AS version, token, filename, content_md5 FROM y UNION ALL SELECT 2, token, filename, content_md5 FROM y WHERE m >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")

# Reports in SQL text.


def _asked(text: str):
    return lambda s, d: sql.install(s, base.history(s, d)).sql(text)


_WATCHES = "SELECT user_id, ts, seq FROM watch_events WHERE type = 'watch'"
_add("sql_sessions", _asked(f"SELECT * FROM watch_sessions(TABLE({_WATCHES}), 360)"), base.ORACLES["sessions_6h"])
_add("sql_streaks", _asked(f"SELECT * FROM day_streaks(TABLE(SELECT user_id, date(ts) AS date FROM ({_WATCHES})), least => 4)"), f"""WITH {_E}, c AS (SELECT DISTINCT user_id, d FROM w), i AS (SELECT *, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INTEGER AS g FROM c)
SELECT user_id, min(d) AS start, max(d) AS "end", count(*) AS days FROM i GROUP BY user_id, g HAVING count(*) >= 4""")
_add("sql_hours", _asked("SELECT * FROM hour_report()"), f"WITH {_E}, c AS (SELECT user_id, h AS hour, count(*) AS n FROM w GROUP BY ALL) SELECT user_id, hour::INTEGER AS hour, n, n * 100 / sum(n) OVER (PARTITION BY user_id) AS percent FROM c")
_add("sql_top_channels", _asked("SELECT * FROM top_channels_report(3)"), f"WITH {_E}, c AS (SELECT user_id, channel_clean AS channel, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL) SELECT user_id, r::INTEGER AS rank, channel, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS r FROM c) WHERE r <= 3")
_add("sql_buckets", _asked("SELECT * FROM bucket_report()"), f"WITH {_E}, c AS (SELECT user_id, channel_clean, count(*) AS n FROM w GROUP BY ALL) SELECT user_id, {base._BUCKET} AS bucket, count(*) AS channels, sum(n)::BIGINT AS videos FROM c GROUP BY ALL")

# Variants.


def _page_fields(s: SparkSession, d: str) -> DataFrame:
    p = payloads.page_fields(base.player_pages(s, d))
    return p.select("page_id", "category", "title", "channel_name", F.md5("description").alias("description_md5"), F.array_join("keywords", "|").alias("keywords"))


_add("variant_metadata", _page_fields, base.ORACLES["page_metadata"])


def _props(s: SparkSession, d: str) -> DataFrame:
    """Properties of events by type; those of errors are cut short and so malformed."""
    e = base._read(s, d, "events")
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    told = payloads.typed(payloads.parsed(e, cut), {"k": ("$.k", "int"), "word": ("$.k", "array<string>"), "other": ("$.x.y", "string")})
    return told.groupBy("event_type", "fault").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count("word").alias("words"), F.count("other").alias("others"))


_add("variant_props", _props, """SELECT event_type, CASE WHEN event_type = 'error' THEN 'malformed' END AS fault, count(*) AS n, (sum((props->>'$.k')::INTEGER) FILTER (event_type <> 'error'))::BIGINT AS k, 0::BIGINT AS words, 0::BIGINT AS others FROM events GROUP BY 1""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
