"""Registered queries of the history operators, bound to the driver's tables, with DuckDB equivalents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions import text as X
from watchloom.operators import activity, cards, overlap, sessions, streaks, topics
from watchloom.plans import reports
from watchloom.session import shared_dir, ship
from watchloom.sources import exports, store
from watchloom.streaming.sessions import drain, session_stream, stream_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(_read(spark, sf_dir, "events"))


def canonical(e: DataFrame) -> DataFrame:
    """Canonical events of a table or stream: views and clicks are watches, purchases searches, signups subscriptions; errors are dropped."""
    kind = F.when(F.col("event_type").isin("view", "click"), "watch").when(F.col("event_type") == "purchase", "search").when(F.col("event_type") == "signup", "subscribe")
    e = e.filter(F.col("event_type") != "error")
    k = F.get_json_object("props", "$.k")
    name = F.concat(F.lit("Channel "), k)
    return e.select("user_id", F.col("event_id").alias("seq"), kind.alias("type"), F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "passive").alias("engagement"), "ts", name.alias("channel"), F.lower(name).alias("channel_clean"), name.alias("text_raw"), F.lower(name).alias("text_clean"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``history`` with the language of the document that has the event's number, as the text of watches and searches."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), X.language(F.col("text"))["type"].alias("_l"))
    own = F.when(F.col("type") != "subscribe", F.coalesce("_l", F.lit("unknown")))
    return history(spark, sf_dir).join(docs, "seq", "left").withColumn("language_type", own).drop("_l")


def homes(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """``history`` of groups of ``size`` neighbouring users, so that a group's days are fuller."""
    return history(spark, sf_dir).withColumn("user_id", F.expr(f"user_id div {size}"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as watches: customer, order date, supplier as channel, part as video."""
    o, line = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    rows = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    # lines of an order may share a number, so part and supplier make the order of rows a total one
    seq = ((F.col("o_orderkey") * 16 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    ch = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    video = F.concat(F.lit("part number "), F.col("l_partkey").cast("string"))
    return rows.select(F.col("o_custkey").alias("user_id"), seq.alias("seq"), F.lit("watch").alias("type"), F.lit("active").alias("engagement"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), ch.alias("channel"), F.lower(ch).alias("channel_clean"), video.alias("text_raw"), video.alias("text_clean"))


_E = """e AS (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'watch' WHEN event_type = 'purchase' THEN 'search' ELSE 'subscribe' END AS type,
  CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'passive' END AS engagement, ts, 'Channel ' || json_extract_string(props, '$.k') AS channel,
  'channel ' || json_extract_string(props, '$.k') AS channel_clean FROM events WHERE event_type <> 'error'), w AS (SELECT *, isodow(ts) - 1 AS dow, hour(ts) AS h, ts::DATE AS d FROM e WHERE type = 'watch')"""
_P = """w AS (SELECT o_custkey AS user_id, ((o_orderkey * 16 + l_linenumber)::BIGINT * 100000 + l_partkey) * 10000 + l_suppkey AS seq, o_orderdate AS ts, o_orderdate::DATE AS d, isodow(o_orderdate) - 1 AS dow, hour(o_orderdate) AS h,
  'Supplier ' || l_suppkey AS channel, 'supplier ' || l_suppkey AS channel_clean, 'part number ' || l_partkey AS title FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_LANG = r"""lang AS (WITH t AS (SELECT doc_id, text, coalesce(regexp_matches(text, '[\x{0900}-\x{097F}]'), false) AS d, coalesce(regexp_matches(text, '[a-zA-Z]'), false) AS l,
  list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT *, len(list_filter(w, lambda x: list_contains(string_split('aur ya lekin par toh bhi hi na nahi nhi hai ho hoga hogi tha thi the hain kya kaise kyun kyu kyunki karo karna krna samjhao batao dekho suno jao aao chalo ka ki ke mein me se tak wala wali wale ko pe pr kab kaha kaun kitna sach jhooth accha theek ghar dost bhai yaar paisa paise kaam log rishta pyaar zindagi dil duniya', ' '), x)))::INTEGER AS markers,
  len(list_filter(w, lambda x: list_contains(string_split('me the hi par ko', ' '), x))) AS weak, len(w)::INTEGER AS words FROM t),
k AS (SELECT *, CASE WHEN text IS NULL OR length(trim(text)) < 3 THEN 0 WHEN NOT d AND NOT l THEN 1 WHEN d AND NOT l THEN 2 WHEN d THEN 3 WHEN words = 0 THEN 0 WHEN markers >= 2 THEN 3 WHEN markers = 1 AND weak = 0 THEN 4 ELSE 1 END AS k FROM c)
SELECT doc_id, ['unknown', 'english', 'hindi', 'hinglish', 'hinglish'][k + 1] AS type, ['low', 'high', 'high', 'high', 'medium'][k + 1] AS confidence, d AS devanagari, l AS latin, markers, words FROM k)"""
_SAID = f"{_LANG}, le AS (SELECT e.*, CASE WHEN e.type <> 'subscribe' THEN coalesce(lang.type, 'unknown') END AS language_type FROM e LEFT JOIN lang ON doc_id = seq)"
_LANGUAGES = ", ".join(f"count(*) FILTER (language_type = '{x}') AS {x}" for x in ("english", "hindi", "hinglish", "unknown"))
_DAYNAME = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][{} + 1]"
_AMPM = "(({0} + 11) % 12 + 1) || CASE WHEN {0} < 12 THEN ' AM' ELSE ' PM' END"


def _home(size: int) -> str:
    return _E.replace("SELECT user_id,", f"SELECT user_id // {size} AS user_id,", 1)


_DAYS = """dh AS (SELECT user_id, d, h, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL),
days AS (SELECT user_id, d AS date, sum(n)::BIGINT AS total, sum(CASE WHEN h < 5 THEN n ELSE 0 END)::BIGINT AS late, (arg_max(h, row(n, -s)))::INTEGER AS peak_hour FROM dh GROUP BY ALL)"""
_BUCKET = "CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '100+' END"
_NAMES = "(SELECT unnest(['1', '2-5', '6-10', '11-20', '21-50', '51-100', '100+']) AS bucket)"


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _events(f):
    return lambda s, d: f(history(s, d))


def _watch(f, *, passive: bool = True):
    return lambda s, d: f(activity.watches(history(s, d), None if passive else "active"))


def _homes(f, size: int):
    return lambda s, d: f(activity.watches(homes(s, d, size)))


def _orders(f):
    return lambda s, d: f(purchases(s, d))


_add("summary", lambda s, d: activity.summary(described(s, d)), f"""WITH {_E}, {_SAID} SELECT user_id, count(*) FILTER (type = 'watch') AS watches, count(*) FILTER (type = 'search') AS searches,
 count(*) FILTER (type = 'subscribe') AS subscriptions, count(*) AS events, count(DISTINCT channel_clean) FILTER (type = 'watch') AS channels, min(ts) AS first_ts, max(ts) AS last_ts, {_LANGUAGES} FROM le GROUP BY user_id""")


def _top(where: str, n: int) -> str:
    return f"""WITH {_E}, c AS (SELECT user_id, channel_clean, count(*) AS n, min(seq) AS s FROM w WHERE {where} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS rank, sum(n) OVER (PARTITION BY user_id) AS total FROM c),
t AS (SELECT *, total - sum(n) OVER (PARTITION BY user_id) AS other FROM r WHERE rank <= {n}),
names AS (SELECT user_id, channel_clean, arg_min(channel, seq) AS name FROM w GROUP BY ALL)
SELECT user_id, rank::INTEGER AS rank, channel_clean, name, n, n * 100 / total AS percent, other::BIGINT AS other FROM t JOIN names USING (user_id, channel_clean)"""


_add("top_channels", _watch(lambda w: activity.top_values(w, "channel_clean", "channel")), _top("true", 20))
_add("top_channels_active", lambda s, d: activity.top_values(activity.watches(history(s, d), "active"), "channel_clean", "channel", activity.watches(history(s, d))), _top("engagement = 'active'", 20))
_C = "c AS (SELECT user_id, channel_clean, count(*) AS n FROM w GROUP BY ALL)"
_add("view_count_buckets", _orders(activity.view_count_buckets), f"""WITH {_P}, {_C}, b AS (SELECT user_id, {_BUCKET} AS bucket, count(*) AS channels, sum(n)::BIGINT AS videos FROM c GROUP BY ALL)
SELECT u.user_id, x.bucket, coalesce(channels, 0) AS channels, coalesce(videos, 0) AS videos FROM (SELECT DISTINCT user_id FROM w) u CROSS JOIN {_NAMES} x LEFT JOIN b ON b.user_id = u.user_id AND b.bucket = x.bucket""")
_add("distribution_stats", _watch(activity.distribution_stats), f"""WITH {_E}, {_C} SELECT user_id, count(*) AS channels, sum(n)::BIGINT AS videos, count(*) FILTER (n = 1) AS single, count(*) FILTER (n = 1) * 100 / count(*) AS single_percent FROM c GROUP BY user_id""")
_add("engagement_summary", _events(activity.engagement_summary), f"""WITH {_E} SELECT user_id, count(*) FILTER (engagement = 'active') AS active, count(*) FILTER (engagement = 'passive') AS passive, count(*) FILTER (type = 'watch') AS watches FROM e GROUP BY user_id""")


def _hist(column: str, name: str, size: int, label: str) -> str:
    return f"""WITH {_E}, c AS (SELECT user_id, {column} AS k, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT u.user_id, x.k, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM w) u CROSS JOIN (SELECT unnest(range(0, {size})) AS k) x LEFT JOIN c ON c.user_id = u.user_id AND c.k = x.k)
SELECT user_id, k::INTEGER AS {name}, n, n * 100 / sum(n) OVER (PARTITION BY user_id) AS percent, n / max(n) OVER (PARTITION BY user_id) AS of_max, {label.format("k")} AS label FROM f"""


_add("hour_histogram", _watch(activity.hour_histogram), _hist("h", "hour", 24, _AMPM))
_add("weekday_histogram", _watch(activity.weekday_histogram), _hist("dow", "weekday", 7, _DAYNAME))
_add("peaks", _watch(activity.peaks), f"""WITH {_E}, a AS (SELECT user_id, h, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT user_id, dow, count(*) AS n FROM w GROUP BY ALL)
SELECT user_id, peak_hour, peak_hour_count, peak_weekday, {_DAYNAME.format("peak_weekday")} AS peak_day, peak_weekday_count FROM (SELECT user_id, arg_max(h, n * 100 - h)::INTEGER AS peak_hour, max(n) AS peak_hour_count FROM a GROUP BY 1)
JOIN (SELECT user_id, arg_max(dow, n * 100 - dow)::INTEGER AS peak_weekday, max(n) AS peak_weekday_count FROM b GROUP BY 1) USING (user_id)""")
_add("time_intervals", _watch(activity.time_intervals), f"""WITH {_E}, c AS (SELECT user_id, h // 6 AS k, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT u.user_id, x.k, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM w) u CROSS JOIN (SELECT unnest(range(0, 4)) AS k) x LEFT JOIN c ON c.user_id = u.user_id AND c.k = x.k)
SELECT user_id, ['Night (12AM-6AM)', 'Morning (6AM-12PM)', 'Afternoon (12PM-6PM)', 'Evening (6PM-12AM)'][k + 1] AS interval, ['0-6', '6-12', '12-18', '18-24'][k + 1] AS hours, n,
 n * 100 / sum(n) OVER (PARTITION BY user_id) AS percent, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) = 1 AS peak FROM f""")
_WEEKS = """wk AS (SELECT user_id, isoyear(ts) AS y, week(ts) AS k, dow, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL),
weeks AS (SELECT user_id, y AS iso_year, k AS iso_week, arg_max(dow, row(n, -s))::INTEGER AS weekday, max(n) AS n FROM wk GROUP BY ALL)"""
_add("weekly_peak_day", _watch(activity.weekly_peak_day), f"""WITH {_E}, {_WEEKS} SELECT user_id, iso_year::INTEGER AS iso_year, iso_week::INTEGER AS iso_week, weekday, n FROM weeks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY iso_year DESC, iso_week DESC) <= 12""")
_add("overall_peak_day", _orders(activity.overall_peak_day), f"""WITH {_P}, {_WEEKS}, x AS (SELECT user_id, weekday, count(*) AS wins, min(iso_year * 100 + iso_week) AS m FROM weeks GROUP BY ALL)
SELECT user_id, arg_max(weekday, wins * 1e9 - m)::INTEGER AS weekday, max(wins) AS wins, sum(wins)::BIGINT AS weeks FROM x GROUP BY user_id""")
_MONTHS = f"""mh AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, h, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL), md AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, dow, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL),
months AS (SELECT user_id, month, strftime(strptime(month || '-01', '%Y-%m-%d'), '%b %Y') AS month_label, watches, peak_hour, {_AMPM.format("peak_hour")} AS peak_hour_label, peak_hour_count, peak_weekday, {_DAYNAME.format("peak_weekday")} AS peak_day, peak_weekday_count FROM
 (SELECT user_id, month, sum(n)::BIGINT AS watches, arg_max(h, row(n, -s))::INTEGER AS peak_hour, max(n) AS peak_hour_count FROM mh GROUP BY ALL)
 JOIN (SELECT user_id, month, arg_max(dow, row(n, -s))::INTEGER AS peak_weekday, max(n) AS peak_weekday_count FROM md GROUP BY ALL) USING (user_id, month))"""
_add("monthly_stats", _orders(activity.monthly_stats), f"WITH {_P}, {_MONTHS} SELECT * FROM months")
_add("monthly_stats_hours", _homes(activity.monthly_stats, 10), f"WITH {_home(10)}, {_MONTHS} SELECT * FROM months")
_add("monthly_trends", _orders(lambda w: activity.monthly_trends(activity.monthly_stats(w))), f"""WITH {_P}, {_MONTHS} SELECT user_id, month, month_label, 'hour' AS trend, peak_hour::BIGINT AS value, peak_hour_label AS label FROM months
 UNION ALL SELECT user_id, month, month_label, 'day', peak_weekday, peak_day FROM months UNION ALL SELECT user_id, month, month_label, 'activity', watches, watches::VARCHAR FROM months""")
_SHIFTS = """b AS (SELECT *, lag(month_label) OVER x AS from_month, lag(peak_hour) OVER x AS h0, lag(peak_hour_label) OVER x AS hl, lag(peak_weekday) OVER x AS d0, lag(peak_day) OVER x AS dl FROM months WINDOW x AS (PARTITION BY user_id ORDER BY month)),
s AS (SELECT user_id, month, from_month, month_label AS to_month, 0 AS k, 'peak_hour' AS kind, hl AS old, peak_hour_label AS new, 'Peak hour shifted from ' || hl || ' to ' || peak_hour_label AS description FROM b WHERE from_month IS NOT NULL AND abs(peak_hour - h0) >= 4
  UNION ALL SELECT user_id, month, from_month, month_label, 1, 'peak_day', dl, peak_day, CASE WHEN d0 >= 5 THEN 'Shifted from weekend to weekday' ELSE 'Shifted from weekday to weekend' END FROM b WHERE from_month IS NOT NULL AND (d0 >= 5) <> (peak_weekday >= 5))"""
_add("pattern_shifts", _orders(lambda w: activity.pattern_shifts(activity.monthly_stats(w))), f"""WITH {_P}, {_MONTHS}, {_SHIFTS} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY month, k))::INTEGER AS rank, from_month, to_month, kind, old, new, description FROM s QUALIFY rank <= 10""")
_add("trend_summary", _orders(lambda w: activity.trend_summary(activity.monthly_stats(w))), f"""WITH {_P}, {_MONTHS}, {_SHIFTS}, m AS (SELECT user_id, count(*) AS months, arg_min(month_label, month) AS a, arg_max(month_label, month) AS z FROM months GROUP BY 1), c AS (SELECT user_id, count(*) AS shifts FROM s GROUP BY 1)
SELECT user_id, months, coalesce(shifts, 0) AS shifts, 'Tracked ' || months || ' months from ' || a || ' to ' || z || CASE WHEN shifts > 0 THEN ' | ' || shifts || ' significant pattern shifts detected' ELSE '' END AS summary FROM m LEFT JOIN c USING (user_id)""")
_add("month_by_bin", _orders(activity.month_by_bin), f"""WITH {_P}, {_C}, m AS (SELECT w.user_id, strftime(ts, '%Y-%m') AS month, {_BUCKET} AS bucket, count(*) AS n FROM w JOIN c USING (user_id, channel_clean) GROUP BY ALL),
f AS (SELECT u.user_id, u.month, x.bucket, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT user_id, month FROM m) u CROSS JOIN {_NAMES} x LEFT JOIN m ON m.user_id = u.user_id AND m.month = u.month AND m.bucket = x.bucket)
SELECT user_id, month, bucket, n, n / sum(n) OVER (PARTITION BY user_id, month) AS share FROM f""")
_SEARCH = f"""{_E}, {_SAID}, q AS (SELECT * FROM le WHERE type = 'search'), c AS (SELECT user_id, channel_clean AS term, count(*) AS n, min(seq) AS s, arg_min(channel, seq) AS spelling FROM q GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS rank FROM c), t AS (SELECT user_id, count(*) AS searches, count(DISTINCT channel_clean) AS terms, {_LANGUAGES} FROM q GROUP BY 1)"""
_add("search_analytics", lambda s, d: activity.search_analytics(described(s, d)), f"WITH {_SEARCH} SELECT user_id, rank::INTEGER AS rank, term, spelling, n, searches, terms, english, hindi, hinglish, unknown FROM r JOIN t USING (user_id) WHERE rank <= 20")
_SETS = "sb AS (SELECT DISTINCT user_id, channel_clean FROM e WHERE type = 'subscribe'), wt AS (SELECT DISTINCT user_id, channel_clean FROM e WHERE type = 'watch')"
_OVER = f"""WITH {_E}, {_SETS} SELECT user_id, count(s) AS subscribed, count(w) AS watched, count(*) FILTER (s AND w) AS "both", count(*) FILTER (s AND w IS NULL) AS ghost, count(*) FILTER (w AND s IS NULL) AS unsubscribed,
 count(*) FILTER (s AND w) * 100 / nullif(count(s), 0) AS percent FROM (SELECT user_id, channel_clean, true AS s FROM sb) a FULL JOIN (SELECT user_id, channel_clean, true AS w FROM wt) b USING (user_id, channel_clean) GROUP BY user_id"""
_add("subscription_overlap", _events(overlap.subscription_overlap), _OVER)
_add("overlap_names", _events(overlap.overlap_names), f"""WITH {_E}, {_SETS}, k AS (SELECT 'both' AS kind, * FROM sb SEMI JOIN wt USING (user_id, channel_clean) UNION ALL SELECT 'ghost', * FROM sb ANTI JOIN wt USING (user_id, channel_clean) UNION ALL SELECT 'unsubscribed', * FROM wt ANTI JOIN sb USING (user_id, channel_clean)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY channel_clean) AS rank FROM k), n AS (SELECT user_id, channel_clean, arg_max(channel, CASE type WHEN 'watch' THEN 0 WHEN 'search' THEN 1 ELSE 2 END * 1e12 + seq) AS name FROM e GROUP BY ALL)
SELECT user_id, kind, rank::INTEGER AS rank, channel_clean, name FROM r JOIN n USING (user_id, channel_clean) WHERE rank <= 20""")


def _sess(gap: int) -> str:
    return f"""{_E}, g AS (SELECT user_id, ts, seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER x > {gap}::BIGINT * 60000000 THEN 1 ELSE 0 END AS new FROM w WINDOW x AS (PARTITION BY user_id ORDER BY ts, seq)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM g),
ss AS (SELECT user_id, session::BIGINT AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 60 + 5 AS minutes FROM n GROUP BY ALL)"""


_add("sessions", _watch(sessions.sessionise), f"WITH {_sess(60)} SELECT * FROM ss")
_add("sessions_6h", _watch(lambda w: sessions.sessionise(w, 360)), f"WITH {_sess(360)} SELECT * FROM ss")
_TIME = """SELECT user_id, sessions, minutes, minutes / 60 AS hours, minutes / sessions AS mean_minutes, longest_minutes, days, minutes / days AS minutes_per_day
FROM (SELECT user_id, count(*) AS sessions, sum(epoch_us(end_ts) - epoch_us(start_ts))::BIGINT / 1000000 / 60 + 5 * count(*) AS minutes, max(minutes) AS longest_minutes FROM ss GROUP BY 1) JOIN (SELECT user_id, count(DISTINCT d) AS days FROM w GROUP BY 1) USING (user_id)"""
_add("time_spent", _watch(sessions.time_spent), f"WITH {_sess(60)} {_TIME}")
_add("time_report", _watch(sessions.time_report), f"""WITH {_sess(60)}, t AS ({_TIME}) SELECT user_id, round_even(minutes, 1) AS minutes, round_even(hours, 1) AS hours, round_even(minutes_per_day, 1) AS daily_minutes, days, sessions, round_even(mean_minutes, 1) AS mean_minutes, round_even(longest_minutes, 1) AS longest_minutes,
 'Spent approximately ' || CASE WHEN round_even(hours, 1) >= 24 THEN (round_even(hours, 1) / 24)::BIGINT || ' days ' || floor(round_even(hours, 1) % 24)::BIGINT || ' hours' ELSE round_even(hours, 1) || ' hours' END || ' across ' || days || ' days (' || sessions || ' sessions)' AS summary FROM t""")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Sessions of the watches, read as a stream that is run to its end."""
    path = shared_dir(s)
    e = stream_table(ship(s), f"{d}/events.parquet").filter(F.col("event_type").isin("view", "click"))
    drain(session_stream(e.select("user_id", "ts")), path)
    return s.read.parquet(path)


_add("session_stream", _streamed, f"WITH {_sess(60)} SELECT user_id, start_ts, end_ts, events FROM ss")
_add("daily_counts", _watch(lambda w: streaks.daily(w).drop("hours")), f"WITH {_E}, {_DAYS} SELECT * FROM days")
_add("daily_hours", _homes(lambda w: streaks.daily(w).select("user_id", "date", F.posexplode("hours").alias("hour", "n")), 10), f"WITH {_home(10)}, {_DAYS} SELECT user_id, date, x.hour::INTEGER AS hour, coalesce(n, 0) AS n FROM days CROSS JOIN (SELECT unnest(range(24)) AS hour) x LEFT JOIN (SELECT user_id, d AS date, h AS hour, n FROM dh) USING (user_id, date, hour)")
_add("daily_baseline", _watch(lambda w: streaks.baseline(streaks.daily(w))), f"WITH {_E}, {_DAYS} SELECT user_id, avg(total) AS mean, stddev_pop(total) AS sigma, sum(late) / sum(total) AS late_share, count(*) AS days FROM days GROUP BY user_id")
_LATE = "ln AS (SELECT user_id, date, late, total, peak_hour FROM days WHERE late >= {n})"
_BINGE = "lim AS (SELECT *, avg(total) OVER p AS mean, stddev_pop(total) OVER p AS sigma FROM days WINDOW p AS (PARTITION BY user_id)), bd AS (SELECT user_id, date, total, total - mean AS excess, total / mean AS multiplier FROM lim WHERE total > CASE WHEN sigma = 0 THEN 2 * mean ELSE mean + 2 * sigma END AND total >= {n})"
_add("late_night_days", _homes(lambda w: streaks.late_night_days(streaks.daily(w)), 10), f"WITH {_home(10)}, {_DAYS}, {_LATE.format(n=3)} SELECT * FROM ln QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 20")
_add("binge_days", _homes(lambda w: streaks.binge_days(streaks.daily(w)), 10), f"WITH {_home(10)}, {_DAYS}, {_BINGE.format(n=10)} SELECT * FROM bd QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY date DESC) <= 20")
_add("unusual_weeks", _homes(lambda w: streaks.unusual_weeks(streaks.daily(w)), 5), f"""WITH {_home(5)}, {_DAYS}, b AS (SELECT user_id, sum(late) / sum(total) AS base FROM days GROUP BY 1), k AS (SELECT user_id, isoyear(date)::INTEGER AS iso_year, week(date)::INTEGER AS iso_week, sum(late)::BIGINT AS late, sum(total)::BIGINT AS total FROM days GROUP BY ALL)
SELECT user_id, iso_year, iso_week, late, total, late / total AS share FROM k JOIN b USING (user_id) WHERE late / total > 1.5 * base AND late >= 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY iso_year DESC, iso_week DESC) <= 10""")


def _chain(source: str, keys: str, gap: int, least: int, sums: str) -> str:
    return f"""(SELECT {keys}, min(date) AS start, max(date) AS "end", count(*) AS dates, {sums} AS videos, max(date) - min(date) + 1 AS span FROM (
 SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS chain FROM (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY {keys} ORDER BY date) > {gap} THEN 1 ELSE 0 END AS new FROM {source}))
 GROUP BY {keys}, chain HAVING count(*) >= {least})"""


_add("binge_periods", lambda s, d: streaks.binge_periods(streaks.daily(purchases(s, d).withColumn("user_id", F.expr("user_id div 100")))), f"""WITH {_P.replace("SELECT o_custkey AS", "SELECT o_custkey // 100 AS", 1)}, {_DAYS}, {_BINGE.format(n=10)} SELECT user_id, start, "end", dates, videos::BIGINT AS videos, span::INTEGER AS span, videos / dates AS per_day FROM {_chain("bd", "user_id", 2, 2, "sum(total)")}""")
_add("late_night_moods", _homes(lambda w: streaks.late_night_moods(streaks.daily(w)), 10), f"""WITH {_home(10)}, {_DAYS}, {_LATE.format(n=3)} SELECT user_id, start, "end", dates, videos::BIGINT AS videos, span::INTEGER AS span FROM {_chain("ln", "user_id", 2, 2, "sum(late)")}""")
_add("rhythm", _watch(streaks.rhythm), f"""WITH {_E}, r AS (SELECT user_id, avg(CASE WHEN dow >= 5 THEN 1 ELSE 0 END) AS weekend_share, count(*) FILTER (h >= 20 OR h < 5) AS night, count(*) FILTER (h >= 5 AND h < 12) AS morning FROM w GROUP BY 1)
SELECT user_id, weekend_share, weekend_share > 0.35 AS weekend_heavy, night, morning, CASE WHEN night > 1.5 * morning THEN 'Night Owl' WHEN morning > 1.5 * night THEN 'Early Bird' ELSE 'Balanced' END AS chronotype FROM r""")
_add("inactive_periods", _watch(lambda w: streaks.inactive_periods(streaks.daily(w)), passive=False), f"""WITH {_E.replace("type = 'watch')", "engagement = 'active')")}, d AS (SELECT DISTINCT user_id, d AS date FROM w), g AS (SELECT user_id, lag(date) OVER (PARTITION BY user_id ORDER BY date) AS last_active, date AS resumed FROM d)
SELECT user_id, last_active, resumed, (resumed - last_active - 1)::INTEGER AS gap_days FROM g WHERE resumed - last_active >= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY resumed DESC) <= 5""")


def _three(t: int, kind: str, source: str, date: str, value: str, high: str) -> str:
    return f"SELECT user_id, {t} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {value} DESC, {date}) AS k, '{kind}' AS kind, {date} AS date, ({value})::DOUBLE AS value, CASE WHEN {high} THEN 'high' ELSE 'medium' END AS severity FROM {source} QUALIFY k <= 3"


_add("anomalies", _homes(lambda w: streaks.anomalies(streaks.daily(w)), 10), f"""WITH {_home(10)}, {_DAYS}, {_BINGE.format(n=10)}, {_LATE.format(n=3)}, bp AS {_chain("bd", "user_id", 2, 2, "sum(total)")}, lm AS {_chain("ln", "user_id", 2, 2, "sum(late)")},
a AS ({_three(0, "binge_period", "bp", "start", "span", "span >= 5")} UNION ALL {_three(1, "late_mood", "lm", "start", "span", "span >= 4")} UNION ALL {_three(2, "late_day", "ln", "date", "late", "late >= 10")} UNION ALL {_three(3, "binge_day", "bd", "date", "total", "multiplier >= 3")})
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY t, k))::INTEGER AS place, kind, date, value, severity FROM a""")


def _habits(key: str, least: int, source: str = "w", days: int = 0) -> str:
    return f"""cd AS (SELECT DISTINCT user_id, {key}, d AS date FROM {source}), st AS {_chain("cd", f"user_id, {key}", 1, least, "0")},
hb AS (SELECT user_id, {key}, count(*) AS streaks, max(dates) AS longest, sum(dates)::BIGINT AS total_days FROM st GROUP BY ALL), dw AS (SELECT user_id, {key}, count(DISTINCT d) AS days_watched, min(seq) AS s FROM {source} GROUP BY ALL),
hr AS (SELECT user_id, {key}, streaks, longest, total_days, days_watched, least(100, total_days * 10)::BIGINT AS score, (row_number() OVER (PARTITION BY user_id ORDER BY longest DESC, total_days DESC, s))::INTEGER AS rank FROM hb JOIN dw USING (user_id, {key}) WHERE days_watched >= {days})"""


_SPELL = "v AS (SELECT user_id, seq, d, 't' || substr(channel, 9, 1) AS topic FROM w)"


def _spelled(w: DataFrame) -> DataFrame:
    return w.withColumn("micro_topics", F.array(F.concat(F.lit("t"), F.substring("channel", 9, 1))))


_add("channel_habits", _homes(lambda w: streaks.channel_habits(w).drop("habit_streaks"), 50), f"WITH {_home(50)}, {_habits('channel_clean', 3)} SELECT * FROM hr")
_add("channel_habit_streaks", _homes(lambda w: streaks.habit_streaks(streaks.channel_habits(w)), 50), f"""WITH {_home(50)}, {_habits('channel_clean', 3)} SELECT user_id, channel_clean, (row_number() OVER (PARTITION BY user_id, channel_clean ORDER BY start) - 1)::INTEGER AS place, start, "end", dates AS days FROM st""")
_add("habit_strength", _homes(lambda w: streaks.habit_strength(streaks.channel_habits(w)), 50), f"""WITH {_home(50)}, {_habits('channel_clean', 3)} SELECT user_id, count(*) AS habits, max(longest) AS longest, least(100, 10 * count(*) + 5 * max(longest) + sum(CASE WHEN rank <= 5 THEN total_days ELSE 0 END))::BIGINT AS strength FROM hr GROUP BY user_id""")
_add("topic_habits", _homes(lambda w: streaks.topic_habits(_spelled(w)).drop("habit_streaks"), 10), f"""WITH {_home(10)}, {_SPELL}, {_habits('topic', 3, 'v', 5)} SELECT * FROM hr WHERE rank <= 30""")
_add("habit_report", _homes(lambda w: streaks.habit_report(_spelled(w), "micro_topics"), 10), f"""WITH {_home(10)}, {_SPELL}, a AS (WITH {_habits('channel_clean', 3)} SELECT user_id, count(*) AS habits, max(longest) AS longest, least(100, 10 * count(*) + 5 * max(longest) + sum(CASE WHEN rank <= 5 THEN total_days ELSE 0 END))::BIGINT AS strength, arg_min(channel_clean, rank) AS best FROM hr GROUP BY user_id),
t AS (WITH {_habits('topic', 3, 'v', 5)} SELECT user_id, count(*) AS topics FROM hr GROUP BY user_id), v2 AS (SELECT user_id, count(*) AS videos FROM (SELECT user_id FROM w GROUP BY user_id, channel_clean HAVING count(DISTINCT d) >= 2) GROUP BY user_id),
r AS (SELECT user_id, coalesce(habits, 0) AS habits, coalesce(videos, 0) AS videos, coalesce(topics, 0) AS topics, coalesce(longest, 0) AS max_streak_days, coalesce(strength, 0) AS strength, best FROM (SELECT DISTINCT user_id FROM w) LEFT JOIN a USING (user_id) LEFT JOIN t USING (user_id) LEFT JOIN v2 USING (user_id))
SELECT user_id, habits, videos, topics, max_streak_days, strength, coalesce(nullif(concat_ws(' | ', CASE WHEN habits > 0 THEN 'Strongest habit: ' || best || ' watched ' || max_streak_days || ' days in a row' END, CASE WHEN habits > 1 THEN habits || ' channels with daily habits' END,
 CASE WHEN videos > 0 THEN videos || ' rewatched videos' END, CASE WHEN topics > 0 THEN topics || ' recurring topics' END), ''), 'No strong habits detected') AS summary FROM r""")


def _rewatched(source: str, title: str, channel: str) -> str:
    return f"""WITH {source}, t AS (SELECT user_id, {title} AS title, count(*) AS watches, count(DISTINCT d) AS days, arg_min(d, seq) AS first_seen, arg_min({channel}, seq) AS channel, min(seq) AS s FROM w WHERE length({title}) > 5 GROUP BY ALL HAVING count(DISTINCT d) >= 2),
cd AS (SELECT DISTINCT user_id, {title} AS title, d AS date FROM w), st AS {_chain("cd", "user_id, title", 1, 3, "0")}, l AS (SELECT user_id, title, max(dates) AS longest FROM st GROUP BY ALL)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY days DESC, watches DESC, s))::INTEGER AS rank, title, watches, days, first_seen, channel, longest IS NOT NULL AS has_streak, coalesce(longest, 0) AS longest_streak FROM t LEFT JOIN l USING (user_id, title) QUALIFY rank <= 30"""


_add("rewatched_videos", _orders(streaks.rewatched_videos), _rewatched(_P, "title", "channel_clean"))
_add("rewatched_titles", _homes(streaks.rewatched_videos, 50), _rewatched(_home(50), "channel_clean", "channel_clean"))
_add("longest_streak", _watch(streaks.longest_streak), f"""WITH {_E}, cd AS (SELECT DISTINCT user_id, d AS date FROM w) SELECT user_id, dates AS days, start, "end", strftime(start, '%b %d') || ' - ' || strftime("end", '%b %d') AS label FROM {_chain("cd", "user_id", 1, 1, "0")} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY dates DESC, start) = 1""")

_add("card_stats", _watch(cards.stats_overview), f"WITH {_sess(60)} SELECT user_id, watches, channels, days, sessions FROM (SELECT user_id, count(*) AS watches, count(DISTINCT channel_clean) AS channels, count(DISTINCT d) AS days FROM w GROUP BY 1) JOIN (SELECT user_id, count(*) AS sessions FROM ss GROUP BY 1) USING (user_id)")
_add("card_peak_month", _orders(cards.peak_month), f"WITH {_P}, m AS (SELECT user_id, monthname(ts) AS month, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL) SELECT user_id, arg_max(month, row(n, -s)) AS month, max(n) AS n FROM m GROUP BY user_id")
_add("card_top_channels", _watch(cards.top_channels), f"SELECT user_id, rank, name, n, percent FROM ({_top('true', 5)})")
_add("card_top_channel", _watch(lambda w: cards.top_channels(w, 1)), f"SELECT user_id, rank, name, n, percent FROM ({_top('true', 1)})")
_add("card_time_spent", _watch(cards.time_spent_card), f"WITH {_sess(60)}, t AS ({_TIME}) SELECT user_id, round_even(hours, 1) AS hours, round_even(minutes, 0) AS minutes, round_even(minutes_per_day, 1) AS daily_minutes FROM t")


def _slots(df: DataFrame, *names: str) -> DataFrame:
    return df.select("user_id", *names, "n", F.posexplode("slots").alias("slot", "slot_n"))


def _cycle(column: str, name: str, size: int, more: str = "") -> str:
    return f"""WITH {_E}, c AS (SELECT user_id, {column} AS k, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL), p AS (SELECT user_id, arg_max(k, row(n, -s))::INTEGER AS {name}, max(n) AS n FROM c GROUP BY user_id)
SELECT p.user_id, {name}, p.n, slot::INTEGER AS slot, coalesce(c.n, 0) AS slot_n {more} FROM p CROSS JOIN (SELECT unnest(range({size})) AS slot) x LEFT JOIN c ON c.user_id = p.user_id AND c.k = slot"""


_add("card_watch_cycle", _watch(lambda w: _slots(cards.watch_cycle(w), "hour")), _cycle("h", "hour", 24))
_add("card_peak_weekday", _watch(lambda w: _slots(cards.peak_weekday(w), "weekday", "day")), _cycle("dow", "weekday", 7, ", " + _DAYNAME.format("weekday") + " AS day"))
_add("card_binge_sessions", _homes(sessions.binge_sessions, 10), f"""WITH {_sess(60).replace(_E, _home(10))}, b AS (SELECT user_id, count(*) AS binges, max(minutes) AS longest_minutes, arg_max(start_ts, minutes - session * 1e-7) AS t FROM ss WHERE minutes >= 120 GROUP BY user_id)
SELECT user_id, coalesce(binges, 0) AS binges, longest_minutes, coalesce(floor(longest_minutes)::BIGINT // 60, 0) || 'h ' || coalesce(floor(longest_minutes)::BIGINT % 60, 0) || 'm' AS longest, t::DATE AS longest_date, coalesce(strftime(t, '%B %d'), '') AS longest_day FROM (SELECT DISTINCT user_id FROM w) LEFT JOIN b USING (user_id)""")
_add("card_late_night", _watch(cards.late_night), f"WITH {_E}, l AS (SELECT user_id, count(*) AS n, arg_max(ts, h * 1e16 + epoch_us(ts)) AS t FROM w WHERE h < 5 GROUP BY user_id) SELECT user_id, n, t AS latest_ts, strftime(t, '%-I:%M %p') AS latest, strftime(t, '%B %d') AS latest_date FROM l")


def _steady(source: str, least: int, gap: int) -> str:
    return f"""WITH {source}, g AS (SELECT user_id, channel_clean, channel, seq, epoch_us(ts) AS m, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, channel_clean ORDER BY ts, seq)) / 86400000000) AS gap FROM w),
c AS (SELECT user_id, channel_clean, count(*) AS n, arg_min(channel, seq) AS name, floor((max(m) - min(m)) / 86400000000)::BIGINT AS span, avg(gap) AS mean_gap, min(seq) AS s FROM g GROUP BY ALL)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY mean_gap - 0.1 * n, s))::INTEGER AS rank, name, n, span, mean_gap, count(*) OVER (PARTITION BY user_id) AS total FROM c WHERE n >= {least} AND span >= 7 AND mean_gap <= {gap} QUALIFY rank <= 5"""


_add("card_habits", _homes(cards.habit_channels, 10), _steady(_home(10), 4, 14))
_add("card_habits_wide", _orders(lambda w: cards.habit_channels(w, 3, 7, 400)), _steady(_P, 3, 400))


def _rule(kind: str, k: int, column: str, least: float, lift: float, hits: int) -> str:
    return f"""SELECT user_id, '{kind}' AS kind, {k} AS k, channel_clean, value, n / c AS confidence, n, c0, s FROM (SELECT *, sum(n) OVER (PARTITION BY user_id, channel_clean) AS c, sum(n) OVER (PARTITION BY user_id, value) AS v, sum(n) OVER (PARTITION BY user_id) AS t, min(s) OVER (PARTITION BY user_id, channel_clean) AS c0
 FROM (SELECT user_id, channel_clean, {column} AS value, count(*) AS n, min(seq) AS s FROM kr GROUP BY ALL)) WHERE n / c >= {least} AND n * t / (c * v) >= {lift} AND n >= {hits}"""


def _rules(source: str, views: int, lift: float, hits: int, ends: int) -> str:
    return f"""WITH {source}, c AS (SELECT user_id, channel_clean, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL), t AS (SELECT user_id, count(*) AS a FROM w GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS rank FROM c), k AS (SELECT user_id, channel_clean FROM r JOIN t USING (user_id) WHERE rank <= 20 AND n >= greatest({views}, a // 100)),
kr AS (SELECT user_id, channel_clean, seq, {_DAYNAME.format("w.dow")} AS day, CASE WHEN h < 5 THEN 'late night' WHEN h < 12 THEN 'morning' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'evening' ELSE 'night' END AS slot, w.dow AS dn FROM w JOIN k USING (user_id, channel_clean)),
e2 AS (SELECT user_id, channel_clean, count(*) AS n, avg(CASE WHEN dn >= 5 THEN 1 ELSE 0 END) AS confidence, min(CASE WHEN dn >= 5 THEN seq END) AS s FROM kr GROUP BY ALL HAVING count(*) >= {ends} AND avg(CASE WHEN dn >= 5 THEN 1 ELSE 0 END) >= 0.6),
a AS ({_rule("weekday", 0, "day", 0.3, lift, hits)} UNION ALL {_rule("slot", 1, "slot", 0.4, lift, hits)} UNION ALL SELECT user_id, 'weekend', 2, channel_clean, 'weekend', confidence, n, s, s FROM (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1)),
o AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY confidence * n DESC, k, c0, s))::INTEGER AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM a)
SELECT user_id, rank, kind, channel_clean, value, confidence, n, total, CASE k WHEN 0 THEN 'You watch **' || channel_clean || '** on **' || value || 's** (' || floor(confidence * 100)::BIGINT || '% of the time)' WHEN 1 THEN '**' || channel_clean || '** is your **' || value || '** go-to (' || floor(confidence * 100)::BIGINT || '%)'
 ELSE '**' || channel_clean || '** is your **weekend** channel (' || floor(confidence * 100)::BIGINT || '% weekend views)' END AS insight FROM o WHERE rank <= 5"""


_add("card_patterns", _homes(cards.patterns, 50), _rules(_home(50), 10, 1.5, 5, 10))
_add("card_patterns_low", _watch(lambda w: cards.patterns(w, least_views=2, lift=1.1, hits=2, weekend_total=2)), _rules(_E, 2, 1.1, 2, 2))
_add("card_rewatched", _orders(cards.rewatched), f"WITH {_P}, c AS (SELECT user_id, title, count(*) AS n, min(seq) AS s FROM w GROUP BY ALL HAVING count(*) > 1) SELECT user_id, count(*) AS titles, arg_max(title, row(n, -s)) AS top, max(n) AS times FROM c GROUP BY user_id")
_add("card_searches", _events(cards.searches), f"WITH {_SEARCH} SELECT user_id, rank::INTEGER AS rank, term, n, searches FROM r JOIN t USING (user_id) WHERE rank <= 5")
_add("card_first_last", _watch(cards.first_and_last), f"""WITH {_E}, f AS (SELECT user_id, arg_min(channel_clean, epoch_us(ts)) AS first_title, min(ts) AS first_ts, arg_max(channel_clean, epoch_us(ts)) AS last_title, max(ts) AS last_ts FROM w GROUP BY user_id)
SELECT *, strftime(first_ts, '%B %d, %Y') AS first_date, strftime(last_ts, '%B %d, %Y') AS last_date FROM f""")

# The words of the expressions once more, so that the SQL does not follow a slip in them.
_STOPS = """string_split('a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very just also now and but if or because until while this that these those what which who whom whose i you he she it we they me him her us them my your his its our their myself yourself himself herself itself ourselves themselves am about get got go going went come came make made take took see saw know knew think thought want like look use find give tell say said video watch watched new first last best top full part episode ep vs ft feat official exclusive shorts short movie clip scene trailer teaser', ' ')"""


def _docs(f):
    return lambda s, d: f(_read(s, d, "documents"))


_CLEAN = r"nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '^(Watched |Viewed |Searched for |watched |viewed |searched for )', ''), 'https?://\S+', '', 'g'), '[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+', '', 'g')), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '')"
_add("clean_text", _docs(lambda t: t.select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("text_md5"))), f"SELECT doc_id, md5({_CLEAN}) AS text_md5 FROM documents")
_add("language", _docs(lambda t: t.select("doc_id", X.language(F.col("text")).alias("l")).select("doc_id", "l.type", "l.confidence", "l.devanagari", "l.latin", "l.markers", "l.words")), f"WITH {_LANG} SELECT * FROM lang")
_TAGGED = "text || ' #' || lang || ' #' || source || ' #x #' || lang"


def _tagged(t: DataFrame) -> DataFrame:
    return t.withColumn("tagged", F.concat("text", F.lit(" #"), "lang", F.lit(" #"), "source", F.lit(" #x #"), "lang"))


_TAGS = rf"SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all({_TAGGED}, '#([\p{{L}}\p{{N}}_]+)', 1), lambda x: lower(x)), lambda x: length(x) >= 2) AS tags FROM documents"
_add("hashtags", _docs(lambda t: _tagged(t).select("doc_id", F.posexplode(X.hashtags(F.col("tagged"))).alias("pos", "tag"))), f"""WITH t AS ({_TAGS}), u AS (SELECT doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM t), f AS (SELECT doc_id, tag, min(i) AS i FROM u GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, tag FROM f""")


def _v1(text: str) -> str:
    """SQL of ``text_v1``."""
    whole = rf"nfc_normalize(regexp_replace({text}, '[\x{{0900}}-\x{{097F}}]+', ' ', 'g'))"
    bare = rf"trim(regexp_replace(regexp_replace({whole}, '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{FEFF}}]', '', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"
    return rf"trim(regexp_replace(replace(array_to_string(list_filter(string_split({bare}, ' '), lambda w: NOT list_contains({_STOPS}, lower(w))), ' '), '|', ' '), '\s+', ' ', 'g'))"


_add("text_v1", _docs(lambda t: t.select("doc_id", F.md5(X.text_v1(F.col("text"))).alias("text_md5"))), f"SELECT doc_id, md5({_v1('text')}) AS text_md5 FROM documents")


def _sane(text: str) -> str:
    """SQL of ``sanitise_topic``."""
    ends = r"""[ #@|\[\](){}.,!?:;"''_-]+"""
    plain = rf"regexp_replace(regexp_replace({text}, '\.?#[\p{{L}}\p{{N}}_]*', '', 'g'), '[\x{{2014}}\x{{2013}}-]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({plain}, '^{ends}', ''), '{ends}$', ''), '[\s\x{{A0}}]+', ' ', 'g'))"


_add("sanitised_texts", _docs(lambda t: t.select("doc_id", F.md5(X.sanitise_topic(F.col("text"))).alias("text_md5"))), f"SELECT doc_id, md5({_sane('text')}) AS text_md5 FROM documents")


def _placed(s: SparkSession, d: str) -> DataFrame:
    """Documents as watches that end with a place and a part; long ones count as active."""
    places = _read(s, d, "nation").join(_read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(" ", "r_name", "n_name").alias("place"))
    parts = _read(s, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    t = _read(s, d, "documents").withColumn("n_nationkey", (F.col("doc_id") % 25).cast("int")).join(places, "n_nationkey").join(parts, "doc_id")
    text = F.concat(F.col("text"), F.lit(" "), F.col("place"), F.lit(" the-"), F.col("p_name"), F.lit(". #"), F.col("lang"), F.lit(" #"), F.col("source"))
    t = t.select("doc_id", F.col("source").alias("user_id"), F.lit("watch").alias("type"), F.when(F.col("n_chars") >= 500, "active").otherwise("passive").alias("engagement"), text.alias("text_clean"))
    return t.withColumn("language_type", X.language(F.col("text_clean"))["type"])


def _names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Places with and without their region as the gazetteer, words of parts as the lexicon."""
    n, r = _read(s, d, "nation"), _read(s, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    phrases = both.select(F.concat_ws(" ", "r_name", "n_name").alias("phrase")).union(n.select("n_name")).withColumn("label", F.lit("GPE"))
    return phrases, _read(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


_PLACED = f"""{_LANG.replace("FROM documents)", "FROM pd)", 1)}, rows AS (SELECT pd.*, type AS language FROM pd JOIN lang USING (doc_id))"""
_PD = """pd AS (SELECT doc_id, source, n_chars, documents.text || ' ' || r_name || ' ' || n_name || ' the-' || p_name || '. #' || lang || ' #' || source AS text
 FROM documents JOIN nation ON doc_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = doc_id)"""


def _topic_sql(rows: str) -> str:
    """SQL of topics of ``rows(doc_id, text, language)`` as lists in order; no text of the tables is hindi."""
    return rf"""src AS (SELECT doc_id, text, CASE WHEN language = 'hinglish' THEN {_v1("text")} END AS text_v1, CASE WHEN language = 'hinglish' THEN {_v1("text")} ELSE text END AS body FROM {rows}),
gz AS (SELECT lower(r_name || ' ' || n_name) AS phrase FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT lower(n_name) FROM nation), lex AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS word FROM part),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(body, '\.?#[\p{{L}}\p{{N}}_]*', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x <> '') AS ts FROM src),
gram AS (SELECT doc_id, p, n, array_to_string(ts[p:p + n - 1], ' ') AS phrase FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS p FROM tok), (SELECT unnest([1, 2, 3, 4]) AS n) WHERE p + n - 1 <= len(ts)),
hit AS (SELECT * FROM gram SEMI JOIN gz USING (phrase)), best AS (SELECT a.doc_id, a.phrase, min(a.p) AS p FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.doc_id = a.doc_id AND b.p <= a.p AND b.p + b.n >= a.p + a.n AND b.n > a.n) GROUP BY ALL),
e AS (SELECT doc_id, list(phrase ORDER BY p) AS ner FROM best GROUP BY doc_id),
wd AS (SELECT doc_id, i, unnest(string_split(lower({_sane("w")}), ' ')) AS word FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(body, '[\s\x{{A0}}]+') AS ws FROM src))),
wo AS (SELECT doc_id, word, min(i) AS i FROM wd SEMI JOIN lex USING (word) WHERE length(word) >= 2 AND NOT list_contains({_STOPS}, word) GROUP BY ALL), nn AS (SELECT doc_id, list(word ORDER BY i, word) AS nouns FROM wo GROUP BY doc_id),
ht AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '#([\p{{L}}\p{{N}}_]+)', 1), lambda x: lower(x)), lambda x: length(x) >= 2) AS tags FROM src),
al AS (SELECT doc_id, text_v1, tags, coalesce(ner, []) AS ner, coalesce(nouns, []) AS nouns FROM src JOIN ht USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN nn USING (doc_id)),
cut AS (SELECT *, list_filter(list_concat(tags, ner, nouns), lambda t: contains(t, ' ') OR NOT list_contains(flatten(list_transform(list_filter(ner, lambda x: contains(x, ' ')), lambda x: string_split(x, ' '))), t)) AS every FROM al),
topics AS (SELECT doc_id, text_v1, tags AS hashtags, ner, nouns, list_filter(every, lambda t, k: list_position(every, t) = k) AS micro_topics FROM cut)"""


def _enriched(s: SparkSession, d: str) -> DataFrame:
    return topics.enrich_events(_placed(s, d), "doc_id", *_names(s, d))


def _lists(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted where words of one token may come in either order; topics by their digest."""
    joined = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    return df.select(*keys, F.md5("text_v1").alias("text_v1_md5"), *[joined(c) for c in ("ner", "nouns", "micro_topics")])


_SORTED = "md5(text_v1) AS text_v1_md5, array_to_string(list_sort(ner), '|') AS ner, array_to_string(list_sort(nouns), '|') AS nouns, array_to_string(list_sort(micro_topics), '|') AS micro_topics"
_add("topic_columns", lambda s, d: _lists(_enriched(s, d), "doc_id"), f"""WITH {_PD}, {_PLACED}, {_topic_sql("rows")}
SELECT doc_id, CASE WHEN n_chars >= 500 THEN text_v1_md5 END AS text_v1_md5, CASE WHEN n_chars >= 500 THEN ner END AS ner, CASE WHEN n_chars >= 500 THEN nouns END AS nouns, CASE WHEN n_chars >= 500 THEN micro_topics END AS micro_topics
FROM (SELECT doc_id, {_SORTED} FROM topics) JOIN pd USING (doc_id)""")
_add("topic_report", lambda s, d: topics.report(_enriched(s, d)), f"""WITH {_PD}, {_PLACED}, {_topic_sql("rows")}
SELECT source AS user_id, count(*) AS events, count(*) FILTER (n_chars >= 500) AS active_watches, count(*) FILTER (n_chars >= 500 AND len(micro_topics) > 0) AS with_topics, coalesce(sum(len(list_distinct(hashtags))) FILTER (n_chars >= 500), 0)::BIGINT AS hashtags,
 coalesce(sum(len(ner)) FILTER (n_chars >= 500), 0)::BIGINT AS ner, coalesce(sum(len(nouns)) FILTER (n_chars >= 500), 0)::BIGINT AS nouns, coalesce(sum(len(micro_topics)) FILTER (n_chars >= 500), 0)::BIGINT AS micro_topics FROM topics JOIN pd USING (doc_id) GROUP BY source""")


def _said(s: SparkSession, d: str) -> DataFrame:
    """Topics of chat messages: any text column will do."""
    c = _read(s, d, "conversations").select("conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn", "role", F.md5("text")).alias("doc_id")).dropDuplicates(["doc_id"])
    found = topics.enrich(c.withColumn("l", X.language(F.col("text"))["type"]), "text", "l", "doc_id", *_names(s, d))
    return _lists(found, "conv_id", "turn", "doc_id")


_CHAT = """pd AS (SELECT DISTINCT conv_id, turn, text, concat_ws('-', conv_id, turn, role, md5(text)) AS doc_id FROM conversations)"""
_add("topic_messages", _said, f"""WITH {_CHAT}, {_PLACED}, {_topic_sql("rows")} SELECT conv_id, turn, doc_id, {_SORTED} FROM topics JOIN pd USING (doc_id)""")
_add("topic_totals", _docs(lambda t: topics.top_topics(_tagged(t).withColumn("tags", X.hashtags(F.col("tagged"))), "tags", (), "doc_id", 10)), f"""WITH t AS ({_TAGS}), u AS (SELECT doc_id, unnest(tags) AS topic, generate_subscripts(tags, 1) AS i FROM t), f AS (SELECT doc_id, topic, min(i) AS i FROM u GROUP BY ALL), p AS (SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM f),
c AS (SELECT topic, count(*) AS n, min(doc_id * 1000 + i) AS s FROM p GROUP BY 1) SELECT (row_number() OVER (ORDER BY n DESC, s))::INTEGER AS rank, topic, n, count(*) OVER () AS "distinct" FROM c QUALIFY rank <= 10""")
_add("topics_by_language", _docs(lambda t: topics.top_topics(_tagged(t).withColumn("tags", X.hashtags(F.col("tagged"))), "tags", ("lang",), "doc_id", 20)), f"""WITH t AS ({_TAGS}), u AS (SELECT doc_id, lang, unnest(tags) AS topic, generate_subscripts(tags, 1) AS i FROM t), f AS (SELECT doc_id, lang, topic, min(i) AS i FROM u GROUP BY ALL), p AS (SELECT doc_id, lang, topic, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM f),
c AS (SELECT lang, topic, count(*) AS n, min(doc_id * 1000 + i) AS s FROM p GROUP BY ALL) SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, s))::INTEGER AS rank, topic, n, count(*) OVER (PARTITION BY lang) AS "distinct" FROM c QUALIFY rank <= 20""")



def _urls(s: SparkSession, d: str) -> DataFrame:
    """Ids of addresses that carry the page's own: one shape of video and channel address for each host ending."""
    p = _read(s, d, "pages")
    code = F.substring(F.md5("url"), 1, 11)
    ending = F.regexp_extract("url", r"https?://[^/]*\.([a-z]+)/", 1)
    watch = F.when(ending == "com", F.concat("url", F.lit("&v="), code)).when(ending == "net", F.concat(F.lit("https://youtu.be/"), code)).when(ending == "org", F.concat("url", F.lit("/embed/"), code)).otherwise(F.col("url"))
    owner = F.when(ending == "com", F.concat("url", F.lit("/channel/UC"), code)).when(ending == "net", F.concat("url", F.lit("/@a.b"))).when(ending == "org", F.concat("url", F.lit("/@user"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return p.select("page_id", X.video_id(watch).alias("video"), X.channel_id(owner).alias("channel"))


_add("url_ids", _urls, r"""SELECT page_id, CASE WHEN e IN ('com', 'net', 'org') THEN substr(md5(url), 1, 11) END AS video, CASE e WHEN 'com' THEN 'UC' || substr(md5(url), 1, 11) WHEN 'net' THEN '@a' WHEN 'org' THEN '@user' || page_id END AS channel
FROM (SELECT *, regexp_extract(url, 'https?://[^/]*\.([a-z]+)/', 1) AS e FROM pages)""")


def player_pages(s: SparkSession, d: str) -> DataFrame:
    """Every page's whole html, with a player object of the page's own title, text and address at its end."""
    p = _read(s, d, "pages").withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    form = F.struct(F.regexp_extract("url", "https?://([^/]+)", 1).alias("category"), F.struct(F.col("title").alias("simpleText")).alias("title"), F.col("url").alias("ownerChannelName"), F.struct(F.regexp_extract("html", "(?s)<article>([^{}]*)", 1).alias("simpleText")).alias("description"))
    player = F.to_json(F.struct(F.struct(form.alias("playerMicroformatRenderer")).alias("microformat"), F.struct(F.split("title", " ").alias("keywords")).alias("videoDetails")))
    return p.select("page_id", F.concat("html", F.lit("<script>var ytInitialPlayerResponse = "), player, F.lit(";</script>")).alias("html"))


def _metadata(s: SparkSession, d: str) -> DataFrame:
    meta = X.page_metadata(X.embedded_json(F.col("html")))
    return player_pages(s, d).select("page_id", meta.alias("m")).select("page_id", "m.category", "m.title", "m.channel_name", F.md5("m.description").alias("description_md5"), F.array_join("m.keywords", "|").alias("keywords"))


_add("page_metadata", _metadata, r"""SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS category, title, url AS channel_name, md5(nullif(substr(regexp_extract(html, '(?s)<article>([^{}]*)', 1), 1, 500), '')) AS description_md5, array_to_string(string_split(title, ' '), '|') AS keywords
FROM (SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)""")
_add("distinct_urls", lambda s, d: _read(s, d, "pages").filter(F.col("url") != "").select("url").dropDuplicates(), "SELECT DISTINCT url FROM pages WHERE url <> ''")


def _unknown(s: SparkSession, d: str) -> DataFrame:
    """Videos bought twice and more that are no part of the promoted kind, in batches."""
    counts = purchases(s, d).groupBy(F.col("text_clean").alias("channel_clean")).agg(F.count("*").alias("n"))
    known = _read(s, d, "part").filter(F.col("p_type") == "PROMO").select(F.concat(F.lit("part number "), F.col("p_partkey").cast("string")).alias("channel_clean"))
    return overlap.unknown_channels(counts, known, "channel_clean")


_UNKNOWN = f"""WITH {_P}, c AS (SELECT title AS channel_clean, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT channel_clean, n FROM c WHERE channel_clean NOT IN (SELECT 'part number ' || p_partkey FROM part WHERE p_type = 'PROMO')),
o AS (SELECT channel_clean, n, row_number() OVER (ORDER BY substr(md5(channel_clean), 1, 3), channel_clean) - 1 AS place FROM m)"""
_add("unknown_channels", _unknown, f"{_UNKNOWN} SELECT channel_clean, n, place, (place // 50)::BIGINT AS batch FROM o")
_add("channel_requests", lambda s, d: overlap.requests(_unknown(s, d), "channel_clean").select("batch", F.size("keys").cast("long").alias("size"), F.array_join("keys", "|").alias("keys")), f"{_UNKNOWN} SELECT (place // 50)::BIGINT AS batch, count(*) AS size, string_agg(channel_clean, '|' ORDER BY place) AS keys FROM o GROUP BY 1")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """All suppliers are known; those with a line shipped by now come anew."""
    sup = _read(s, d, "supplier")
    known = sup.select("s_suppkey", F.col("s_name").alias("name"), F.lit(1).cast("long").alias("fetch_count"))
    seen = _read(s, d, "lineitem").filter(F.col("l_returnflag") == "R").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.concat(F.lit("shipped "), F.col("l_shipdate").cast("date").cast("string"))).alias("name"))
    return overlap.upsert(known, seen, "s_suppkey")


_add("channel_upsert", _upsert, "WITH n AS (SELECT l_suppkey AS s_suppkey, max('shipped ' || l_shipdate::DATE) AS name FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT s_suppkey, coalesce(n.name, s.s_name) AS name, (CASE WHEN s.s_name IS NULL THEN 0 ELSE 1 END + CASE WHEN n.name IS NULL THEN 0 ELSE 1 END)::BIGINT AS fetch_count FROM supplier s FULL JOIN n USING (s_suppkey)")


def _stale(s: SparkSession, d: str) -> DataFrame:
    """Parts by their last shipment, stale 30 days after it, seen from the last one of all."""
    known = _read(s, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").cast("timestamp_ntz").alias("fetched"))
    now = _read(s, d, "lineitem").agg(F.max("l_shipdate")).first()[0]
    return overlap.stale(known, now)


_add("stale_channels", _stale, "SELECT l_partkey, max(l_shipdate)::TIMESTAMP AS fetched FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY")


def _categories(s: SparkSession, d: str) -> DataFrame:
    """Parts by brand and kind: brands of large parts map to their most common kind, words of names to the kind that sorts first."""
    part = _read(s, d, "part")
    mapping = part.filter("p_size >= 49").groupBy(F.col("p_brand").alias("topic")).agg(F.max("p_type").alias("category"))
    spare = part.filter("p_size = 1").select(F.explode(F.split("p_name", " ")).alias("keyword"), "p_type").groupBy("keyword").agg(F.min("p_type").alias("category"))
    channels = part.select("p_partkey", F.col("p_name").alias("name"), F.array(F.concat(F.col("p_brand"), F.lit("?")), "p_brand", "p_type").alias("topics"))
    out = overlap.categories(channels, "p_partkey", "topics", mapping, spare)
    return out.select("p_partkey", "category", F.array_join("categories", "|").alias("categories"))


_add("channel_categories", _categories, """WITH m AS (SELECT p_brand, max(p_type) AS c FROM part WHERE p_size >= 49 GROUP BY 1), f AS (SELECT unnest(string_split(p_name, ' ')) AS k, p_type FROM part WHERE p_size = 1), g AS (SELECT k, min(p_type) AS c FROM f GROUP BY 1),
x AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS k, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part), y AS (SELECT p_partkey, arg_min(c, i) AS c FROM x JOIN g USING (k) GROUP BY 1)
SELECT p.p_partkey, coalesce(m.c, y.c) AS category, coalesce(m.c, '') AS categories FROM part p LEFT JOIN m USING (p_brand) LEFT JOIN y USING (p_partkey)""")

# Exports: events are packed into the members of one archive per user, and read back from there.

_ZONES = ("UTC", "Asia/Kolkata", "America/New_York", "Mars/X")


def export_files(s: SparkSession, d: str) -> DataFrame:
    """``user_id, tz, filename, content``: views, clicks and errors (as adverts) are watches, purchases searches, signups subscriptions."""
    e = _read(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    name, at = F.concat(F.lit("Channel "), F.col("k").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.concat(at, F.date_format("ts", ".SSSSSS"))
    json = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    item = (
        F.when(F.col("event_type") == "view", json('{"title":"Watched ', name, '","titleUrl":"https://www.example.com/watch?v=', F.lpad(F.col("event_id").cast("string"), 11, "0"), '","time":"', micros, 'Z","subtitles":[{"name":"', name, '","url":"https://www.example.com/channel/UC', F.col("k").cast("string"), '"}]}'))
        .when((F.col("event_type") == "click") & (F.col("k") < 10), json('{"title":"Viewed a post","titleUrl":"https://www.example.com/post/', F.col("k").cast("string"), '","time":"', at, 'Z"}'))
        .when(F.col("event_type") == "click", json('{"title":"Viewed ', name, ' https://x.example/z","time":"', at, '","subtitles":[]}'))
        .when(F.col("event_type") == "error", json('{"title":"Watched an advert","time":"', at, 'Z","details":[{"name":"From Google Ads"}]}'))
        .when(F.col("event_type") == "purchase", json('{"title":"Searched for ', name, '","time":"', micros, '"}'))
        .otherwise(json("UC", F.col("k").cast("string"), ",https://www.example.com/channel/UC", F.col("k").cast("string"), ",", F.when(F.col("k") < 50, "").otherwise(json('"The ""', F.col("k").cast("string"), '"", live"'))))
    )
    file = F.when(F.col("event_type").isin("view", "click", "error"), exports.TARGETS[0]).when(F.col("event_type") == "purchase", exports.TARGETS[1]).otherwise(exports.TARGETS[2])
    own = e.select("user_id", file.alias("filename"), "event_id", item.alias("item")).groupBy("user_id", "filename").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"]).alias("items"))
    content = F.when(F.col("filename") == exports.TARGETS[2], F.concat(F.lit("Channel Id,Channel Url,Channel Title\n"), F.array_join("items", "\n"), F.lit("\n"))).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.col("user_id") % 4 + 1).cast("int"))
    return own.select("user_id", zone.alias("tz"), "filename", content.alias("content"))


def export_archives(s: SparkSession, d: str) -> DataFrame:
    """``archive, content``: a ZIP per user with a file of no interest first and an empty list under an upper-case name last."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for user, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, body in [("archive_browser.html", ""), *[(f"x/{f['filename']}", f["content"]) for f in files], ("y/WATCH-HISTORY.JSON", "[]")]:
                        z.writestr(zipfile.ZipInfo(name), body)
                yield pa.record_batch({"archive": pa.array([f"{user}.zip"]), "content": pa.array([buffer.getvalue()], pa.binary())})

    files = export_files(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("filename", "content"))).alias("files"))
    return files.mapInArrow(pack, "archive string, content binary")


_X = """x AS (SELECT *, (props->>'$.k')::INTEGER AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS tm, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'watch-history.json' WHEN event_type = 'purchase' THEN 'search-history.json' ELSE 'subscriptions.csv' END AS filename FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id, filename ORDER BY event_id) - 1 AS seq, CASE WHEN event_type = 'view' THEN '{"title":"Watched Channel ' || k || '","titleUrl":"https://www.example.com/watch?v=' || lpad(event_id::VARCHAR, 11, '0') || '","time":"' || tm || 'Z","subtitles":[{"name":"Channel ' || k || '","url":"https://www.example.com/channel/UC' || k || '"}]}'
 WHEN event_type = 'click' AND k < 10 THEN '{"title":"Viewed a post","titleUrl":"https://www.example.com/post/' || k || '","time":"' || t || 'Z"}' WHEN event_type = 'click' THEN '{"title":"Viewed Channel ' || k || ' https://x.example/z","time":"' || t || '","subtitles":[]}'
 WHEN event_type = 'error' THEN '{"title":"Watched an advert","time":"' || t || 'Z","details":[{"name":"From Google Ads"}]}' WHEN event_type = 'purchase' THEN '{"title":"Searched for Channel ' || k || '","time":"' || tm || '"}'
 ELSE 'UC' || k || ',https://www.example.com/channel/UC' || k || ',' || CASE WHEN k < 50 THEN '' ELSE '"The ""' || k || '"", live"' END END AS item FROM x),
f AS (SELECT user_id, filename, count(*) AS n, CASE WHEN filename = 'subscriptions.csv' THEN 'Channel Id,Channel Url,Channel Title' || chr(10) || string_agg(item, chr(10) ORDER BY event_id) || chr(10) ELSE '[' || string_agg(item, ',' ORDER BY event_id) || ']' END AS content FROM i GROUP BY user_id, filename),
g AS (SELECT u.user_id, t.target FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['watch-history.json', 'search-history.json', 'subscriptions.csv']) AS target) t)"""
#: Canonical columns by branch; the events lie in January, so an offset stands for each zone.
_CANON = """c AS (SELECT user_id, seq::INTEGER AS seq, 'watch' AS type, CASE WHEN event_type = 'view' THEN 'active' ELSE 'passive' END AS engagement, CASE WHEN event_type = 'view' THEN ts ELSE date_trunc('second', ts) END AS ts_utc,
  CASE WHEN event_type = 'view' THEN 'Channel ' || k ELSE 'Channel ' || k || ' https://x.example/z' END AS text_raw, 'channel ' || k AS text_clean, CASE WHEN event_type = 'view' THEN 'Channel ' || k END AS channel, CASE WHEN event_type = 'view' THEN 'UC' || k END AS channel_id,
  CASE WHEN event_type = 'view' THEN lpad(event_id::VARCHAR, 11, '0') END AS video_id, 'english' AS language_type FROM i WHERE event_type = 'view' OR event_type = 'click' AND k >= 10
 UNION ALL SELECT user_id, seq::INTEGER, 'search', NULL, ts, 'Channel ' || k, 'channel ' || k, NULL, NULL, NULL, 'english' FROM i WHERE event_type = 'purchase'
 UNION ALL SELECT user_id, seq::INTEGER, 'subscribe', NULL, NULL, NULL, NULL, CASE WHEN k < 50 THEN 'UC' || k ELSE 'The "' || k || '", live' END, 'UC' || k, NULL, NULL FROM i WHERE event_type = 'signup'),
l AS (SELECT *, ts_utc + to_minutes([0, 330, -300][user_id % 4 + 1]) AS ts_local FROM c WHERE user_id % 4 <> 3)"""


def _scan(match: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        found = exports.locate(exports.members(export_archives(s, d)), match=match)
        return found.select("archive", "target", "members", "member", "missing")

    return run


def _scan_sql(watch: str, missing: str) -> str:
    return f"""WITH {_X}, m AS (SELECT user_id, count(*) + 2 AS members FROM f GROUP BY 1) SELECT g.user_id || '.zip' AS archive, target, members, CASE WHEN target = 'watch-history.json' THEN {watch} WHEN f.content IS NOT NULL THEN 'x/' || target END AS member, CASE WHEN target = 'watch-history.json' THEN {missing} ELSE f.content IS NULL END AS missing
FROM g JOIN m USING (user_id) LEFT JOIN f ON f.user_id = g.user_id AND f.filename = g.target"""


_add("export_scan", _scan("first"), _scan_sql("CASE WHEN f.content IS NOT NULL THEN 'x/' || target END", "f.content IS NULL"))
_add("export_scan_last", _scan("last_ci"), _scan_sql("'y/WATCH-HISTORY.JSON'", "false"))


def _extracted(match: str):
    return lambda s, d: exports.extract(exports.members(export_archives(s, d)), match).select("archive", "filename", "content_type", "size_bytes", F.md5("content").alias("content_md5"))


_KIND = "CASE WHEN filename = 'subscriptions.csv' THEN 'text/csv' ELSE 'application/json' END AS content_type"
_add("export_extract", _extracted("first"), f"WITH {_X} SELECT user_id || '.zip' AS archive, filename, {_KIND}, strlen(content) AS size_bytes, md5(content) AS content_md5 FROM f")
_add("export_extract_last", _extracted("last_ci"), f"""WITH {_X}, h AS (SELECT user_id, filename, content FROM f WHERE filename <> 'watch-history.json' UNION ALL SELECT DISTINCT user_id, 'watch-history.json', '[]' FROM events)
SELECT user_id || '.zip' AS archive, filename, {_KIND}, strlen(content) AS size_bytes, md5(content) AS content_md5 FROM h""")


def _read_back(s: SparkSession, d: str) -> DataFrame:
    """Members of the archives with their user and zone."""
    files = exports.extract(exports.members(export_archives(s, d))).withColumn("user_id", F.regexp_extract("archive", r"(\d+)\.zip", 1).cast("long"))
    return files.withColumn("tz", F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (F.col("user_id") % 4 + 1).cast("int")))


def _canon(df: DataFrame) -> DataFrame:
    seen = ["user_id", F.col("seq").cast("int"), "type", "engagement", "ts_utc", "text_raw", "text_clean", "channel", X.channel_id(F.col("channel_url")).alias("channel_id"), "video_id", "language_type"]
    return df.select(*seen, *[c for c in ("ts_local", "date_local", "hour_local", "day_of_week", "month_local", "day_name") if c in df.columns])


for _name, _branch in (("watch", exports.watch_branch), ("search", exports.search_branch), ("subscribe", exports.subscription_branch)):
    _add(f"export_{_name}", lambda s, d, f=_branch: _canon(f(_read_back(s, d))), f"WITH {_X}, {_CANON} SELECT * FROM c WHERE type = '{_name}'")
_LOCAL = "ts_local::DATE AS date_local, hour(ts_local)::INTEGER AS hour_local, (isodow(ts_local) - 1)::INTEGER AS day_of_week, month(ts_local)::INTEGER AS month_local, dayname(ts_local) AS day_name"
_add("export_events", lambda s, d: _canon(exports.events(_read_back(s, d), exports.time_zones(s))[0]), f"WITH {_X}, {_CANON} SELECT *, {_LOCAL} FROM l")
_add("export_quarantine", lambda s, d: exports.events(_read_back(s, d), exports.time_zones(s))[1].select("user_id", "tz"), "SELECT DISTINCT user_id, 'Mars/X' AS tz FROM events WHERE user_id % 4 = 3")
_add("export_stats", lambda s, d: exports.stats(exports.events(_read_back(s, d), exports.time_zones(s))[0]), f"""WITH {_X}, {_CANON} SELECT user_id, count(*) FILTER (type = 'watch') AS total_watch, count(*) FILTER (type = 'search') AS total_search, count(*) FILTER (type = 'subscribe') AS total_subscribe, count(*) AS total_events,
 count(*) FILTER (language_type = 'english') AS english, 0::BIGINT AS hindi, 0::BIGINT AS hinglish, 0::BIGINT AS unknown FROM l GROUP BY user_id""")
_add("export_preview", lambda s, d: exports.preview(_read_back(s, d)).select("archive", "filename", F.col("total").cast("long").alias("total"), "has_more", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("shown"), F.md5(F.element_at("rows", -1)).alias("last_md5")), f"""WITH {_X},
p AS (SELECT *, CASE WHEN filename = 'subscriptions.csv' THEN '{{"Channel Id":"UC' || k || '","Channel Url":"https://www.example.com/channel/UC' || k || '","Channel Title":"' || CASE WHEN k < 50 THEN '' ELSE 'The \\"' || k || '\\", live' END || '"}}' ELSE item END AS shown FROM i WHERE seq < 50)
SELECT f.user_id || '.zip' AS archive, f.filename, f.n AS total, f.n > 50 AS has_more, CASE WHEN f.filename = 'subscriptions.csv' THEN 'Channel Id|Channel Url|Channel Title' END AS headers, least(f.n, 50) AS shown, l.m AS last_md5 FROM f JOIN (SELECT user_id, filename, md5(arg_max(shown, seq)) AS m FROM p GROUP BY ALL) l USING (user_id, filename)""")


def _clocks(s: SparkSession, d: str) -> DataFrame:
    """Times as texts in five shapes, by kind of event, read leniently and told in the user's zone."""
    e = _read(s, d, "events")
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.concat(second, F.date_format("ts", ".SSSSSS"))
    text = F.when(F.col("event_type") == "view", F.concat(micros, F.lit("Z"))).when(F.col("event_type") == "click", F.concat(second, F.lit("Z"))).when(F.col("event_type") == "purchase", micros).when(F.col("event_type") == "signup", F.replace(second, F.lit("T"), F.lit(" "))).otherwise(F.concat(F.lit("at "), second))
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES[:3]]), (F.col("user_id") % 3 + 1).cast("int"))
    out = exports.local_info(e.select("event_id", zone.alias("tz"), exports.lenient_time(text).alias("ts_utc"), exports.parse_time(text).isNull().alias("odd")))
    return out.select("event_id", "odd", "timestamp_local", "hour_local", "day_of_week", "day_name", "date_text")


_add("local_times", _clocks, """WITH t AS (SELECT *, CASE WHEN event_type IN ('view', 'purchase') THEN ts WHEN event_type <> 'error' THEN date_trunc('second', ts) END + to_minutes([0, 330, -300][user_id % 3 + 1]) AS l FROM events)
SELECT event_id, event_type IN ('signup', 'error') AS odd, strftime(l, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(l) % 1000000 <> 0 THEN strftime(l, '.%f') ELSE '' END || ['+00:00', '+05:30', '-05:00'][user_id % 3 + 1] AS timestamp_local, hour(l)::INTEGER AS hour_local, (isodow(l) - 1)::INTEGER AS day_of_week, dayname(l) AS day_name, strftime(l, '%Y-%m-%d') AS date_text FROM t""")

# Stores: tables are written, changed and read again in the shared folder.


def _stored_events(s: SparkSession, d: str) -> DataFrame:
    """Events of the users with a subscription to channel 7, from a store of all events."""
    path, e = shared_dir(s), history(s, d)
    store.write_events(e, path)
    return store.read_events(s, path, e.filter("type = 'subscribe' and channel_clean = 'channel 7'")).groupBy("user_id", "type").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


_add("store_events", _stored_events, f"WITH {_E} SELECT user_id, type, count(*) AS n, sum(seq)::BIGINT AS s FROM e WHERE user_id IN (SELECT user_id FROM e WHERE type = 'subscribe' AND channel_clean = 'channel 7') GROUP BY ALL")


def _raw_store(s: SparkSession, d: str) -> str:
    """Raw members of all users in a new store; a session was made when the user's last event happened."""
    path = shared_dir(s)
    made = _read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("created_at"))
    files = _read_back(s, d).join(made, "user_id").select(F.col("user_id").alias("token"), "filename", "content_type", "content", "size_bytes", F.col("tz").alias("timezone"), "created_at")
    store.write_files(files, path)
    return path


def _file_rows(s: SparkSession, path: str) -> DataFrame:
    return store.read_files(s, path).select("token", "filename", F.md5("content").alias("content_md5"))


_FILE_SQL = "SELECT user_id AS token, filename, md5(content) AS content_md5 FROM f"
_add("store_files", lambda s, d: _file_rows(s, _raw_store(s, d)), f"WITH {_X} {_FILE_SQL}")
_add("session_list", lambda s, d: store.sessions(store.read_files(s, _raw_store(s, d))).withColumn("files", F.array_join("files", "|")), f"""WITH {_X} SELECT user_id AS token, files, ['UTC', 'Asia/Kolkata', 'America/New_York', 'Mars/X'][user_id % 4 + 1] AS timezone, created_at FROM (SELECT user_id, string_agg(filename, '|' ORDER BY filename) AS files FROM f GROUP BY 1) JOIN (SELECT user_id, max(ts) AS created_at FROM events GROUP BY 1) USING (user_id)""")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    """The store without the users that have clicked on channel 7."""
    path = _raw_store(s, d)
    store.delete(s, path, history(s, d).filter("engagement = 'passive' and channel_clean = 'channel 7'").select(F.col("user_id").alias("token")), "token")
    return _file_rows(s, path)


def _expired(s: SparkSession, d: str) -> DataFrame:
    """The store when its last session is a day old: sessions older than that are gone."""
    path = _raw_store(s, d)
    now = _read(s, d, "events").agg(F.max("ts")).first()[0]
    store.expire(s, path, now, max_age_hours=6)
    return _file_rows(s, path)


_add("store_delete", _deleted, f"WITH {_X}, {_E} {_FILE_SQL} WHERE user_id NOT IN (SELECT user_id FROM e WHERE engagement = 'passive' AND channel_clean = 'channel 7')")
_add("store_expire", _expired, f"WITH {_X} {_FILE_SQL} WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR)")


# The whole report, compared value by value, over groups of ten users with a language for each text.

_PARTS = {
    "summary.totals": "summary", "channels.top": "top_channels", "channels.engagement": "engagement_summary", "channels.buckets": "view_count_buckets", "watch_patterns.hours": "hour_histogram", "watch_patterns.weekdays": "weekday_histogram",
    "watch_patterns.peaks": "peaks", "watch_patterns.intervals": "time_intervals", "watch_patterns.weeks": "weekly_peak_day", "watch_patterns.best_day": "overall_peak_day", "searches.top": "search_analytics",
    "subscription_overlap.counts": "subscription_overlap", "subscription_overlap.names": "overlap_names", "behavior_anomalies.list": "anomalies", "behavior_anomalies.baseline": "daily_baseline", "behavior_anomalies.late_nights": "late_night_days",
    "behavior_anomalies.binge_days": "binge_days", "behavior_anomalies.unusual_weeks": "unusual_weeks", "behavior_anomalies.moods": "late_night_moods", "behavior_anomalies.rhythm": "rhythm", "habit_formation.channels": "channel_habits",
    "habit_formation.videos": "rewatched_titles", "habit_formation.strength": "habit_strength", "temporal_trends.months": "monthly_stats", "temporal_trends.shifts": "pattern_shifts", "temporal_trends.summary": "trend_summary",
    "time_spent.totals": "time_spent", "channel_distribution.buckets": "view_count_buckets", "channel_distribution.months": "month_by_bin", "channel_distribution.stats": "distribution_stats",
}


def _tens(s: SparkSession, d: str) -> DataFrame:
    return described(s, d).withColumn("user_id", F.expr("user_id div 10"))


def _rebound(name: str) -> str:
    """The SQL of another query over the groups of ten."""
    sql = ORACLES[name]
    for old in (_E, _P, _home(5), _home(50)):
        sql = sql.replace(old, _home(10))
    return re.sub(r"\btitle\b", "channel_clean", sql) if name == "card_rewatched" else sql  # order lines have titles of their own


def _fields(part: str, sql: str) -> str:
    key = reports.ORDER.get(part, ())
    place = f"concat_ws('|', {', '.join(f'x.{k}' for k in key)})" if key else "''"
    drop = f"EXCLUDE ({', '.join(('user_id', *key))})"
    return f"""SELECT user_id, '{part}' AS part, place, field, CASE WHEN json_type(v) = 'DOUBLE' THEN round(v::DOUBLE * 1000)::BIGINT::VARCHAR ELSE v->>'$' END AS value
FROM (SELECT user_id, place, field, json_extract(j, '$."' || field || '"') AS v FROM (SELECT user_id, place, j, unnest(json_keys(j)) AS field FROM (SELECT x.user_id, {place} AS place, (SELECT to_json(y) FROM (SELECT x.* {drop}) y) AS j FROM ({sql}) x))) WHERE json_type(v) <> 'NULL'"""


_add("full_report", lambda s, d: reports.report_rows(reports.full_report(_tens(s, d))), " UNION ALL ".join(_fields(k, _rebound(v)) for k, v in _PARTS.items()))


def _documents(s: SparkSession, d: str) -> DataFrame:
    """How many rows each part of a user's document has, read back from the document."""
    docs = reports.report_documents(reports.full_report(_tens(s, d)))
    return docs.select("user_id", F.explode(F.from_json("report", "map<string, array<string>>")).alias("part", "rows")).select("user_id", "part", F.size("rows").cast("long").alias("n"))


_add("report_documents", _documents, " UNION ALL ".join(f"SELECT user_id, '{k}' AS part, count(*) AS n FROM ({_rebound(v)}) GROUP BY 1" for k, v in _PARTS.items()))

# Bars: values by the largest of their group.

_add("bucket_bars", _orders(lambda w: activity.share_of_max(activity.view_count_buckets(w), "channels")), f"SELECT *, channels / nullif(max(channels) OVER (PARTITION BY user_id), 0) AS share_of_max FROM ({ORACLES['view_count_buckets']})")
_add("month_bars", _orders(lambda w: activity.share_of_max(activity.monthly_stats(w).select("user_id", "month", "watches"), "watches")), f"SELECT user_id, month, watches, watches / max(watches) OVER (PARTITION BY user_id) AS share_of_max FROM ({ORACLES['monthly_stats']})")
_add("bin_bars", _orders(lambda w: activity.share_of_max(activity.last_months(activity.month_by_bin(w)), "n", ("user_id", "month"))), f"""SELECT * EXCLUDE (k), n / nullif(max(n) OVER (PARTITION BY user_id, month), 0) AS share_of_max
FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY month DESC) AS k FROM ({ORACLES['month_by_bin']})) WHERE k <= 12""")


# The document of all cards, read back.

_CARD = {
    "stats.watches": "card_stats.watches", "stats.channels": "card_stats.channels", "stats.days": "card_stats.days", "stats.sessions": "card_stats.sessions", "time.hours": "card_time_spent.hours", "time.daily_minutes": "card_time_spent.daily_minutes",
    "peak_month.month": "card_peak_month.month", "top_channel.name": "card_top_channel.name", "top_channel.n": "card_top_channel.n", "streak.days": "longest_streak.days", "streak.label": "longest_streak.label", "binge.binges": "card_binge_sessions.binges",
    "late_night.n": "card_late_night.n", "late_night.latest": "card_late_night.latest", "rewatched.titles": "card_rewatched.titles", "rewatched.top": "card_rewatched.top", "subscriptions.subscribed": "subscription_overlap.subscribed",
    "subscriptions.ghost": "subscription_overlap.ghost", "first_last.first_title": "card_first_last.first_title", "first_last.last_date": "card_first_last.last_date", "watch_cycle.hour": "card_watch_cycle.hour", "peak_weekday.day": "card_peak_weekday.day",
}
_LISTS = {"top_channels": ("card_top_channels", "name"), "habits": ("card_habits", "name"), "patterns": ("card_patterns", "insight"), "searches": ("card_searches", "term")}


def _card_values(s: SparkSession, d: str) -> DataFrame:
    """Fields and lists of each user's document as rows. Lists are read whole: a path with ``[*]`` gives a single match without its brackets."""
    docs = cards.card_document(_tens(s, d), 2024)
    single = F.array(*[F.struct(F.lit(k).alias("field"), F.get_json_object("cards", f"$.{k}").alias("value")) for k in ("year", "metadata.version", "metadata.total_events", "metadata.total_watch", *_CARD)])
    many = F.array(*[F.struct(F.lit(f"{k}.{c}").alias("field"), F.array_join(F.from_json(F.get_json_object("cards", f"$.{k}"), f"array<struct<{c}: string>>")[c], "|").alias("value")) for k, (_, c) in _LISTS.items()])
    listed = F.transform(many, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value")))
    return docs.select("user_id", F.inline(F.concat(single, listed))).filter(F.col("value").isNotNull())


def _card_sql() -> str:
    decimal = ("time.hours", "time.daily_minutes")
    ones = []
    for field, at in _CARD.items():
        name, column = at.split(".")
        value = f"{column}::DOUBLE::VARCHAR" if field in decimal else f"{column}::VARCHAR"
        ones.append(f"SELECT DISTINCT user_id, '{field}' AS field, {value} AS value FROM ({_rebound(name)})")
    lists = [f"SELECT user_id, '{k}.{c}' AS field, string_agg({c}, '|' ORDER BY rank) AS value FROM ({_rebound(name)}) GROUP BY 1" for k, (name, c) in _LISTS.items()]
    totals = f"t AS (WITH {_home(10)} SELECT user_id, count(*) AS n, count(*) FILTER (type = 'watch') AS w FROM e GROUP BY 1)"
    meta = [f"SELECT user_id, '{f}' AS field, {v}::VARCHAR AS value FROM t" for f, v in (("year", "2024"), ("metadata.version", "'1.0'"), ("metadata.total_events", "n"), ("metadata.total_watch", "w"))]
    return f"WITH {totals} SELECT * FROM ({' UNION ALL '.join([*ones, *lists, *meta])}) WHERE value IS NOT NULL"


_add("card_document", _card_values, _card_sql())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
