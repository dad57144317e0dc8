"""Sources, streams, joins, stores and the SQL surface: brute force, plans, and what happens between two runs."""

import contextlib
import datetime as dt
import io
import itertools
import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from watchloom import sql
from watchloom.functions.clock import micros, zoneless
from watchloom.operators import activity, asof, cards, intervals, payloads, sessions, sketches
from watchloom.plans import cube, reports
from watchloom.sources import datasource, exports, versions
from watchloom.streaming import stateful, windows

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "user_id long, seq long, type string, engagement string, ts timestamp_ntz, channel string, channel_clean string, text_raw string, text_clean string"


def watch_rows(rows):
    return [(u, k, "watch", "active", m if m is None or isinstance(m, dt.datetime) else T0 + dt.timedelta(minutes=m), c, c and c.lower(), c, c and c.lower()) for k, (u, m, c) in enumerate(rows)]


def events(spark, rows):
    """rows of (user, minutes after T0 or a time, channel)."""
    return spark.createDataFrame(watch_rows(rows), SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def zone(spark, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", name)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# ---- two clocks


@pytest.mark.parametrize("name", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_gaps_do_not_depend_on_the_session(spark, name):
    """Around the night in which New York's clocks go forward, 01:30 and 03:00 are 90 minutes apart in a zoneless table."""
    with zone(spark, name):
        e = events(spark, [(1, dt.datetime(2024, 3, 10, 1, 30), "a"), (1, dt.datetime(2024, 3, 10, 3, 0), "a"), (1, dt.datetime(2024, 3, 10, 3, 0, 0, 250_000), "a")])
        got = [(r.session, r.events, round(r.minutes, 6)) for r in sessions.sessionise(e).orderBy("session").collect()]
        assert got == [(0, 1, 5.0), (1, 2, round(5 + 0.25 / 60, 6))]
        us = e.select(micros(e, "ts").alias("us")).withColumn("back", zoneless(F.col("us"))).collect()
        assert [r.back for r in us] == [r.ts for r in e.select("ts").collect()]
        parsed = spark.createDataFrame([("2024-03-10T02:30:00.5Z",), ("2024-03-10T02:30:00",), ("x",)], "t string").select(exports.parse_time(F.col("t")).alias("p")).collect()
        assert [r.p for r in parsed] == [dt.datetime(2024, 3, 10, 2, 30, 0, 500_000), dt.datetime(2024, 3, 10, 2, 30), None]


@pytest.mark.parametrize("name", ["UTC", "America/New_York"])
def test_instants_make_sessions_and_wall_clocks_dates(spark, name):
    """Clocks go back in New York at 06:00 UTC: 05:30 and 06:40 UTC are 01:30 and 01:40 there, but 70 minutes apart."""
    rows = [(1, 0, dt.datetime(2025, 11, 2, 5, 30)), (1, 1, dt.datetime(2025, 11, 2, 6, 40)), (1, 2, dt.datetime(2025, 11, 2, 4, 59, 59))]
    with zone(spark, name):
        e = spark.createDataFrame(rows, "user_id long, seq long, ts_utc timestamp_ntz").withColumn("tz", F.lit("America/New_York"))
        local = exports.report_events(exports.local_columns(e)).withColumns({"channel_clean": F.lit("c"), "channel": F.lit("C"), "text_clean": F.concat(F.lit("t"), "seq")})
        got = [(r.session, r.start_ts, r.end_ts, r.events) for r in sessions.sessionise(local).orderBy("session").collect()]
        day = dt.datetime(2025, 11, 2)
        assert got == [(0, day.replace(minute=59, second=59), day.replace(hour=1, minute=30), 2), (1, day.replace(hour=1, minute=40), day.replace(hour=1, minute=40), 1)]
        assert sessions.time_spent(local).first().days == 1 and cards.stats_overview(local).first().sessions == 2
        late = cards.late_night(local).first()
        assert (late.n, late.latest_ts) == (3, day.replace(hour=1, minute=40))
        ends = cards.first_and_last(local).first()
        assert (ends.first_title, ends.last_title) == ("t2", "t1")


@pytest.mark.parametrize("name", ["UTC", "America/New_York"])
def test_offsets_do_not_depend_on_the_session(spark, name):
    rows = [(dt.datetime(2025, 3, 9, 7, 30), "UTC"), (dt.datetime(2025, 3, 9, 7, 30), "America/New_York"), (dt.datetime(2025, 11, 2, 5, 30), "America/New_York"), (dt.datetime(2025, 11, 2, 6, 30), "America/New_York"), (dt.datetime(2025, 1, 1), "Asia/Kolkata")]
    with zone(spark, name):
        got = [r.timestamp_local for r in exports.local_info(spark.createDataFrame(rows, "ts_utc timestamp_ntz, tz string")).collect()]
    assert got == ["2025-03-09T07:30:00+00:00", "2025-03-09T03:30:00-04:00", "2025-11-02T01:30:00-04:00", "2025-11-02T01:30:00-05:00", "2025-01-01T05:30:00+05:30"]


def test_common_zones(spark, tmp_path):
    (tmp_path / "zone.tab").write_text("# comment\nIN\t+2232+08822\tAsia/Kolkata\nFR\t+4852+00220\tEurope/Paris\tnote\nXX\t+0+0\tMars/X\n")
    found = [r.tz for r in exports.time_zones(spark, True, str(tmp_path / "zone.tab")).collect()]
    assert found == sorted([*exports.COMMON, "Asia/Kolkata", "Europe/Paris"])
    everything = {r.tz for r in exports.time_zones(spark).collect()}
    wide = {r.tz for r in exports.time_zones(spark, True).collect()}
    assert set(found) <= wide <= everything and "Mars/X" not in everything


# ---- exports


def packed(entries, name="x/watch-history.json"):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("readme.html", "hello")
        z.writestr(name, json.dumps(entries))
        z.writestr("x/subscriptions.csv", 'Channel Id,Channel Url,Channel Title\nUC1,u,"A, ""b"""\nUC2,v,\n')
    return body.getvalue()


def watched(title, minute):
    return {"title": f"Watched {title}", "titleUrl": "https://x/watch?v=abcdefghijk", "time": (T0 + dt.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ"), "subtitles": [{"name": "Chan", "url": "https://x/channel/UC1"}]}


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.zip").write_bytes(packed([watched(f"v{k}", k), watched("again", 90 + k)]))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("no archive either")
    return tmp_path


def test_source_reads_each_archive_once(spark, folder, monkeypatch):
    datasource.register(spark)
    opened = []
    plain = zipfile.ZipFile
    monkeypatch.setattr(datasource.zipfile, "ZipFile", lambda body, *a: opened.append(1) or plain(body, *a))
    reader = datasource.ExportReader({"path": str(folder), "partitionBytes": "700"})
    parts = reader.partitions()
    assert sum(len(p.paths) for p in parts) == 6 and len(parts) > 2
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(opened) == 6 and len(rows) == 18
    assert {(r["filename"], r["missing"]) for r in rows if r["error"] is None} == {("watch-history.json", False), ("search-history.json", True), ("subscriptions.csv", False)}
    assert {r["error"] for r in rows if r["archive"].endswith("broken.zip")} == {"BadZipFile"}
    df = spark.read.format(datasource.FORMAT).option("path", str(folder)).load()
    assert df.filter("filename = 'subscriptions.csv' and not missing").count() == 5
    assert df.filter(F.col("archive") == f"{folder}/3.zip").count() == 3


def test_source_narrows_what_it_reads(folder):
    reader = datasource.ExportReader({"path": str(folder)})
    other = datasource.EqualTo(("members",), 3)
    left = list(reader.pushFilters([datasource.In(("filename",), ("subscriptions.csv", "nothing")), datasource.EqualTo(("archive",), f"{folder}/2.zip"), other]))
    assert left == [other] and reader.targets == ["subscriptions.csv"]
    assert [p.paths for p in reader.partitions()] == [[f"{folder}/2.zip"]]
    nothing = datasource.ExportReader({"path": str(folder)})
    list(nothing.pushFilters([datasource.EqualTo(("filename",), "nothing")]))
    assert [p.paths for p in nothing.partitions()] == [[]]
    with pytest.raises(ValueError, match="match"):
        datasource.ExportReader({"path": str(folder), "match": "any"})
    assert datasource.ExportReader({"path": str(folder / "none")}).partitions()[0].paths == []


def test_stream_finds_archives_that_come_later(spark, folder, tmp_path_factory):
    datasource.register(spark)
    out, state = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("state"))
    stream = datasource.files(spark.readStream.format(datasource.FORMAT).option("path", str(folder)).load()).select("user_id", "filename")
    seen = lambda: sorted({r.user_id for r in stateful.appended(spark, out, stream.schema).collect()})
    stateful.append_to(stream, out, state)
    assert seen() == ["0", "1", "2", "3", "4"]
    (folder / "5.zip").write_bytes(packed([watched("new", 1)]))
    moved = folder / "6.zip"
    moved.write_bytes(packed([watched("moved", 1)]))
    os.utime(moved, ns=(os.stat(folder / "0.zip").st_mtime_ns - 10**9,) * 2)  # changed before the first run, moved in after it
    stateful.append_to(stream, out, state)
    stateful.append_to(stream, out, state)
    assert seen() == ["0", "1", "2", "3", "4", "5", "6"]
    assert stateful.appended(spark, out, stream.schema).count() == 14


def test_sink_shows_archives_at_the_commit(spark, tmp_path):
    datasource.register(spark)
    rows = spark.createDataFrame([(f"u{k}.zip", [("watch-history.json", json.dumps([watched("a", k)]))]) for k in range(4)], "archive string, files array<struct<filename string, content string>>")
    rows.repartition(2).write.format(datasource.FORMAT).mode("append").option("path", str(tmp_path)).save()
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"u{k}.zip" for k in range(4)]
    writer = datasource.ExportWriter({"path": str(tmp_path)})
    broken = writer.write(iter(rows.withColumn("archive", F.concat(F.lit("z"), "archive")).collect()))
    assert len(broken.names) == 4 and len(datasource._listed(str(tmp_path))) == 4  # nobody sees what is not committed
    writer.abort([broken, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"u{k}.zip" for k in range(4)]
    with pytest.raises(Exception, match="append"):
        rows.write.format(datasource.FORMAT).mode("overwrite").option("path", str(tmp_path)).save()


def test_from_archive_to_report(spark, folder):
    datasource.register(spark)
    files = datasource.files(spark.read.format(datasource.FORMAT).option("path", str(folder)).load()).withColumn("tz", F.when(F.col("user_id") == "4", "Mars/X").otherwise("Asia/Kolkata"))
    found, bad = exports.events(files, exports.time_zones(spark))
    assert len(re.findall("BatchScan|PythonDataSource", plan(found).split("Initial Plan")[0])) <= 2 and "Union" not in plan(found)
    assert [(r.user_id, r.tz) for r in bad.collect()] == [("4", "Mars/X")]
    told = exports.report_events(found)
    summary = {r.user_id: (r.watches, r.subscriptions, r.channels, r.first_ts) for r in activity.summary(told).collect()}
    assert summary == {str(k): (2, 2, 1, T0 + dt.timedelta(hours=5, minutes=30 + k)) for k in range(4)}
    assert {r.user_id: r.sessions for r in sessions.time_spent(activity.watches(told)).collect()} == {str(k): 2 for k in range(4)}
    names = {r.channel for r in found.filter("type = 'subscribe'").collect()}
    assert names == {'A, "b"', "UC2"}
    docs = {r.user_id: json.loads(r.cards) for r in cards.card_document(told, 2024).collect()}
    assert docs["0"]["metadata"] == {"version": "1.0", "total_events": 4, "total_watch": 2} and docs["0"]["stats"]["sessions"] == 2


# ---- streams


def test_session_state_is_bounded(spark, tmp_path):
    """Many triggers of a stream in which each user's session goes on for a while: open sessions are all that is kept."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    schema = events(spark, []).schema
    held, every = [], []
    for k in range(8):
        rows = [(u, k * 240 + m, "c") for u in range(20) for m in (0, 30, 55)]
        every += rows
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = stateful.closing_sessions(spark.readStream.schema(schema).parquet(str(source)), 60, "30 minutes")
        query = stateful.append_to(stream, out, state)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held[1:]) <= 20, held  # one row a user, whatever came before
    got = sorted((r.user_id, r.start_ts, r.events) for r in stateful.appended(spark, out, stream.schema).collect())
    batch = sorted((r.user_id, r.start_ts, r.events) for r in sessions.sessionise(events(spark, every)).collect())
    closed = [b for b in batch if b[1] < T0 + dt.timedelta(minutes=7 * 240)]
    assert got == closed
    assert sorted((r.user_id, r.start_ts, r.events) for r in stateful.open_sessions(spark, state).collect()) == [b for b in batch if b not in closed]


def test_late_rows_of_sessions(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = events(spark, []).schema

    def run(rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.closing_sessions(spark.readStream.schema(schema).parquet(source), 60, "2 hours")
        stateful.append_to(stream, out, state)
        return sorted((r.user_id, r.start_ts, r.end_ts, r.events) for r in stateful.appended(spark, out, stream.schema).collect())

    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert run([(1, 0, "c"), (1, 100, "c")]) == []
    assert run([(1, 50, "c"), (1, None, "c")]) == []  # out of order: joins the two sessions
    assert run([(2, 400, "c")]) == [(1, at(0), at(100), 3)]  # the watermark is at 280
    assert run([(1, 90, "c"), (2, 380, "c")]) == [(1, at(0), at(100), 3)]  # too late; and in time
    assert run([(3, 1000, "c")])[1:] == [(2, at(380), at(400), 2)]


def test_merging_sessions():
    r = random.Random(3)
    for _ in range(50):
        times = [r.randrange(400) for _ in range(r.randrange(1, 30))]
        held = []
        for k in range(0, len(times), 3):
            held = stateful.merged(held, times[k : k + 3], 10)
        assert held == stateful.merged([], times, 10)
        closed, still = stateful.split_closed(held, 200, 10)
        assert all(s[1] + 10 < 200 for s in closed) and all(s[1] + 10 >= 200 for s in still) and sorted(closed + still) == held


def test_windows_with_late_and_repeated_files(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    channels = spark.createDataFrame([("a", "x"), ("b", "y")], "channel_clean string, kind string")

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = windows.window_report(spark.readStream.schema(rows.schema).parquet(source), channels, "1 hour", late="30 minutes", by=("kind",))
        stateful.append_to(stream, out, state)
        return sorted((r.window_start.hour, r.kind or "", r.watches) for r in stateful.appended(spark, out, stream.schema).collect())

    first = events(spark, [(1, 0, "a"), (1, 10, "b"), (2, 20, "zz"), (2, 70, "a")])
    assert run(first) == []  # the watermark is at 12:40
    assert run(first) == []  # the whole file again
    more = events(spark, [(5, 15, "a"), (5, 58, "a"), (5, 95, "a")]).withColumn("seq", F.col("seq") + 100)
    got = run(more)  # 12:15 is too late, 12:58 is not; the watermark is at 13:05
    assert got == [(12, "", 1), (12, "x", 2), (12, "y", 1)]
    assert run(events(spark, [(6, 30, "a"), (6, 400, "a")]).withColumn("seq", F.col("seq") + 200)) == [*got, (13, "x", 2)]
    batch = windows.window_report(first.unionByName(first), channels, "1 hour", by=("kind",)).collect()
    assert sum(r.watches for r in batch) == 4
    sliding = windows.window_report(first, size="2 hours", slide="1 hour").collect()
    assert sum(r.watches for r in sliding) == 8


# ---- joins


def test_asof_is_brute_force(spark):
    r = random.Random(7)
    hot = [("h", r.randrange(2000)) for _ in range(300)]
    rows = [(k, key, at) for k, (key, at) in enumerate([*hot, *((r.choice("abc"), r.randrange(2000)) for _ in range(100)), ("none", 5), (None, 5), ("a", None)])]
    vers = sorted({("h", r.randrange(0, 2000, 7)) for _ in range(60)} | {(r.choice("ab"), r.randrange(2000)) for _ in range(40)})
    vers = [(key, at, f"{key}{at}") for key, at in vers] + [(None, 1, "n"), ("a", None, "n")]
    time = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    left = spark.createDataFrame([(k, key, time(at)) for k, key, at in rows], "id long, key string, at timestamp_ntz")
    right = spark.createDataFrame([(key, time(at), v) for key, at, v in vers], "key string, since timestamp_ntz, v string")

    def brute(key, at, tolerance=None):
        own = [x for x in vers if key is not None and at is not None and x[0] == key and x[1] is not None and x[1] <= at and (tolerance is None or (at - x[1]) * 60 <= tolerance)]
        return max(own, key=lambda x: x[1])[2] if own else None

    for tolerance, slices in ((None, None), (None, "90 minutes"), (3600, None), (3600, "5 hours")):
        got = {x.id: x.v for x in asof.asof_join(left, right, ["key"], "at", "since", tolerance, slices).collect()}
        assert got == {k: brute(key, at, tolerance) for k, key, at in rows}, (tolerance, slices)
    one = asof.asof_join(left, right, ["key"], "at", "since")
    assert plan(one).count("Exchange hashpartitioning") == 1 and "Join" not in plan(one)
    twice = spark.createDataFrame([("a", T0, 1, "x"), ("a", T0, 2, "y")], "key string, since timestamp_ntz, n long, v string")
    assert [(x.n, x.v) for x in asof.latest(twice, ["key"], "since", "n").collect()] == [(2, "y")]


def test_a_hot_key_is_cut_into_slices(spark):
    """All rows have one key, and yet no task of the sliced join has more than a few of them."""
    left = spark.range(4000).select(F.lit("k").alias("key"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"))
    right = left.withColumnRenamed("at", "since").filter(F.minute("since") == 0).withColumn("v", F.col("since").cast("string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof.asof_join(left, right, ["key"], "at", "since", slices="2 hours")
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 3000 and len(sizes) > 1
    assert out.filter(F.col("v").isNull()).count() == 0


def spans(r, n):
    return [(k, r.choice("ab"), s, s + r.choice((0, 1, 5, 40, 3000))) for k, s in ((k, r.randrange(4000)) for k in range(n))]


def test_overlaps_are_brute_force(spark):
    r = random.Random(5)
    a, b = spans(r, 150), [*spans(r, 150), (900, "a", 50, 40), (901, "a", None, 40), (902, None, 1, 2)]
    frame = lambda rows: spark.createDataFrame([(k, key, s if s is None else T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=e)) for k, key, s, e in rows], "id long, key string, s timestamp_ntz, e timestamp_ntz")
    out = intervals.overlap_join(frame(a), frame(b), ["key"], ("s", "e"), ("s", "e"), 600)
    got = [(x.a.id, x.b.id) for x in out.collect()]
    expect = {(x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and y[2] is not None and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]}
    assert sorted(got) == sorted(expect)
    assert "Cartesian" not in plan(out) and "NestedLoop" not in plan(out)
    assert not intervals.overlap_join(frame(a), frame([]), ["key"], ("s", "e"), ("s", "e")).collect()


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_concurrency_is_brute_force(spark, keys):
    rows = spans(random.Random(9), 120)
    df = spark.createDataFrame([(k, key, T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=e)) for k, key, s, e in rows], "id long, key string, s timestamp_ntz, e timestamp_ntz")
    got = {(x.key if keys else None, x.slice_start): (x.peak, x.peak_ts) for x in intervals.concurrency(df, "s", "e", keys).collect()}
    for group in ["a", "b"] if keys else [None]:
        own = [(T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=e)) for _, key, s, e in rows if group in (None, key)]
        count = lambda t, own=own: sum(s <= t <= e for s, e in own)
        after = dt.timedelta(microseconds=1)
        for start in sorted({x.replace(minute=0) for s, e in own for x in (s, e + after)}):
            start = start.replace(second=0, microsecond=0)
            inside = [start, *(x for s, e in own for x in (s, e + after) if start <= x < start + dt.timedelta(hours=1))]
            before = count(start - after) - sum(e == start - after for _, e in own)
            best = max([count(x) for x in inside[1:]] + [before])
            assert got[group, start][0] == best, (group, start)
    assert all(p >= 0 for p, _ in got.values())


# ---- cube and sketches


def test_cube_is_one_scan(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(4), r.randrange(60 * 24 * 70), r.choice("abc")) for _ in range(500)] + [(1, None, "a")]
    events(spark, rows).write.parquet(str(tmp_path / "t"))
    e = spark.read.parquet(str(tmp_path / "t"))
    found = cube.activity_cube(e)
    assert plan(found).split("Initial Plan")[0].count("FileScan") == 1
    hours = {(x.user_id, x.hour): (x.n, x.of_max) for x in activity.hour_histogram(e).collect()}
    assert {(x.user_id, x.hour): (x.n, x.share) for x in cube.filled(found, "hour", 24).collect()} == hours
    assert cube.level(found, "all").first().n == 500
    months = {(x.user_id, x.month): x.watches for x in activity.monthly_stats(e).collect()}
    assert {(x.user_id, x.month): x.n for x in cube.level(found, "user_month").collect()} == months
    assert not cube.activity_cube(events(spark, [])).filter("level <> 'all'").collect()


def test_sketches_of_many_values(spark):
    """More values than a sketch holds, over many days: every bound is kept, and days merge to what the range has."""
    r = random.Random(8)
    rows = [(u, r.randrange(60 * 24 * 20), f"c{min(int(r.expovariate(0.002)), 5000)}") for u in range(2) for _ in range(6000)]
    e = events(spark, rows)
    days = sketches.daily_sketches(e)
    ends = (dt.date(2024, 1, 3), dt.date(2024, 1, 15))
    good = sketches.within_bounds(sketches.estimates(sketches.merged(days, *ends)), sketches.exact(e, *ends)).collect()
    assert len(good) == 2 and all(x.n_ok and x.channels_ok and x.quantiles_ok and x.top_ok for x in good), good
    wrong = sketches.estimates(sketches.merged(days, *ends)).withColumn("channels", F.col("channels") * 2)
    assert not sketches.within_bounds(wrong, sketches.exact(e, *ends)).first().channels_ok
    assert not sketches.merged(days, dt.date(2030, 1, 1)).collect()


# ---- versions


def test_a_broken_write_is_never_seen(spark, tmp_path, monkeypatch):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    seen = lambda v=None: sorted((r.k, r.v) for r in versions.VersionedTable(spark, str(tmp_path / "t")).read(v).collect())
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.append(rows(*((k, "old") for k in range(20)))) == 1
    reader = table.read()

    def stop(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "_commit", stop)
        with pytest.raises(OSError):
            table.merge(rows((3, "new"), (50, "new")))
    assert seen() == [(k, "old") for k in range(20)]  # files are there, no version names them
    assert table.merge(rows((3, "new"), (50, "new"))) == 2
    assert seen() == sorted([*((k, "old") for k in range(20) if k != 3), (3, "new"), (50, "new")]) and seen(1) == [(k, "old") for k in range(20)]
    assert reader.count() == 20
    untouched = [b for b in table.manifest(1)["files"] if table.manifest(1)["files"][b] == table.manifest(2)["files"].get(b)]
    assert untouched  # buckets without a changed key are named again
    assert table.delete(rows((3, ""), (4, ""))) == 3 and table.delete(rows((999, ""))) in (3, 4)
    assert {k for k, _ in seen()} == {*range(20), 50} - {3, 4}
    assert [r.k for r in table.read(keys=[50, 3]).collect()] == [50]
    table.vacuum(1)
    assert table.versions() == [table.latest()] and {k for k, _ in seen()} == {*range(20), 50} - {3, 4}


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    first = versions.VersionedTable(spark, path, "k", 4)
    first.append(spark.createDataFrame([(1, "a")], "k long, v string"))
    manifest = first.manifest(1)
    second = versions.VersionedTable(spark, path)
    second.append(spark.createDataFrame([(2, "b")], "k long, v string"))
    with pytest.raises(versions.Conflict):
        first._replace(manifest, [0, 1, 2, 3], spark.createDataFrame([(9, "z")], "k long, v string"), "merge")
    assert sorted(r.k for r in first.read().collect()) == [1, 2] and not [n for n in os.listdir(f"{path}/versions") if n.startswith("_")]


def test_merge_counts_and_expiry(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    table.append(spark.createDataFrame([(1, "a", 1, T0), (2, "b", 4, None)], "k long, v string, n long, created_at timestamp_ntz"))
    table.merge(spark.createDataFrame([(2, None, T0), (3, "c", T0)], "k long, v string, created_at timestamp_ntz"), count="n")
    assert sorted((r.k, r.v, r.n) for r in table.read().collect()) == [(1, "a", 1), (2, None, 5), (3, "c", 1)]
    assert table.expire(T0 + dt.timedelta(hours=24)) == 2
    table.expire(T0 + dt.timedelta(hours=25))
    assert table.read().count() == 0


# ---- SQL and variants


def test_sql_surface(spark):
    e = events(spark, [(1, 0, "a"), (1, 30, "b"), (1, 91, "a"), (2, None, "c"), (2, 24 * 60, "c"), (2, 48 * 60, "c"), (2, 48 * 60, "c")])
    sql.install(spark, e)
    got = spark.sql("SELECT * FROM watch_sessions(TABLE(watch_events))")
    assert got.schema["user_id"].dataType == e.schema["user_id"].dataType
    batch = sorted((r.user_id, r.session, r.events, r.minutes) for r in sessions.sessionise(e).collect())
    assert sorted((r.user_id, r.session, r.events, r.minutes) for r in got.collect()) == batch
    assert spark.sql("SELECT * FROM watch_sessions(TABLE(watch_events), gap_minutes => 61, bonus_minutes => 1) WHERE user_id = 1").first().minutes == 92.0
    assert [tuple(r)[2:] for r in spark.sql("SELECT * FROM day_streaks(TABLE(SELECT user_id, date(ts) AS date FROM watch_events), 2)").collect()] == [(dt.date(2024, 1, 3), 2)]
    assert [(r.channel, r.n) for r in spark.sql("SELECT * FROM top_channels_report(1) WHERE user_id = 1").collect()] == [("a", 2)]
    assert spark.sql("SELECT view_bucket(7), view_bucket(0)").first()[:] == ("6-10", None)
    assert {(r.hour, r.percent) for r in spark.sql("SELECT * FROM hour_report() WHERE user_id = 2").collect()} == {(12, 100.0)}
    for text in ("watch_sessions(TABLE(SELECT 1 AS x))", "watch_sessions(TABLE(watch_events), 0)", "day_streaks(TABLE(watch_events), 2)"):
        with pytest.raises(Exception, match="no column|positive"):
            spark.sql(f"SELECT * FROM {text}").collect()


def test_variants_are_parsed_once(spark):
    rows = [(1, '{"microformat":{"playerMicroformatRenderer":{"category":"c","title":{"simpleText":"t"},"description":{"simpleText":"' + "d" * 600 + '"}}},"videoDetails":{"keywords":["a","b"]}}'), (2, '{"microformat":'), (3, None), (4, '{"videoDetails":{"keywords":"no list"}}')]
    pages = spark.createDataFrame([(k, None if j is None else f"<script>var ytInitialPlayerResponse = {j};</script>") for k, j in rows], "page_id long, html string")
    found = payloads.page_fields(pages)
    got = {r.page_id: (r.category, r.title, r.description and len(r.description), r.keywords, r.fault) for r in found.collect()}
    assert got == {1: ("c", "t", 500, ["a", "b"], None), 2: (None, None, None, None, "missing"), 3: (None, None, None, None, "missing"), 4: (None, None, None, None, None)}
    last = plan(found).split("Initial Plan")[0]
    assert len(re.findall(r"parse_json|parseJson", last)) == 1
    odd = payloads.parsed(spark.createDataFrame([("{}",), ("{",), (None,)], "j string"), F.col("j"))
    assert sorted(r.fault or "" for r in odd.collect()) == ["", "malformed", "missing"] and payloads.faults(odd).count() == 2


# ---- reports


def test_report_documents_hold_all_rows(spark):
    e = events(spark, [(1, k * 700, c) for k, c in enumerate("aabacabbbc")] + [(2, 5, "a")])
    report = reports.full_report(e)
    assert {k.split(".")[0] for k in report} == {"summary", "channels", "watch_patterns", "searches", "subscription_overlap", "behavior_anomalies", "habit_formation", "temporal_trends", "time_spent", "channel_distribution"}
    docs = {r.user_id: json.loads(r.report) for r in reports.report_documents(report).collect()}
    assert [x["channel_clean"] for x in docs[1]["channels.top"]] == ["a", "b", "c"] and len(docs[2]["watch_patterns.hours"]) == 24
    rows = reports.report_rows(report)
    assert rows.filter("part = 'summary.totals' and user_id = 1 and field = 'watches'").first().value == "10"
    bars = {r.bucket: r.share_of_max for r in activity.share_of_max(activity.view_count_buckets(e), "channels").filter("user_id = 1").collect()}
    assert bars["2-5"] == 1.0 and bars["1"] == 0.0
    many = spark.createDataFrame([(1, f"2023-{m:02d}") for m in range(1, 13)] + [(1, "2024-01"), (1, "2024-01")], "user_id long, month string")
    assert sorted({r.month for r in activity.last_months(many).collect()})[0] == "2023-02" and activity.last_months(many).count() == 13
