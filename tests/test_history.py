"""Literal rows at the thresholds, raw exports, and invariants."""

import datetime as dt
import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from watchloom import queries
from watchloom.functions import text as X
from watchloom.operators import activity, cards, overlap, sessions, streaks, topics
from watchloom.plans.reports import full_report
from watchloom.sources import exports, store
from watchloom.streaming.sessions import session_stream

T0 = dt.datetime(2024, 1, 1, 12)


def events(spark, rows):
    """rows of (user, minutes after T0, channel)."""
    full = [(u, k, "watch", "active", T0 + dt.timedelta(minutes=m), c, c and c.lower(), c, c and c.lower()) for k, (u, m, c) in enumerate(rows)]
    return spark.createDataFrame(full, "user_id long, seq long, type string, engagement string, ts timestamp_ntz, channel string, channel_clean string, text_raw string, text_clean string")


def test_session_gap_and_bonus(spark):
    e = events(spark, [(1, 0, "a"), (1, 60, "a"), (1, 120 + 1 / 60, "a"), (2, 0, "b"), (2, 115 / 2, "b"), (2, 115, "b")])
    got = {(r.user_id, r.session): (r.events, round(r.minutes, 4)) for r in sessions.sessionise(e).collect()}
    assert got == {(1, 0): (2, 65.0), (1, 1): (1, 5.0), (2, 0): (3, 120.0)}
    assert {r.user_id: (r.binges, r.longest, r.longest_day) for r in sessions.binge_sessions(e).collect()} == {1: (0, "0h 0m", ""), 2: (1, "2h 0m", "January 01")}
    batch = {(r.user_id, r.start_ts, r.end_ts, r.events) for r in sessions.sessionise(e).collect()}
    assert batch == {(r.user_id, r.start_ts, r.end_ts, r.events) for r in session_stream(e).collect()}


def test_buckets_and_ties(spark):
    e = events(spark, [(1, k, c) for k, c in enumerate("bbaac")])
    top = [(r.channel_clean, r.n) for r in activity.top_values(e, "channel_clean", "channel").orderBy("rank").collect()]
    assert top == [("b", 2), ("a", 2), ("c", 1)]
    filled = {r.bucket: r.channels for r in activity.view_count_buckets(e).collect()}
    assert filled["1"] == 1 and filled["2-5"] == 2 and sum(filled.values()) == 3 and len(filled) == 7
    edges = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 10, 11, 20, 21, 50, 51, 100, 101)], "n long")
    assert [r[0] for r in edges.select(activity.bucket(F.col("n"))).collect()] == ["1", "2-5", "2-5", "6-10", "6-10", "11-20", "11-20", "21-50", "21-50", "51-100", "51-100", "100+"]
    hours = activity.hour_histogram(e)
    assert hours.agg(F.sum("n")).first()[0] == 5 and hours.count() == 24


def test_chains(spark):
    day = 24 * 60
    e = events(spark, [(1, d * day, "a") for d in (0, 1, 2, 4, 7, 11)])
    runs = streaks.streaks(e, ["user_id"], 3).collect()
    assert [(r.days, r.start.isoformat()) for r in runs] == [(3, "2024-01-01")]
    dates = e.select("user_id", F.to_date("ts").alias("date"))
    assert [r.dates for r in streaks.chains(dates, ["user_id"], 2, 2).collect()] == [4]
    assert [r.gap_days for r in streaks.inactive_periods(streaks.daily(e)).collect()] == [3]
    assert streaks.longest_streak(e).first().label == "Jan 01 - Jan 03"


def test_empty_tables(spark):
    e = events(spark, [])
    days = streaks.daily(e)
    for df in (activity.summary(e), sessions.time_spent(e), streaks.anomalies(days), overlap.subscription_overlap(e), cards.patterns(e), activity.month_by_bin(e)):
        assert df.count() == 0


LANG = [("", "unknown", "low"), ("ab", "unknown", "low"), ("123 !!", "english", "high"), ("राम मंदिर", "hindi", "high"), ("the man in the house", "hinglish", "high"), ("watch the match", "english", "high"), ("bhai song", "hinglish", "medium"), ("yeh kaam kya hai", "hinglish", "high"), ("ñññ", "english", "high"), (None, "unknown", "low")]


def test_language(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in LANG], "t string").select(X.language(F.col("t")).alias("l"))
    assert [(r.l.type, r.l.confidence) for r in df.collect()] == [(a, b) for _, a, b in LANG]


def test_text_functions(spark):
    rows = [("#familyguy #shorts", ["familyguy", "shorts"]), ("No hashtags here", []), ("#हिंदी #test", ["test"]), (None, [])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(X.hashtags(F.col("t"))).collect()] == [t for _, t in rows]
    one = spark.createDataFrame([("Watched  Hello \U0001f62d https://x.y/z World \U0001fabd ",)], "t string").select(X.clean_text(F.col("t"))).first()[0]
    assert one == "hello   world \U0001fabd"
    ids = spark.createDataFrame([("https://a.b/watch?x=1&v=abcdefghijk",), ("https://youtu.be/abcdefghijk",), ("https://a.b/embed/abcdefghijk",), ("https://a.b/",)], "u string")
    assert [r[0] for r in ids.select(X.video_id(F.col("u"))).collect()] == ["abcdefghijk"] * 3 + [None]
    merged = spark.range(1).select(X.merge_topics(F.array(F.lit("a")), F.array(F.lit("new york")), F.array(F.lit("york"), F.lit("b")))).first()[0]
    assert merged == ["a", "new york", "b"]


def test_full_word_lists(spark):
    assert (len(X.STOP_WORDS), len(X.MARKERS)) == (172, 67)
    titles = [("dekho accha gaana", "hinglish", "high"), ("lekin song", "hinglish", "medium"), ("raha gaya woh", "english", "high")]
    df = spark.createDataFrame([(t,) for t, _, _ in titles], "t string").select(X.language(F.col("t")).alias("l"))
    assert [(r.l.type, r.l.confidence) for r in df.collect()] == [(a, b) for _, a, b in titles]
    texts = [("Official trailer: her Cafe\u0301 would Open | again", "trailer: Caf\xe9 Open"), ("cafe\u0301\u200b  \u0930\u093e\u092e bar", "caf\xe9 bar"), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r[0] for r in df.select(X.text_v1(F.col("t"))).collect()] == [t for _, t in texts]


def test_entities(spark):
    docs = spark.createDataFrame([(1, "I love New York City and Rome"), (2, "nothing")], "id long, t string")
    names = spark.createDataFrame([("new york", "place"), ("new york city", "place"), ("city", "x"), ("rome", "place")], "phrase string, label string")
    assert {r.id: r.entities for r in topics.entities(docs, "id", "t", names).collect()} == {1: ["new york city", "rome"]}


def test_entity_and_noun_topics(spark):
    rows = [(1, "watch", "active", "new york city tour-guide with people in the town 2024 #pizza #", "english"), (2, "watch", "active", "pizza.#food accha recipe of the day, recipe", "hinglish"), (3, "watch", "passive", "pizza", "english"), (4, "watch", "active", None, "unknown")]
    e = spark.createDataFrame(rows, "seq long, type string, engagement string, text_clean string, language_type string")
    names = spark.createDataFrame([("New York City", "GPE")], "phrase string, label string")
    words = spark.createDataFrame([(w,) for w in ("city", "tour", "guide", "people", "town", "2024", "Pizza", "recipe", "day", "video")], "word string")
    got = {r.seq: r for r in topics.enrich_events(e, "seq", names, words).collect()}
    assert got[1].ner == ["new york city"] and got[1].nouns == ["city", "tour", "guide"]
    assert got[1].micro_topics == ["pizza", "new york city", "tour", "guide"]
    assert got[2].nouns == ["pizza", "recipe"] and got[2].micro_topics == ["food", "pizza", "recipe"]
    assert got[3].micro_topics is None and got[3].nouns is None and got[4].micro_topics == []
    assert {r.seq: r.micro_topics for r in topics.enrich_events(e).collect()}[1] == ["pizza"]


WATCHED = [
    {"title": "Watched a", "titleUrl": "https://www.example.com/watch?v=abcdefghijk", "time": "2025-11-02T05:30:39.599Z", "subtitles": [{"name": "Ch A ", "url": "u"}]},
    {"title": "Viewed b", "time": "2025-11-02T06:30:39Z", "subtitles": []},
    {"title": "Watched ad", "time": "2025-11-02T06:30:39Z", "details": [{"name": "From Google Ads"}]},
    {"title": "Watched post", "titleUrl": "https://x/post/1", "time": "2025-11-02T06:30:39Z"},
    {"title": "Watched c", "time": "garbage"},
]


@pytest.fixture(scope="module")
def archive_dir(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    for name, watch in (("u1", json.dumps(WATCHED)), ("u2", '{"title": "Watched x"}'), ("u3", '[{"title": ')):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("x/watch-history.json", watch)
            z.writestr("y/WATCH-HISTORY.json", "[]")
            z.writestr("x/search-history.json", json.dumps([{"title": "Searched for Cats", "time": "2025-11-02T06:30:39.5"}]))
            z.writestr("x/subscriptions.csv", "Channel Id,Channel Url,Channel Title\nUC1,u1,Ch A \nUC2,u2,\n")
        (top / f"{name}.zip").write_bytes(buffer.getvalue())
    (top / "broken.zip").write_bytes(b"no archive")
    return str(top)


def test_exports(spark, archive_dir):
    found = exports.members(exports.archives(spark, archive_dir))
    assert found.filter("error = 'BadZipFile'").count() == 1
    report = {(r.archive[-6:], r.target): r.member for r in exports.locate(found.filter("error is null")).collect()}
    assert report["u1.zip", "watch-history.json"] == "x/watch-history.json"
    last = {(r.archive[-6:], r.target): r.member for r in exports.locate(found.filter("error is null"), match="last_ci").collect()}
    assert last["u1.zip", "watch-history.json"] == "y/WATCH-HISTORY.json"
    files = exports.extract(found).withColumn("user_id", F.regexp_extract("archive", r"(u\d)\.zip", 1)).withColumn("tz", F.when(F.col("user_id") == "u3", "Mars/X").otherwise("America/New_York"))
    assert exports.preview(files).filter("filename = 'subscriptions.csv'").select("total").distinct().collect() == [(2,)]
    rows, bad = exports.events(files, exports.time_zones(spark))
    assert [r.user_id for r in bad.collect()] == ["u3"]
    one = [r for r in rows.filter("user_id = 'u1'").orderBy("type", "seq").collect()]
    watch = [r for r in one if r.type == "watch"]
    assert [(r.text_clean, r.engagement, r.ts_utc is None) for r in watch] == [("a", "active", False), ("b", "passive", False), ("c", "active", True)]
    assert watch[0].channel_clean == "ch a " and watch[0].video_id == "abcdefghijk"
    assert watch[0].ts_local.hour == 1 and watch[1].ts_local.hour == 1 and watch[1].ts_utc - watch[0].ts_utc > dt.timedelta(minutes=59)
    assert [r.channel for r in one if r.type == "subscribe"] == ["Ch A ", "UC2"]
    assert rows.filter("user_id = 'u2' and type = 'watch'").count() == 0
    total = exports.stats(rows).filter("user_id = 'u1'").first()
    assert (total.total_watch, total.total_search, total.total_subscribe, total.total_events) == (3, 1, 2, 6)


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(u, u % 3) for u in range(20)], "user_id long, x long")
    store.write_events(df, f"{tmp_path}/s")
    assert store.read_events(spark, f"{tmp_path}/s", [3, 4]).count() == 2
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("s/bucket=*/*.parquet")}
    store.delete(spark, f"{tmp_path}/s", spark.createDataFrame([(3,), (99,)], "user_id long"))
    assert {r.user_id for r in store.read_events(spark, f"{tmp_path}/s").collect()} == set(range(20)) - {3}
    kept = {p for p in before if p.exists()}
    assert kept and len(before) - len(kept) <= 2  # other buckets are left as they were
    assert store.read_events(spark, f"{tmp_path}/s", spark.createDataFrame([(5,), (3,)], "user_id long")).count() == 1


def test_file_store(spark, tmp_path):
    now = dt.datetime(2024, 1, 3)
    rows = [(f"t{k}", n, "application/json", "[]", 2, "UTC", now - dt.timedelta(hours=12 * k) if k < 4 else None) for k in range(5) for n in ("a.json", "b.json")]
    files = spark.createDataFrame(rows, "token string, filename string, content_type string, content string, size_bytes long, timezone string, created_at timestamp_ntz")
    path = f"{tmp_path}/f"
    store.write_files(files, path, buckets=4)
    assert store.read_files(spark, path, ["t1"], buckets=4).count() == 2
    listed = {r.token: r for r in store.sessions(store.read_files(spark, path)).collect()}
    assert listed["t2"].files == ["a.json", "b.json"] and listed["t2"].created_at == now - dt.timedelta(hours=24) and len(listed) == 5
    store.expire(spark, path, now, buckets=4)
    assert {r.token for r in store.read_files(spark, path).collect()} == {"t0", "t1", "t2", "t4"}  # exactly 24 hours stays


def test_channel_table(spark):
    known = spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "k string, name string, fetch_count long")
    new = spark.createDataFrame([("b", "BB"), ("c", "C")], "k string, name string")
    assert {tuple(r) for r in overlap.upsert(known, new, "k").collect()} == {("a", "A", 1), ("b", "BB", 3), ("c", "C", 1)}
    channels = spark.createDataFrame([(1, "x", ["t9", "t1"]), (2, "cool music", ["t9"]), (3, "z", None)], "id long, name string, topics array<string>")
    mapping, spare = spark.createDataFrame([("t1", "sport")], "topic string, category string"), spark.createDataFrame([("music", "music")], "keyword string, category string")
    assert {r.id: (r.category, r.categories) for r in overlap.categories(channels, "id", "topics", mapping, spare).collect()} == {1: ("sport", ["sport"]), 2: ("music", []), 3: (None, [])}


def test_report_and_cards(spark):
    e = events(spark, [(1, k * 30, "ab"[k % 2]) for k in range(40)])
    out = full_report(e)
    assert len({k.split(".")[0] for k in out}) == 10 and len(out) == 30 and all(df.count() >= 0 for df in out.values())
    doc = json.loads(cards.card_document(e, 2024).first().cards)
    assert doc["year"] == 2024 and doc["stats"]["watches"] == 40


def test_streaming_sessions(spark, tmp_path):
    """Files arrive one by one; an event behind the watermark is dropped, one inside it joins its session."""
    batches = [[(1, 0), (1, 30), (2, 10)], [(1, 400), (2, 401)], [(1, 5), (2, 380), (1, 900)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, T0 + dt.timedelta(minutes=m)) for u, m in rows], "user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    out = f"{tmp_path}/out"
    for k in range(3):  # each run reads the files of one folder more
        stream = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(f"{tmp_path}/in/{{{','.join(str(x) for x in range(k + 1))}}}")
        query = session_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.user_id, int((r.start_ts - T0).total_seconds() / 60), r.events) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, 2), (2, 10, 1), (1, 400, 1), (2, 380, 2)}


def test_habits_and_report(spark):
    day = 24 * 60
    rows = [(1, d * day, "a long name") for d in range(3)] + [(1, d * day + 1, "b") for d in (0, 1, 2, 3, 9)] + [(2, 0, "c")]
    habits = streaks.channel_habits(events(spark, rows))
    got = {r.channel_clean: r for r in habits.collect()}
    assert [(x.days, x.start.isoformat()) for x in got["b"].habit_streaks] == [(4, "2024-01-01")] and got["b"]["rank"] == 1 and got["b"].days_watched == 5
    assert streaks.habit_streaks(habits).count() == 2
    words = {r.user_id: r.summary for r in streaks.habit_report(events(spark, rows)).collect()}
    assert words == {1: "Strongest habit: b watched 4 days in a row | 2 channels with daily habits | 1 rewatched videos", 2: "No strong habits detected"}
    seen = streaks.rewatched_videos(events(spark, rows)).collect()
    assert [(r.title, r.days, r.has_streak, r.longest_streak) for r in seen] == [("a long name", 3, True, 3)]
    # a rare topic takes no place of the best
    topical = events(spark, rows).withColumn("micro_topics", F.array(F.col("channel_clean")))
    assert [r.topic for r in streaks.topic_habits(topical, last=1).collect()] == ["b"]


def test_patterns_of_channels(spark):
    week = 7 * 24 * 60
    rows = [(1, k * week, "m") for k in range(10)] + [(1, k * 24 * 60 + 600, "x") for k in range(14)]
    e = events(spark, rows).unionByName(events(spark, [(1, 0, None)] * 1100).withColumn("seq", F.col("seq") + 1000))
    assert cards.patterns(e).count() == 0  # 1 % of all watches, those without a channel too, is 11
    got = cards.patterns(events(spark, rows)).collect()
    assert (got[0].kind, got[0].value, got[0].n, got[0].insight) == ("slot", "night", 14, "**x** is your **night** go-to (100%)")
    assert (got[1].kind, got[1].value, got[1].n, got[1].insight) == ("weekday", "Monday", 10, "You watch **m** on **Mondays** (100% of the time)")
    assert {r.total for r in got} == {len(got)}


def test_labels(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, 11, 12, 13, 23)], "h int")
    assert [r[0] for r in df.select(activity.hour_label(F.col("h"))).collect()] == ["12 AM", "1 AM", "11 AM", "12 PM", "1 PM", "11 PM"]
    names = [("#emirates #", ""), ("city.#history", "city"), ("world\u2014kuwait", "world kuwait"), ("st. louis.", "st. louis"), ("(a, b)", "a, b")]
    df = spark.createDataFrame([(t,) for t, _ in names], "t string")
    assert [r[0] for r in df.select(X.sanitise_topic(F.col("t"))).collect()] == [t for _, t in names]
    urls = spark.createDataFrame([("https://a/@x_y-1.z",), ("https://a/channel/UC-1?x",), (None,)], "u string")
    assert [r[0] for r in urls.select(X.channel_id(F.col("u"))).collect()] == ["@x_y-1", "UC-1", None]


def test_csv_records(spark):
    text = '\ufeffa,b\r\n"x, ""y""\nz",1\n\n,\n"",q\n'
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(exports.csv_records(F.col("t"))).collect()
    assert [r[0] for r in got] == [[["a", "b"], ['x, "y"\nz', "1"], ["", ""], ["", "q"]], [], []]
    files = [("f", "subscriptions.csv", "text/csv", text), ("g", "a.json", "application/json", "[1, {}]"), ("h", "b.json", "application/json", '{"x": 1}'), ("i", "c.json", "application/json", "[1,")]
    shown = {r.archive: r for r in exports.preview(spark.createDataFrame(files, "archive string, filename string, content_type string, content string"), 1).collect()}
    assert (shown["f"].total, shown["f"].has_more, shown["f"].headers, json.loads(shown["f"].rows[0])) == (3, True, ["a", "b"], {"a": 'x, "y"\nz', "b": "1"})
    assert (shown["g"].total, shown["g"].rows, shown["h"].total, shown["i"].total, shown["i"].error) == (2, ["1"], 1, None, "Invalid JSON")


def test_local_info(spark):
    rows = [("2025-11-02T05:30:39.599Z", "America/New_York"), ("2025-11-02 06:30:39", "Asia/Kolkata"), ("x", "UTC")]
    df = spark.createDataFrame(rows, "t string, tz string")
    got = [(r.timestamp_local, r.hour_local, r.day_name, r.date_text) for r in exports.local_info(df.withColumn("ts_utc", exports.lenient_time(F.col("t")))).collect()]
    assert got == [("2025-11-02T01:30:39.599000-04:00", 1, "Sunday", "2025-11-02"), ("2025-11-02T12:00:39+05:30", 12, "Sunday", "2025-11-02"), (None, None, None, None)]
    common = {r.tz for r in exports.time_zones(spark, common=True).collect()}
    assert {"UTC", "Asia/Kolkata"} <= common < {r.tz for r in exports.time_zones(spark).collect()} and "EST5EDT" not in common


def test_hindi_topics(spark):
    rows = [(1, "watch", "active", "दिल्ली में मेला #टैग और मेला", "hindi"), (2, "watch", "active", "the fair in delhi", "english")]
    e = spark.createDataFrame(rows, "seq long, type string, engagement string, text_clean string, language_type string")
    names = spark.createDataFrame([("दिल्ली", "GPE"), ("delhi", "GPE")], "phrase string, label string")
    words = spark.createDataFrame([(w,) for w in ("मेला", "में", "fair", "the")], "word string")
    got = {r.seq: r for r in topics.enrich_events(e, "seq", names, words).collect()}
    assert (got[1].ner, got[1].nouns, got[1].text_v1) == (["दिल्ली"], ["मेला"], None) and (got[2].ner, got[2].nouns) == (["delhi"], ["fair"])


def test_player_pages(spark):
    player = {"microformat": {"playerMicroformatRenderer": {"category": "Music", "title": {"simpleText": "a"}, "ownerChannelName": "o", "description": {"simpleText": "d" * 600}}}, "videoDetails": {"keywords": ["k", "l"]}}
    pages = [(f"<p>x</p><script>var ytInitialPlayerResponse = {json.dumps(player)};var y = {{}};</script>",), ("<p>",), ("ytInitialPlayerResponse = {no};",), (None,)]
    df = spark.createDataFrame(pages, "h string").select(X.page_metadata(X.embedded_json(F.col("h"))).alias("m")).select("m.*")
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("Music", "a", "o", "d" * 500, ["k", "l"]) and got[1:] == [(None,) * 5] * 3


def test_channel_batches(spark):
    counts = spark.createDataFrame([(f"c{k}", 1 + k % 3) for k in range(200)], "c string, n long")
    known = spark.createDataFrame([("c1",)], "c string")
    out = overlap.unknown_channels(counts, known, "c", size=20).collect()
    assert sorted(r.place for r in out) == list(range(len(out))) and {r.c for r in out} == {f"c{k}" for k in range(200) if k % 3 and k != 1}
    assert [len(r["keys"]) for r in overlap.requests(overlap.unknown_channels(counts, known, "c", size=20), "c").orderBy("batch").collect()] == [20] * 6 + [len(out) - 120]
    seen = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(days=31))], "c string, fetched timestamp_ntz")
    assert [r.c for r in overlap.stale(seen, T0).collect()] == ["b"]


def both(spark, path, rows, name):
    """Rows of a query over ``rows`` (user, minutes after T0, channel number) and those of its SQL."""
    table = [(k, T0 + dt.timedelta(minutes=m), u, "view", 1.0, json.dumps({"k": c})) for k, (u, m, c) in enumerate(rows)]
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(-1, "the")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    df = queries.QUERIES[name](spark, str(path))
    with duckdb.connect() as con:
        for t in ("events", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        return sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall())


def paced(*channels):
    """Watches of user 1 as ``both`` takes them: each channel's gaps in days."""
    rows = [(1, (sum(gaps[:k]) * 24 * 60 + c), c) for c, gaps in channels for k in range(len(gaps) + 1)]
    return sorted(rows, key=lambda r: r[1])


#: Mean gaps of 2.5 and 2.4 days, 7 and 6 watches: equal scores but for the rounding of tenths.
EVEN_SCORES = ((38, (3, 2, 3, 2, 3, 2)), (45, (3, 2, 3, 2, 2)))


def test_habits_of_even_scores_rank_as_in_sql(spark, tmp_path):
    got, sql = both(spark, tmp_path, paced(*EVEN_SCORES), "card_habits")
    assert got == sql and [r[2] for r in got] == ["Channel 45", "Channel 38"]


def test_card_document_lists_of_one_and_even_scores(spark, tmp_path):
    got, sql = both(spark, tmp_path, paced(*EVEN_SCORES, (7, (7,) * 9), (9, (1,) * 9)), "card_document")
    shown = {r[1]: r[2] for r in got}
    assert got == sql and shown["patterns.insight"] == "You watch **channel 7** on **Mondays** (100% of the time)" and shown["habits.name"] == "Channel 9|Channel 45|Channel 38|Channel 7"


def test_day_at_the_limit_is_no_binge(spark):
    """The largest of ten totals is mean + 2 sigma, however sigma is rounded, which depends on the order of the days."""
    even = ((2, 5, 11, 9, 6, 9, 5, 11, 16, 2), (9, 15, 8, 5, 1, 11, 6, 3, 7, 1), (9, 5, 1, 3, 15, 7, 2, 12, 7, 5), (4, 1, 6, 11, 1, 5, 2, 14, 3, 9))
    at = [(10 * u + turn, k, totals[(k + turn) % 10]) for u, totals in enumerate(even) for turn in range(10) for k in range(10)]
    above = [(-1, k, 15 if k == 2 else 3) for k in range(6)]
    still = [(-2, k, 12) for k in range(4)]
    days = spark.createDataFrame(at + above + still, "user_id long, k int, total long").withColumn("date", F.date_add(F.lit(T0.date()), F.col("k")))
    got = [(r.user_id, r.date.day, r.total, r.excess, r.multiplier) for r in streaks.binge_days(days).collect()]
    assert got == [(-1, 3, 15, 10.0, 3.0)]
