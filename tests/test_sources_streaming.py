"""Wire parsing, quotes, RSS, sinks and streaming edge cases (late rows, replays)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from marketspark.operators.records_ops import dedupe, manual_posts
from marketspark.sources.news import news_to_posts, read_rss
from marketspark.sources.quotes import extract_quotes, with_fallback
from marketspark.sources.records import parse_posts, parse_ticks
from marketspark.streaming import jobs as ST
from marketspark.streaming.sinks import make_sink, parquet_writer, read_batches, truncate

T0 = dt.datetime(2024, 1, 1)


def test_parse_malformed_and_fallback_time(spark):
    raw = spark.createDataFrame([
        ('{"id":"a","ticker":"X","text":"up","timestamp":"2024-01-01T00:00:05","followers":5}',),
        ('{"id":"b","ticker":"X","timestamp":"junk","followers":99999999999}',),
        ("not json",)], "value string")
    rows = parse_posts(raw, default_ts=F.lit(T0).cast("timestamp")).collect()
    assert rows[0]["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 5) and rows[0]["followers"] == 5
    assert rows[1]["timestamp"] == T0 and rows[1]["followers"] is None
    assert rows[2]["id"] is None
    t = parse_ticks(spark.createDataFrame([('{"ticker":"X","price":1.5,"volume":3000000000}',)], "value string")).first()
    assert t["volume"] == 3_000_000_000


def test_quotes_last_element_and_fallback(spark):
    doc = ('{"chart":{"result":[{"meta":{"regularMarketPrice":10.456},"indicators":{"quote":[{"open":[1.0,null],'
           '"high":[2.0,0.0],"low":[0.5,9.111],"volume":[5,null]}]}}]}}')
    raw = spark.createDataFrame([("X", doc), ("Y", '{"chart":{"result":[]}}')], "ticker string, value string")
    q = extract_quotes(raw).collect()
    assert len(q) == 1
    r = q[0]
    assert (r["price"], r["open"], r["high"], r["low"], r["volume"]) == (10.46, 10.46, 10.46, 9.11, 0)
    fb = spark.createDataFrame([("X", 1.0), ("Y", 2.0)], "ticker string, price double")
    got = {r["ticker"]: r["price"] for r in with_fallback(extract_quotes(raw).select("ticker", "price"), fb).collect()}
    assert got == {"X": 10.46, "Y": 2.0}


def test_read_rss_and_news_posts(spark):
    d = tempfile.mkdtemp(prefix="rss-")
    p = os.path.join(d, "feed.xml")
    with open(p, "w") as f:
        f.write("<rss><channel><item><title>Chips rally</title><description>" + "x" * 150 +
                "</description><pubDate>2024-01-01T00:00:00</pubDate></item>"
                "<item><title>Chips rally</title></item></channel></rss>")
    items = read_rss(spark, p)
    posts = news_to_posts(items, F.lit("NVDA")).collect()
    assert len(posts) == 2 and posts[0]["id"] == posts[1]["id"]
    assert posts[0]["text"] == "$NVDA News: Chips rally. " + "x" * 100
    assert posts[1]["text"] == "$NVDA News: Chips rally. "


def test_dedupe_keeps_first_and_manual_defaults(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, "only")], "id string, o int, v string")
    got = {r["id"]: r["v"] for r in dedupe(df, "id", ["o"]).collect()}
    assert got == {"a": "first", "b": "only"}
    pay = spark.createDataFrame([(1, "tsla", "to the moon", None, None)],
                                "msg_id long, ticker string, text string, username string, followers int")
    m = manual_posts(pay, F.lit(T0).cast("timestamp")).first()
    assert (m["ticker"], m["username"], m["followers"], m["views"], m["source"]) == (
        "TSLA", "manual_feed", 500, 15, "Manual API Feed")
    assert m["compound"] == 1.0


def test_multi_writer_sink_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="sink-")
    a, b = os.path.join(d, "a"), os.path.join(d, "b")
    sink = make_sink(parquet_writer(a), parquet_writer(b, lambda x: x.select("k")))
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    sink(df, 0)
    sink(df, 0)            # replay of batch 0 replaces, never duplicates
    sink(df.limit(1), 1)
    assert read_batches(spark, a).count() == 3 and read_batches(spark, b).columns == ["k"]
    truncate(spark, a, df.schema)
    assert spark.read.parquet(a).count() == 0


def test_stream_drops_rows_later_than_watermark(spark):
    d = tempfile.mkdtemp(prefix="late-")
    schema = "post_id long, ticker string, ts timestamp, compound double"
    batches = [[(1, "X", T0, 0.5), (2, "X", T0 + dt.timedelta(minutes=1), 0.5), (3, "X", T0 + dt.timedelta(minutes=30), 0.5)],
               [(4, "X", T0 + dt.timedelta(minutes=31), 1.0)],
               [(5, "X", T0 + dt.timedelta(minutes=2), 1.0)]]      # 28 minutes behind the newest row
    src = os.path.join(d, "src")
    os.makedirs(src)
    for i, rows in enumerate(batches):
        part = os.path.join(d, f"p{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        f = [x for x in os.listdir(part) if x.endswith(".parquet")][0]
        dst = os.path.join(src, f"{i}-{f}")
        os.link(os.path.join(part, f), dst)
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    stream = ST.read_stream(spark, src, max_files=1)
    out = ST.run_to_table(spark, ST.stream_sentiment(stream, "5 minutes"), "late").collect()
    first = [r for r in out if r["window_start"] == T0]
    # one file per micro-batch: the 00:02 row arrives after the watermark reached 00:20
    assert len(first) == 1 and first[0]["tweet_count"] == 2
    dd = ST.run_to_table(spark, ST.dedupe_stream(ST.read_stream(spark, src, max_files=1)), "dd")
    assert sorted(r["post_id"] for r in dd.collect()) == [1, 2, 3, 4]


def test_joined_sink_writes_both_tables(spark):
    from marketspark.plans.catalog import WINDOW, _post_stream, _tick_stream
    sf = "/root/testdata/sf0.001"
    agg, sig = ST.run_joined_sink(spark, _post_stream(spark, sf), _tick_stream(spark, sf), WINDOW)
    assert agg.count() == sig.count() > 0
    assert set(r["signal"] for r in sig.collect()) == {"HOLD"}
    assert sig.columns == ["ticker", "timestamp", "pearson", "lag", "signal", "confidence"]


def test_change_feed_marks_and_latest_post_detection(spark):
    from marketspark.operators.records_ops import change_feed
    ticks = spark.createDataFrame([(1, "A", T0, 1.0, 10), (2, "A", T0 + dt.timedelta(seconds=1), 2.0, 20)],
                                  "tick_id long, ticker string, ts timestamp, price double, volume long")
    alerts = spark.createDataFrame([(5, "A", "INFO", "m", "Bullish Spike", T0)],
                                   "alert_id long, ticker string, severity string, message string, type string, "
                                   "timestamp timestamp")
    posts = spark.createDataFrame([(7, "A", T0, 0.5), (8, "B", T0 + dt.timedelta(minutes=1), -0.5)],
                                  "post_id long, ticker string, ts timestamp, compound double")
    rows = change_feed(ticks, alerts, posts, after_tick=1, after_alert=0).collect()
    assert sorted((r["type"], r["id"]) for r in rows) == [("new_alerts", "5"), ("new_ticks", "2"), ("new_tweet", "8")]
    assert '"price":2.0' in [r for r in rows if r["type"] == "new_ticks"][0]["payload"]
    again = change_feed(ticks, alerts, posts, after_tick=2, after_alert=5, last_post_id=8).collect()
    assert again == []                       # nothing new, latest post already pushed


def test_restarted_job_resumes_from_checkpoint(spark):
    import uuid
    from marketspark.plans.catalog import _tick_stream
    from marketspark.session import scratch_path
    sf = "/root/testdata/sf0.001"
    name = f"feed-{uuid.uuid4().hex}"
    out, checkpoint = scratch_path(spark, f"jobs/{name}/out"), scratch_path(spark, f"jobs/{name}/checkpoint")
    for _ in range(2):                      # second start: nothing new to process
        q = ST.start_job(spark, ST.stream_change_feed(_tick_stream(spark, sf)), checkpoint, make_sink(parquet_writer(out)),
                         available_now=True)
        q.awaitTermination()
    got = read_batches(spark, out)
    assert got.count() == got.select("id").distinct().count() == 390


def test_stream_pane_windows(spark):
    from marketspark.operators.windows import sentiment_windows
    from marketspark.sources.tables import posts_table_path
    path = posts_table_path(spark, "/root/testdata/sf0.01")
    k = ["ticker", "window_start", "window_end", "tweet_count"]
    # in-order input (one micro-batch): identical to the direct form
    one = ST.run_to_table(spark, ST.stream_sentiment(ST.read_stream(spark, path), "1 day", "6 hours", panes=True), "p1")
    direct = ST.run_to_table(spark, ST.stream_sentiment(ST.read_stream(spark, path), "1 day", "6 hours"), "d1")
    assert one.count() == direct.count() > 0 and one.select(*k).exceptAll(direct.select(*k)).count() == 0
    # out-of-order files: late rows may be dropped, nothing is invented
    many = ST.run_to_table(spark, ST.stream_sentiment(ST.read_stream(spark, path, max_files=1), "1 day", "6 hours",
                                                      panes=True), "pm")
    truth = sentiment_windows(spark.read.parquet(path), "1 day", "6 hours")
    j = many.select(*k).join(truth.select(*k[:3], F.col("tweet_count").alias("b")), k[:3], "left")
    assert j.filter("b IS NULL OR tweet_count > b").count() == 0


def test_a_plugged_loader_serves_every_tick(spark):
    from marketspark.plans.catalog import plugged_ticks
    from marketspark.sources.tables import load_ticks
    columns = ["tick_id", "ticker", "ts", "price", "open", "volume"]
    got = sorted(map(tuple, plugged_ticks(spark, "/root/testdata/sf0.001").select(*columns).collect()))
    want = sorted(map(tuple, load_ticks(spark, "/root/testdata/sf0.001").select(*columns).collect()))
    assert got == want and len({t[1] for t in got}) == 8


def test_late_slices_are_written_in_many_files(spark, monkeypatch):
    from marketspark.plans import catalog
    sf, folders = "/root/testdata/sf0.001", []
    want = sorted(map(tuple, catalog.q_stream_late(spark, sf).drop("avg_sentiment").collect()))
    stage, place = catalog.stage_posts, catalog.scratch_path
    monkeypatch.setattr(catalog, "stage_posts", lambda *a: stage(*a).repartition(4))
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: folders.append(place(s, name)) or folders[-1])
    got = sorted(map(tuple, catalog.q_stream_late(spark, sf).drop("avg_sentiment").collect()))
    assert got == want and want
    assert len(spark.read.parquet(folders[0]).inputFiles()) > 3
