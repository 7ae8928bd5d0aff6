"""Table loaders and the two fixture adapters (ticks, posts) over the supplied parquet.

All event times are read as UTC ``TIMESTAMP`` (the files store zone-less stamps, which
Spark reads as ``TIMESTAMP_NTZ``; watermarks need ``TIMESTAMP``).  A range predicate on
the cast column is still pushed into the parquet scan.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.functions.sentiment import with_scores
from marketspark.operators.sequence import previous_value
from marketspark.session import ensure_utc, scratch_path

# ---------------------------------------------------------------------------
# The reference's default universe, company names and question aliases
# (aliases in the reference's map order; the first contained alias wins).
REFERENCE_TICKERS = ["TSLA", "AAPL", "NVDA", "MSFT", "META", "AMZN", "GOOGL", "NFLX"]
REFERENCE_NAMES = {
    "TSLA": "Tesla, Inc.",
    "AAPL": "Apple Inc.",
    "NVDA": "NVIDIA Corporation",
    "MSFT": "Microsoft Corporation",
    "META": "Meta Platforms, Inc.",
    "AMZN": "Amazon.com, Inc.",
    "GOOGL": "Alphabet Inc. (Google)",
    "NFLX": "Netflix, Inc.",
}
REFERENCE_ALIASES = [
    ("tsla", "TSLA"), ("tesla", "TSLA"),
    ("aapl", "AAPL"), ("apple", "AAPL"),
    ("nvda", "NVDA"), ("nvidia", "NVDA"),
    ("msft", "MSFT"), ("microsoft", "MSFT"),
    ("meta", "META"), ("facebook", "META"),
    ("amzn", "AMZN"), ("amazon", "AMZN"),
    ("googl", "GOOGL"), ("google", "GOOGL"), ("alphabet", "GOOGL"),
    ("nflx", "NFLX"), ("netflix", "NFLX"),
]
# ---------------------------------------------------------------------------

# Fixture adapter parameters: tickers are 'T' || (user_id % N_TICKERS).
N_TICKERS = 8
TICK_EVENT_TYPES = ("view", "purchase")
POST_EVENT_STRIDE = 5          # a document joins the event with event_id = doc_id * 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _utc(c: str) -> F.Column:
    return F.col(c).cast("timestamp").alias(c)


def ticker_of(user_id: F.Column) -> F.Column:
    return F.concat(F.lit("T"), F.pmod(user_id, F.lit(N_TICKERS)).cast("string"))


Reader = Callable[[SparkSession, str, str], DataFrame]     # a pluggable source: (session, folder, table name) -> rows


def load_ticks(spark: SparkSession, sf_dir: str, bucket: str = "auto", reader: Reader = read_table) -> DataFrame:
    """ticks(tick_id, ticker, ts, price, open, volume) from ``events`` (view/purchase rows).

    ``open`` is the previous price of the same ticker in (ts, tick_id) order, else the
    tick's own price; computed per (ticker, time bucket) with a carry-in, never with a
    window over a whole ticker.
    """
    ev = (reader(spark, sf_dir, "events")
          .filter(F.col("event_type").isin(*TICK_EVENT_TYPES))
          .select(F.col("event_id").alias("tick_id"), ticker_of(F.col("user_id")).alias("ticker"),
                  _utc("ts"), (F.lit(100.0) + F.col("value")).alias("price"),
                  (F.get_json_object("props", "$.k").try_cast("long") * 100).alias("volume")))
    t = previous_value(ev, "ticker", ["ts", "tick_id"], "price", "_prev", bucket=bucket)
    return t.select("tick_id", "ticker", "ts", "price", F.coalesce("_prev", "price").alias("open"), "volume")


SCAN_TASKS = "marketspark.scan.tasks"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as the session's ``marketspark.scan.tasks`` asks for, else as it is.

    For small files of one row group, which Spark cannot split, ahead of CPU-heavy work; unset
    on a cluster, where a scan has splits enough and the corpus is never shuffled."""
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def load_posts(spark: SparkSession, sf_dir: str, model: str = "keyword", reader: Reader = read_table) -> DataFrame:
    """posts(post_id, ticker, ts, text, username, followers, compound, pos, neg, neu).

    Each document is scored (native Column scorer over the whole text) on the scan side,
    then joined to ``events`` on event_id = doc_id * 5 (unique keys: a plain shuffle or
    broadcast join chosen by AQE from runtime sizes, no skew).
    """
    docs = spread(reader(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("post_id"), "text", F.col("source").alias("username"),
        F.col("n_chars").alias("followers")))
    docs = with_scores(docs, "text", model).withColumn("_eid", F.col("post_id") * POST_EVENT_STRIDE)
    ev = reader(spark, sf_dir, "events").select(
        F.col("event_id").alias("_eid"), ticker_of(F.col("user_id")).alias("ticker"), _utc("ts"))
    p = docs.join(ev, "_eid")
    return p.select("post_id", "ticker", "ts", "text", "username", "followers", "compound", "pos", "neg", "neu")


def load_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """universe(ordinal, ticker, name) of the fixture: every ticker seen in the tick data."""
    ev = (read_table(spark, sf_dir, "events").filter(F.col("event_type").isin(*TICK_EVENT_TYPES))
          .select(F.pmod(F.col("user_id"), F.lit(N_TICKERS)).cast("int").alias("ordinal")))
    u = ev.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_ticks"))
    return u.select("ordinal", F.concat(F.lit("T"), F.col("ordinal").cast("string")).alias("ticker"),
                    F.concat(F.lit("Company "), F.col("ordinal").cast("string")).alias("name"))


def universe_aliases(universe: DataFrame) -> DataFrame:
    """aliases(ordinal, word, ticker): lower-cased ticker and company name, ticker first."""
    a = universe.select((F.col("ordinal") * 2).alias("ordinal"), F.lower("ticker").alias("word"), "ticker")
    b = universe.select((F.col("ordinal") * 2 + 1).alias("ordinal"), F.lower("name").alias("word"), "ticker")
    return a.unionByName(b)


def reference_universe(spark: SparkSession) -> DataFrame:
    rows = [(i, t, REFERENCE_NAMES[t]) for i, t in enumerate(REFERENCE_TICKERS)]
    return spark.createDataFrame(rows, "ordinal int, ticker string, name string")


def reference_aliases(spark: SparkSession) -> DataFrame:
    rows = [(i, w, t) for i, (w, t) in enumerate(REFERENCE_ALIASES)]
    return spark.createDataFrame(rows, "ordinal int, word string, ticker string")


def load_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: user turns of ``conversations`` -> (msg_id, message)."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("msg_id"), "conv_id", "turn",
                    F.col("text").alias("message"))


def load_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture questions: user turns, every third conversation prefixed with a ticker
    ('T' + conv_id % 8), the next third with a mood phrase, the rest unchanged."""
    m = load_chat_messages(spark, sf_dir)
    k = F.pmod(F.col("conv_id"), F.lit(3))
    tick = F.concat(F.lit("T"), F.pmod(F.col("conv_id"), F.lit(N_TICKERS)).cast("string"))
    q = (F.when(k == 0, F.concat(tick, F.lit(" outlook? "), F.col("message")))
         .when(k == 1, F.concat(F.lit("Fear and greed today? "), F.col("message")))
         .otherwise(F.col("message")))
    return m.select("msg_id", "conv_id", "turn", q.alias("message"))


def quote_documents(ticks: DataFrame) -> DataFrame:
    """Fixture quote documents: ticks encoded as chart JSON (two-point arrays: previous open, this tick)."""
    hi = F.greatest("open", "price")
    lo = F.least("open", "price")
    doc = F.struct(F.struct(F.array(F.struct(
        F.struct(F.col("price").alias("regularMarketPrice")).alias("meta"),
        F.struct(F.array(F.struct(F.array(F.col("open"), F.col("open")).alias("open"),
                                  F.array(F.col("open"), hi).alias("high"),
                                  F.array(F.col("open"), lo).alias("low"),
                                  F.array(F.lit(None).cast("long"), F.col("volume")).alias("volume"))).alias("quote"))
        .alias("indicators"))).alias("result")).alias("chart"))
    return ticks.select("tick_id", "ticker", "ts", F.to_json(doc).alias("value"))


def load_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class logits: the first three embedding entries as (neutral, positive, negative)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.slice("embedding", 1, 3).alias("logits"))


# ---------------------------------------------------------------------------
# Ingest tables: scored posts and ticks written once per input snapshot.

_WRITTEN: dict[tuple, str] = {}


SNAPSHOT = "marketspark.snapshot"


_STAMPS: dict[tuple, int] = {}
_IN_QUERY = False


@contextmanager
def one_stamp():
    """Within, the files of each table are listed once: all stored tables of a query belong to one state of the input."""
    global _IN_QUERY
    outer, _IN_QUERY = _IN_QUERY, True
    try:
        yield
    finally:
        _IN_QUERY = outer
        if not outer:
            _STAMPS.clear()


def _file_stamps(spark: SparkSession, paths: list[str]) -> list[int]:
    """Digest of the paths, sizes and modification times of all files that make up each table, listed by Spark's
    binaryFile source in one job (contents are not read), so any store and nested folders work."""
    app = spark.sparkContext.applicationId
    missing = [p for p in paths if not (_IN_QUERY and (app, p) in _STAMPS)]
    found = {}
    if missing:
        listed = None
        for k, p in enumerate(missing):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(
                F.lit(k).alias("k"), F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)").alias("h"))
            listed = files if listed is None else listed.unionByName(files)
        got = {r["k"]: hash((r["n"], r["h"])) for r in listed.groupBy("k").agg(F.count("*").alias("n"), F.sum("h").alias("h")).collect()}
        found = {p: got.get(k, 0) for k, p in enumerate(missing)}
        if _IN_QUERY:
            _STAMPS.update({(app, p): v for p, v in found.items()})
    return [found[p] if p in found else _STAMPS[app, p] for p in paths]


def snapshot_key(spark: SparkSession, sf_dir: str, names: list[str], tag: str) -> tuple:
    """Identity of the input state: the caller's ``marketspark.snapshot`` setting, else the files'."""
    given = spark.conf.get(SNAPSHOT, None)
    stats = given or tuple(zip(names, _file_stamps(spark, [os.path.join(sf_dir, f"{n}.parquet") for n in names])))
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), tag, stats)


def written_table(spark: SparkSession, key: tuple, name: str, build, sort: tuple[str, ...] = ("ts", "ticker")) -> str:
    """Write ``build()`` once to the shared checkpoint folder and read it back.

    This is the ingest step (the reference scores a post once when it
    arrives and stores the scores).  The written table cuts lineage, survives executor
    loss, and stops later filters on scores from being pushed back into the scorer.
    Rows are sorted within files by time, so row groups cover narrow time ranges and the
    ``as_of`` range predicates skip most of them.
    """
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
        df = build()
        (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return path


def posts_table(spark: SparkSession, sf_dir: str, model: str = "keyword") -> DataFrame:
    """Scored posts without the text, materialised once per input snapshot.

    Scoring runs on the document scan; only the narrow columns (ids, time, scores) go
    through the join with ``events``, so the text corpus is never shuffled.  Consumers
    that need the text join it back for the rows they keep (``post_texts``)."""
    return spark.read.parquet(posts_table_path(spark, sf_dir, model))


def posts_table_path(spark: SparkSession, sf_dir: str, model: str = "keyword") -> str:
    key = snapshot_key(spark, sf_dir, ["documents", "events"], f"posts/{model}")
    return written_table(spark, key, "posts", lambda: load_posts(spark, sf_dir, model).drop("text"))


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, text) straight from the document table (the text store)."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), "text")


def ticks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with their previous-price open, materialised once per input snapshot."""
    return spark.read.parquet(ticks_table_path(spark, sf_dir))


def ticks_table_path(spark: SparkSession, sf_dir: str) -> str:
    key = snapshot_key(spark, sf_dir, ["events"], "ticks")
    return written_table(spark, key, "ticks", lambda: load_ticks(spark, sf_dir))


_FULLEST: dict[tuple, int] = {}


def fullest_ticker(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the ticker with the most ticks and post events (a post enters and leaves a look-back).

    Counted once per input snapshot, so that a query knows without a pass of its own whether every ticker
    fits one bucket."""
    key = snapshot_key(spark, sf_dir, ["documents", "events"], "fullest")
    if key not in _FULLEST:
        rows = ticks_table(spark, sf_dir).select("ticker", F.lit(1).alias("w")).unionByName(posts_table(spark, sf_dir).select("ticker", F.lit(2).alias("w")))
        _FULLEST[key] = rows.groupBy("ticker").agg(F.sum("w").alias("n")).agg(F.max("n")).first()[0] or 0
    return _FULLEST[key]
