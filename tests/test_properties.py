"""Property tests: random small frames against brute-force Python definitions."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketspark.functions.stats import pearson
from marketspark.operators.align import rolling_sentiment_at_ticks

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _py_pearson(xs, ys):
    pairs = [(x, y) for x, y in zip(xs, ys) if x is not None and y is not None]
    n = len(pairs)
    if n <= 1:
        return 0.0
    mx = sum(p[0] for p in pairs) / n
    my = sum(p[1] for p in pairs) / n
    num = sum((x - mx) * (y - my) for x, y in pairs)
    dx = sum((x - mx) ** 2 for x, _ in pairs)
    dy = sum((y - my) ** 2 for _, y in pairs)
    if dx == 0 or dy == 0:
        return 0.0
    return num / math.sqrt(dx * dy)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([None, 1.0, 2.0, 3.5, -4.0]), st.sampled_from([None, 0.0, 0.5, 1.0])),
                min_size=0, max_size=12))
def test_pearson_matches_definition(spark, rows):
    df = spark.createDataFrame([("g", x, y) for x, y in rows] or [("g", None, None)], "g string, x double, y double")
    got = df.groupBy("g").agg(pearson(F.col("x"), F.col("y")).alias("r")).first()["r"]
    exp = _py_pearson([x for x, _ in rows], [y for _, y in rows])
    assert abs(got - exp) < 1e-9


events = st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(0, 600), st.sampled_from([-1.0, 0.25, 1.0])),
                  min_size=1, max_size=25)


@SETTINGS
@given(events, events, st.sampled_from(["1 minute", "7 minutes", "2 hours", "auto"]))
def test_range_average_any_chunking(spark, tick_rows, post_rows, chunks):
    ticks = spark.createDataFrame([(i, k, T0 + dt.timedelta(minutes=m), 100.0) for i, (k, m, _) in enumerate(tick_rows)],
                                  "tick_id long, ticker string, ts timestamp, price double")
    posts = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), c) for k, m, c in post_rows],
                                  "ticker string, ts timestamp, compound double")
    got = {r["tick_id"]: r["sentiment"] for r in
           rolling_sentiment_at_ticks(ticks, posts, window="2 hours", lookback="20 minutes", bucket=chunks).collect()}
    for i, (k, m, _) in enumerate(tick_rows):
        win = m // 120
        vals = [c for pk, pm, c in post_rows if pk == k and pm // 120 == win and m - 20 <= pm <= m]
        exp = round(sum(vals) / len(vals), 9) if vals else 0.0
        assert abs(got[i] - exp) < 1e-12


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 2000), st.sampled_from([None, 1.0, 2.5])),
                min_size=1, max_size=30),
       st.sampled_from(["1 minute", "7 minutes", "1 hour", "auto"]))
def test_split_sequence_ops_match_whole_key_definitions(spark, rows, bucket):
    import pandas as pd
    from marketspark.operators.sequence import forward_fill, previous_value, row_index
    data = [(i, k, T0 + dt.timedelta(minutes=m), v) for i, (k, m, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k string, ts timestamp, v double")
    pdf = pd.DataFrame(data, columns=["id", "k", "ts", "v"]).sort_values(["k", "ts", "id"])
    prev = pdf.groupby("k")["v"].shift(1)
    fill = pdf.groupby("k")["v"].ffill()
    idx = pdf.groupby("k").cumcount() + 1
    exp = {r.id: (p, f, n) for r, p, f, n in zip(pdf.itertuples(), prev, fill, idx)}
    order = ["ts", "id"]
    got_p = {r["id"]: r["p"] for r in previous_value(df, "k", order, "v", "p", bucket=bucket).collect()}
    got_f = {r["id"]: r["f"] for r in forward_fill(df, "k", order, "v", "f", bucket=bucket).collect()}
    got_i = {r["id"]: r["n"] for r in row_index(df, "k", order, "n", bucket=bucket).collect()}
    same = lambda a, b: (a is None and (b is None or b != b)) or a == b
    for i, (p, f, n) in exp.items():
        assert same(got_p[i], p) and same(got_f[i], f) and got_i[i] == n, i
