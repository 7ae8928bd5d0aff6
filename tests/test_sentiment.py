"""The reference's three sentiment sentences, for every scorer, plus scorer edges."""

import pytest
from pyspark.sql import functions as F

from marketspark.functions.sentiment import (NEGATIVE_WORDS, POSITIVE_WORDS, get_scorer, scale_score, score_keyword,
                                             tone_from_logits, with_scores)
from marketspark.operators.lexicon import score_lexicon

POS = "$TSLA is going to explode! Best stock ever 🚀🚀"
NEG = "$AAPL is a terrible investment, sales are crashing down. 📉"
NEU = "$MSFT is a stock."


def _scores(spark, fn):
    df = spark.createDataFrame([(1, POS), (2, NEG), (3, NEU)], "post_id long, text string")
    rows = {r["post_id"]: r for r in fn(df).collect()}
    return rows[1], rows[2], rows[3]


@pytest.mark.parametrize("scorer", ["keyword", "lexicon"])
def test_reference_sentences(spark, scorer):
    fn = (lambda d: with_scores(d, "text", "keyword")) if scorer == "keyword" else score_lexicon
    p, n, z = _scores(spark, fn)
    assert p["compound"] > 0.3 and p["pos"] > 0.1 and p["neg"] == 0.0
    assert n["compound"] < -0.3 and n["neg"] > 0.1 and n["pos"] == 0.0
    assert z["compound"] == 0.0


def test_keyword_exact_values(spark):
    p, n, z = _scores(spark, lambda d: with_scores(d, "text", "keyword"))
    assert (p["compound"], p["pos"], p["neg"], p["neu"]) == (1.0, 1.0, 0.0, 0.0)
    assert (n["compound"], n["neg"]) == (-1.0, 1.0)        # down, crash, 📉
    assert (z["compound"], z["pos"], z["neg"], z["neu"]) == (0.0, 0.0, 0.0, 1.0)


def test_keyword_counts_distinct_and_substrings(spark):
    df = spark.createDataFrame([("UP up up, bullish buyer; short",)], "text string")
    r = df.select(score_keyword(F.col("text")).alias("s")).first()["s"]
    # positive: up, bull, buy (each once); negative: short  -> (3 - 1) / 4
    assert r["compound"] == 0.5 and r["pos"] == 0.75 and r["neg"] == 0.25


def test_lexicon_values_and_negation(spark):
    p, n, _ = _scores(spark, score_lexicon)
    assert p["compound"] == 0.7184 and p["pos"] == 0.429
    assert n["compound"] == -0.7184 and n["neg"] == 0.429
    df = spark.createDataFrame([(1, "this is not good"), (2, "this is very good"), (3, "")],
                               "post_id long, text string")
    r = {x["post_id"]: x for x in score_lexicon(df).collect()}
    assert r[1]["compound"] < 0 < r[2]["compound"]
    assert r[2]["compound"] > 2 / (4 + 15) ** 0.5 - 1e-9
    assert r[3]["compound"] == 0.0


def test_lexicon_odd_rows(spark):
    import marketspark.operators.lexicon as LX
    rows = [(1, POS), (1, POS), (4, "bad"), (4, "surging"), (5, None), (6, ""), (None, "not very bad, never weak up"), (7, "custom word")]
    df = spark.createDataFrame(rows, "post_id long, text string")
    alone = {(i, t): r for i, t in rows for r in LX.score_lexicon(spark.createDataFrame([(99, t)], "post_id long, text string")).collect()}
    got = LX.score_lexicon(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r[c] for c in ("compound", "pos", "neg", "neu")] == [alone[r["post_id"], r["text"]][c] for c in ("compound", "pos", "neg", "neu")]
    assert all(r["compound"] == 0.0 for r in got if r["post_id"] in (5, 6))
    twice = spark.createDataFrame([("custom", 1.0), ("custom", 3.0)], "token string, valence double")
    once = spark.createDataFrame([("custom", 2.0)], "token string, valence double")
    assert LX.score_lexicon(df, twice).collect()[-1]["compound"] == LX.score_lexicon(df, once).collect()[-1]["compound"]


def test_tone_and_scale(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([0.0, 10.0, 0.0],)], "logits array<float>")
    r = df.select(tone_from_logits(F.col("logits")).alias("s")).collect()
    assert abs(r[0]["s"]["neu"] - 1 / 3) < 1e-12 and r[0]["s"]["compound"] == 0.0
    assert r[1]["s"]["compound"] > 0.99
    s = spark.createDataFrame([(0.99,), (-0.5,)], "c double").select(
        scale_score(F.struct(F.col("c").alias("compound"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"),
                             F.lit(1.0).alias("neu"))).alias("s")).collect()
    assert s[0]["s"]["compound"] == 1.0 and abs(s[1]["s"]["compound"] + 0.525) < 1e-12


def test_scorer_registry_case_insensitive():
    assert get_scorer("VADER") is get_scorer("keyword")
    assert get_scorer("unknown") is get_scorer("vader")


def test_scorer_chain_looks_for_each_word_once(spark):
    """However often the chain reads a score, the plan holds each scorer once."""
    df = spark.createDataFrame([(1, "up up"), (2, None), (3, "crash"), (4, "good")], "post_id long, text string")
    primary = lambda t: F.when(F.length(t) % 2 == 0, scale_score(score_keyword(t)))
    out = with_scores(df, "text", primary, fallback=score_keyword).select("post_id", "compound")
    assert {r["post_id"]: r["compound"] for r in out.collect()} == {1: 1.0, 2: 0.0, 3: -1.0, 4: 1.0}
    words = len(POSITIVE_WORDS) + len(NEGATIVE_WORDS)
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 2 * words


def test_fallback_chain_and_user_pandas_scorer(spark):
    import pandas as pd
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "up up"), (2, None), (3, "crash")], "post_id long, text string")

    def nothing(text):  # a primary scorer that yields no score
        return F.struct(*[F.lit(None).cast("double").alias(f) for f in ("compound", "pos", "neg", "neu")])

    got = {r["post_id"]: r["compound"] for r in with_scores(df, "text", nothing, fallback=score_keyword).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: -1.0}

    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in ("compound", "pos", "neg", "neu")])

    @F.pandas_udf(schema)
    def length_scorer(s: pd.Series) -> pd.DataFrame:
        n = s.fillna("").str.len().astype(float)
        return pd.DataFrame({"compound": (n - 3) / 10, "pos": n * 0, "neg": n * 0, "neu": n * 0 + 1})

    got = {r["post_id"]: r["compound"] for r in with_scores(df, "text", length_scorer).collect()}
    assert got == {1: 0.2, 2: -0.3, 3: 0.2}
