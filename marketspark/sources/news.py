"""News items -> posts.

Items carry (title, description?, pubDate?).  They come from an RSS/XML feed read with
Spark's XML source (``read_rss``) or from stored web pages (``page_items``: the page
title and the text of its first paragraph).  Each item becomes a post whose text is
"$T News: {title}. {first 100 characters of description}" with a stable id derived from
the title, so repeated headlines share one id (see ``dedupe``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the news-to-post projection.
NEWS_USERNAME = "YahooFinanceNews"
NEWS_SOURCE = "Yahoo Finance RSS"
NEWS_FOLLOWERS = 1_500_000
NEWS_CONFIDENCE, NEWS_BOT = 0.95, 0.05
DESCRIPTION_CHARS = 100
# RFC 822 dates without the day's name, with an offset or a zone's name
PUB_DATE_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"]
# ---------------------------------------------------------------------------


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS items (title, description, pubDate); missing tags read as NULL."""
    return (spark.read.format("xml").option("rowTag", "item")
            .schema("title string, description string, pubDate string").load(path))


def page_items(pages: DataFrame) -> DataFrame:
    """(page_id, title, description) from raw HTML: <title> text and first <p> text."""
    html = F.col("html")
    title = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    para = F.regexp_extract(html, r"(?s)<p>(.*?)</p>", 1)
    desc = F.regexp_replace(para, r"<[^>]*>", "")
    return pages.select("page_id", title.alias("title"), F.nullif(desc, F.lit("")).alias("description"))


def news_id(title: Column) -> Column:
    """Stable id from the headline (the reference's salted hash is not reproducible): its full digest,
    so different headlines stay apart at any volume."""
    return F.concat(F.lit("news_"), F.md5(title))


def pub_date(text: Column) -> Column:
    """A feed's date: RFC 822 or ISO; NULL if neither."""
    text = F.trim(text)
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in PUB_DATE_FORMATS], F.try_to_timestamp(text))


def news_to_posts(items: DataFrame, ticker: Column, ts: Column | None = None) -> DataFrame:
    text = F.concat(F.lit("$"), ticker, F.lit(" News: "), F.col("title"), F.lit(". "),
                    F.substring(F.coalesce(F.col("description"), F.lit("")), 1, DESCRIPTION_CHARS))
    return items.select(news_id(F.col("title")).alias("id"), ticker.alias("ticker"), text.alias("text"),
                        F.lit(NEWS_USERNAME).alias("username"),
                        (ts if ts is not None else pub_date(F.col("pubDate"))).alias("timestamp")
                        if "pubDate" in items.columns or ts is not None
                        else F.lit(None).cast("timestamp").alias("timestamp"),
                        F.lit(NEWS_FOLLOWERS).alias("followers"), F.lit(NEWS_SOURCE).alias("source"),
                        F.lit(NEWS_CONFIDENCE).alias("confidence_score"), F.lit(NEWS_BOT).alias("bot_probability"),
                        *[c for c in ("page_id",) if c in items.columns])
