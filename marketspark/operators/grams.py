"""Substring joins through an index of character trigrams.

Which words (aliases, search strings) does a text contain?  Comparing every text with every word grows with
their product.  Here each word is filed under one gram: its rarest trigram among all words' trigrams, or the
whole word if it is shorter than three characters.  Texts are broken into their distinct grams, an equi-join on
the gram gives candidates, and ``contains`` confirms them.  A word that a text contains has all its
grams there, so none is missed.

Texts are identified by 128 bits of hash while their grams travel, so the text itself is neither copied per gram nor
needed in the index; equal texts are looked up once.  (Two texts with one hash would only add
candidates, which the confirmation on the text itself removes.)  Spark broadcasts a small index by its
measured size and splits hot grams of a large one (AQE); no list of words enters the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct overlapping substrings of ``size`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1))


def word_index(words: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` with ``_gram``: the gram each word is filed under (null words are left out)."""
    w = words.where(F.col(word_col).isNotNull())
    pieces = w.select(word_col).distinct().where(F.length(word_col) >= GRAM).select(word_col, F.explode(grams(F.col(word_col), GRAM)).alias("_gram"))
    use = pieces.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = pieces.join(use, "_gram").groupBy(F.col(word_col).alias("_word")).agg(F.min(F.struct("_n", "_gram")).alias("_least"))
    filed = w.join(rarest, F.col(word_col) == F.col("_word"), "left")
    return filed.select(*[w[c] for c in words.columns], F.coalesce("_least._gram", F.col(word_col)).alias("_gram"))


def _text_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct grams of the given sizes; size 0 is the empty word, which every text contains."""
    parts = [F.array(F.lit("")) if k == 0 else grams(text, k) for k in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def contained_words(texts: DataFrame, words: DataFrame, text_col: str = "text", word_col: str = "word", sizes=range(GRAM + 1)) -> DataFrame:
    """Candidates per distinct text: (_t1, _t2, _words), the rows of ``words`` that share its gram with the text.

    ``sizes`` are the gram sizes that occur in the index: 3, and 0 to 2 if there are words that short."""
    index = word_index(words, word_col)
    t = F.col(text_col)
    keyed = texts.where(t.isNotNull()).select(*text_key(t), t.alias("_text"))
    filed = keyed.select("_t1", "_t2", F.explode(_text_grams(F.col("_text"), list(sizes))).alias("_gram")).distinct()
    return filed.join(index, "_gram").groupBy("_t1", "_t2").agg(
        F.collect_list(F.struct(*[F.col(c) for c in words.columns])).alias("_words"))


def text_key(t: Column) -> list[Column]:
    return [F.xxhash64(t).alias("_t1"), F.xxhash64(F.lit(1), t).alias("_t2")]


def with_contained(texts: DataFrame, words: DataFrame, out: str, text_col: str = "text", word_col: str = "word") -> DataFrame:
    """``texts`` with ``out``: the array of all rows of ``words`` whose word the text contains (empty if none).

    The array is bounded by what the text itself contains, not by the table of words."""
    short = {r["n"] for r in words.where(F.length(word_col) < GRAM).select(F.length(word_col).alias("n")).distinct().collect()}   # 3 at most
    found = contained_words(texts, words, text_col, word_col, sorted(short | {GRAM}))
    t = F.col(text_col)
    j = texts.select("*", *text_key(t)).join(found, ["_t1", "_t2"], "left")
    kept = F.filter("_words", lambda w: F.contains(t, w[word_col]))
    empty = F.array().cast(found.schema["_words"].dataType)
    return j.withColumn(out, F.coalesce(kept, empty)).select(*texts.columns, out)


def search_many(names: DataFrame, queries: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """(query_id, ticker, name): every search against ticker and company name, ignoring case and outer spaces.

    A blank search matches all names, as in the single search."""
    q = queries.select(id_col, F.lower(F.trim(F.coalesce(query_col, F.lit("")))).alias("word"))
    n = names.select("ticker", "name")
    both = (n.withColumn("_text", F.lower("ticker")).unionByName(n.where(F.col("name").isNotNull()).withColumn("_text", F.lower("name"))))
    hits = with_contained(both, q, "_hits", "_text")
    return hits.select(F.explode("_hits").alias("h"), "ticker", "name").select(f"h.{id_col}", "ticker", "name").distinct()
