"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text becomes a vector of hashed character n-grams (1 to 3 characters, words padded with a
blank, letters only), weighted by log(1 + tf) * idf and scaled to length one.  Each language has
``CLUSTERS`` centroids, found by spherical k-means over its own sample, so a language with
several registers is not squeezed into one mean.  A text takes the language of the centroid with the
largest cosine.  Each centroid also has a radius, the cosine that all but a hundredth of its own
members reach; a text farther out is marked ``rejected``.

Learning uses at most ``PER_LANG`` labelled texts a language, chosen by id hash.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, rejected; very long texts are counted
whole; of centroids at the same cosine the first language in code-point order is taken; repeated rows each get
the same result, and repeated ids count once in the sample's choice but with each of their texts; without a
labelled text everything is ``und``; only doc_id, lang and text are read, so further columns cannot clash; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketspark.llm.common import bound_batches, fold, staged
from marketspark.operators.skew import skew_join

PER_LANG = 1000          # bound on labelled texts a language is learned from
CLUSTERS = 3
SPARE = 1.5              # ids ranked per id wanted
MOST_IDS = 500_000       # ids that are sent to every task (16 bytes each)
BITS = 12                # 2 ** BITS hashed features
LONGEST = 3              # n-gram length
CHUNK = 1 << 18          # characters hashed at once
OUTSIDE = 0.01           # share of a centroid's members beyond its radius
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text, null if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    clean = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    counts = np.zeros(1 << BITS, np.int64)
    # chunks overlap by LONGEST - 1 characters, which start no n-gram in the earlier one
    for at in range(0, max(1, len(clean) - LONGEST + 1), CHUNK):
        code = np.frombuffer(clean[at: at + CHUNK + LONGEST - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        key = np.zeros(len(code), np.uint32)
        for n in range(1, LONGEST + 1):
            key = (key[: len(code) - n + 1] * np.uint32(31)) ^ (code[n - 1:] * _MIX[n - 1])
            mixed = (key ^ (key >> np.uint32(15))) * _MIX[0]
            counts += np.bincount(mixed[:CHUNK] >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]             # of each centroid
    centroids: np.ndarray
    radius: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return "und", 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(near.argmax())
        return self.langs[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.radius[best])


def labelled_sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, text) of the up to ``per_lang`` texts of least id hash a language; fold 2 and null ids, langs and texts stay out.

    A language's ids are thinned by the hash itself before they are ranked, to SPARE times as many as wanted, so
    the ranking of a hot language reads no more rows than that of a rare one."""
    known = (docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id")) != 2)
             .select("doc_id", "lang").distinct())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = (F.xxhash64("doc_id").cast("double") + 2.0 ** 63) / 2.0 ** 64
    few = skew_join(known, counts.withColumnRenamed("n", "of"), ["lang"], counts=counts).where(place * F.col("of") <= SPARE * per_lang)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = staged(few.select("doc_id", "lang").withColumn("nth", rank).where(F.col("nth") <= per_lang).select("doc_id", "lang"), "langid-ids")
    # per_lang ids a language; a table with very many languages is joined as any other
    sent = F.broadcast(chosen) if chosen.count() <= MOST_IDS else chosen
    return docs.where("text is not null").select("doc_id", "lang", "text").join(sent, ["doc_id", "lang"]).select("lang", "text")


def _cluster(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out seeds; returns centroids and the members' cluster."""
    seeds = [int((vectors @ vectors.mean(axis=0)).argmax())]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centroids, own = vectors[seeds], None
    for _ in range(20):
        now = (vectors @ centroids.T).argmax(axis=1)
        if own is not None and np.array_equal(now, own):
            break
        own = now
        used = [c for c in range(len(centroids)) if (own == c).any()]
        sums = np.stack([vectors[own == c].sum(axis=0) for c in used])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    own = (vectors @ centroids.T).argmax(axis=1)
    return centroids, own


def learn(docs: DataFrame, per_lang: int = PER_LANG, clusters: int = CLUSTERS) -> Model:
    """Fit idf and centroids.  Without a labelled text the model predicts ``und`` only."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(lang, c) for lang, text in zip(b["lang"], b["text"]) if (c := ngram_counts(text)) is not None]
            yield pd.DataFrame({"lang": [r[0] for r in rows],
                                "counts": [np.minimum(r[1], 2**31 - 1).astype(np.int32) for r in rows]}, columns=["lang", "counts"])

    bound_batches(docs.sparkSession)
    sample = staged(labelled_sample(docs, per_lang).mapInPandas(count, "lang string, counts array<int>"), "langid")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for c in b["counts"]:
                df += c > 0
                n += 1
        yield pd.DataFrame({"feature": np.arange(-1, 1 << BITS), "df": np.concatenate([[n], df])})

    total = (sample.select("counts").mapInPandas(seen, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))
             .toPandas().set_index("feature")["df"])                      # 2 ** BITS + 1 rows
    n = int(total.get(-1, 0))
    df = total.reindex(range(1 << BITS), fill_value=0).to_numpy()
    idf = np.log((n + 1) / (df + 1)) + 1

    def fit(key, group: pd.DataFrame) -> pd.DataFrame:
        model = Model(idf, [], None, None)
        vectors = np.stack([model.vector(c).astype(np.float32) for c in group["counts"]])
        centroids, own = _cluster(vectors, clusters)
        near = (vectors * centroids[own]).sum(axis=1)
        rows = [(key[0], c.tolist(), float(np.quantile(near[own == i], OUTSIDE))) for i, c in enumerate(centroids) if (own == i).any()]
        return pd.DataFrame(rows, columns=["lang", "centroid", "radius"])

    found = sample.groupBy("lang").applyInPandas(fit, "lang string, centroid array<float>, radius double").toPandas()
    found = found.sort_values(["lang", "radius"], kind="stable")
    if not len(found):
        return Model(idf, [], np.zeros((0, 1 << BITS)), np.zeros(0))
    return Model(idf, list(found["lang"]), np.stack(list(found["centroid"])).astype(np.float64), found["radius"].to_numpy())


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, rejected) of each whole text.

    Null texts and texts without a letter give ``und`` with score 0, rejected."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def of(col: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang_pred", "score", "rejected"), model.predict(t.as_py()))) for t in col], kind)
    return of(text)
