"""Exact top-k inner products with vector-approximation files.

Vectors are dealt by the hash of id and vector into blocks of bounded size, the queries into blocks of their own, and
every pair of a vector block and a query block is one task group: that is the whole work of a
stated query set against all rows, in pieces of bounded memory whatever keys or vectors repeat.

In a block each dimension is cut into ``CELLS`` cells at its quantiles and a vector is approximated
by its cells.  For a query, the cells' edges give an upper and a lower bound of the score:

1. Scan the approximations; vectors whose upper bound is below the kth largest lower bound are out.
2. Read the exact vectors in order of their upper bounds, best first, until the kth exact score
   exceeds every bound that is left.

Each group returns its k best per query, and a window keeps the k best of those.

Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does
a null id; vectors of different length are not compared; rows that share the query's id count as its own; a
vector repeated under other ids is found once per row; a query row repeated exactly counts once.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 16
BLOCK, QUERIES_AT_ONCE = 4096, 8192
READ = 32                 # exact vectors read between two looks at the next bound
SLICE = 128               # queries whose bounds are in memory at once


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def integers(vectors: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; exact Python integers where 64 bits might not hold a score."""
    values = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(over="ignore"):
        raw = np.floor(values * scale)
        if not raw.size or np.abs(raw).max() ** 2 * raw.shape[1] < 2.0 ** 62:
            return raw.astype(np.int64)
    exact = Fraction(scale)             # a component times the scale may be beyond every double
    return np.array([[floor(Fraction(x) * exact) for x in row] for row in values.tolist()], dtype=object).reshape(raw.shape)


def _huge(a: np.ndarray) -> bool:
    """Whether products of such components might leave the range of doubles."""
    return a.dtype == object and any(abs(x) >> 500 for x in a.reshape(-1))


class VAFile:
    """Quantised cells of a block of vectors, with the exact vectors behind them."""

    def __init__(self, vectors: np.ndarray):
        self.exact, self.huge = vectors, _huge(vectors)
        if self.huge:                   # no cells in doubles: every bound is open, all exact vectors are read
            return
        cuts = np.quantile(vectors.astype(np.float64), np.linspace(0, 1, CELLS + 1)[1:-1], axis=0)
        self.codes = np.stack([np.searchsorted(cuts[:, d], vectors[:, d].astype(np.float64), "right")
                               for d in range(vectors.shape[1])], axis=1).astype(np.uint8) if vectors.shape[1] else \
            np.zeros(vectors.shape, np.uint8)
        low, high = np.zeros((CELLS, vectors.shape[1])), np.zeros((CELLS, vectors.shape[1]))
        values = vectors.astype(np.float64)
        for c in range(CELLS):           # the tight edges of each cell
            inside = self.codes == c
            low[c] = np.where(inside, values, np.inf).min(axis=0)
            high[c] = np.where(inside, values, -np.inf).max(axis=0)
        dims = np.arange(vectors.shape[1])
        self.low, self.high = low[self.codes, dims], high[self.codes, dims]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.huge or _huge(queries):
            shape = (len(queries), len(self.exact))
            return np.full(shape, np.inf), np.full(shape, -np.inf)
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        upper = up @ self.high.T + down @ self.low.T
        lower = up @ self.low.T + down @ self.high.T
        # sums of large products may be rounded; widen by what rounding can take
        slack = (np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high)).T) * (q.shape[1] + 2) * 2.0 ** -52
        slack[slack < 1] = np.where(np.abs(upper[slack < 1]) < 2.0 ** 50, 0, 1)
        return upper + slack, lower - slack

    def search(self, query: np.ndarray, upper: np.ndarray, lower: np.ndarray, ids: np.ndarray, k: int):
        """Positions and scores of the k best: score descending, then id."""
        allowed = np.flatnonzero(upper > -np.inf)
        if len(allowed) > k:
            least = np.partition(lower[allowed], -k)[-k]
            allowed = allowed[upper[allowed] >= least]
        order = allowed[np.argsort(-upper[allowed], kind="stable")]
        found, scores = np.zeros(0, np.int64), self.exact[:0, 0] if self.exact.shape[1] else np.zeros(0, np.int64)
        for at in range(0, len(order), READ):
            if len(found) >= k and float(upper[order[at]]) < scores[k - 1]:
                break
            read = order[at: at + READ]
            found = np.concatenate([found, read])
            scores = np.concatenate([scores, self.exact[read] @ query])
            best = np.lexsort((ids[found], -scores))[:k] if scores.dtype != object else \
                np.array(sorted(range(len(found)), key=lambda i: (-scores[i], ids[found[i]]))[:k], np.int64)
            found, scores = found[best], scores[best]
        return found, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among ``vectors`` (all, if fewer), without
    rows that share its id, by the inner product of floor(scale * x); ties to the smaller id."""
    def clean(df):
        v = F.col(vector_col)
        return df.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.size(v).alias("dim"))

    base = clean(vectors)
    asked = clean(queries).withColumn("key", F.xxhash64("id", "v")).dropDuplicates(["id", "key", "dim"])
    blocks = max(1, -(-base.count() // BLOCK))
    parts = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    def deal(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = base.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("bigint").alias("block"), deal(parts).alias("part"), "id", "v")
    right = asked.select("dim", deal(blocks).alias("block"), F.pmod("key", F.lit(parts)).cast("bigint").alias("part"), "id", "key", "v")
    # the groups' (block, part) number is known beforehand and bounded by their sizes
    columns = ["query_id", "key", "vec_id", "score"]

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame(columns=columns).astype("int64")
        ids = data["id"].to_numpy(np.int64)
        file = VAFile(integers(data["v"], scale))
        qs, qids = integers(asked["v"], scale), asked["id"].to_numpy(np.int64)
        out = []
        for at in range(0, len(qs), SLICE):
            upper, lower = file.bounds(qs[at: at + SLICE])
            own = qids[at: at + SLICE, None] == ids[None, :]
            upper[own] = lower[own] = -np.inf
            for i in range(len(upper)):
                found, scores = file.search(qs[at + i], upper[i], lower[i], ids, k)
                # a score beyond 64 bits is returned as the nearest that fits
                scores = [max(-2**63, min(2**63 - 1, int(s))) for s in scores]
                out.append(pd.DataFrame({"query_id": qids[at + i], "key": asked["key"].iat[at + i], "vec_id": ids[found],
                                         "score": np.array(scores, np.int64)}))
        return pd.concat(out)

    near = (left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part"))
            .applyInPandas(search, "query_id bigint, key bigint, vec_id bigint, score bigint"))
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
