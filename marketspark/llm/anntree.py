"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, chosen by id hash): a node's unit vectors are cut
into ``BRANCH`` clusters until a cluster has ``LEAF`` sample vectors or fewer.  Every row is then
indexed: it descends to the leaf of the nearest centroids.

A search keeps the tree's open branches in a priority queue by their centroid's distance to the
query, takes the nearest, and goes on until it has visited as many leaves as calibration found
necessary: for up to ``CALIBRATE`` of the queries the true neighbours among all rows are computed, and the
number of visited leaves widens until the leaves hold ``RECALL`` of them.

Rows are grouped by bins of neighbouring leaves; a leaf with more than ``BIN`` rows, however hot, is dealt
over several bins by a number counted up along the rows.  A query goes once to every bin that holds a leaf it
visits; the visits of each bin are counted first, and a bin that more than ``AT_ONCE`` queries visit is
copied to as many parts as these need, so a task's group is bounded on both sides.  Each query walks the
tree once, in tasks sized by the bins they will name.  Found
rows are ranked by the cosine of the original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and null ids, take
no part; vectors of another length than most of the sample neither; rows that share the query's id count as its own; a
query row repeated exactly counts once; equal cosines go by the smaller id; an empty table of vectors, or of queries, gives no
rows; only the two named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketspark.llm.common import staged
from marketspark.llm.vafile import usable

SAMPLE, BRANCH, LEAF = 20_000, 8, 64
CALIBRATE, RECALL = 128, 0.97
BIN, AT_ONCE = 1024, 8192
WALKS = 1 << 16         # bins named by the queries of one task, about


@dataclass
class Node:
    centroids: np.ndarray | None = None
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(vectors) -> np.ndarray:
    """Vectors as rows of doubles, scaled by a power of two so that squares stay finite; cosines keep every bit."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; seeds are picked evenly along the first principal direction."""
    mean = x.mean(axis=0)
    axis = np.linalg.svd((x - mean)[:2000], full_matrices=False)[2][0]
    order = np.argsort(x @ axis, kind="stable")
    centroids = x[order[np.linspace(0, len(x) - 1, k).astype(int)]]
    own = None
    for _ in range(rounds):
        now = (x @ centroids.T).argmax(axis=1)
        if own is not None and np.array_equal(own, now):
            break
        own = now
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    own = (x @ centroids.T).argmax(axis=1)
    used = [c for c in range(k) if (own == c).any()]
    return centroids[used], np.searchsorted(used, own)


class Tree:
    def __init__(self, sample: np.ndarray):
        numbers = count()

        def grow(x: np.ndarray) -> Node:
            if len(x) > LEAF:
                centroids, own = kmeans(x, BRANCH)
                if len(centroids) > 1:
                    return Node(centroids, [grow(x[own == c]) for c in range(len(centroids))])
            return Node(leaf=next(numbers))          # equal vectors cannot be cut further

        self.root = grow(unit(sample))
        self.leaves = next(numbers)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
                continue
            near = (x[rows] @ node.centroids.T).argmax(axis=1)
            todo += [(child, rows[near == c]) for c, child in enumerate(node.children) if (near == c).any()]
        return out

    def visit(self, query: np.ndarray, leaves: int, sizes: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """The first ``leaves`` leaves, best bin first, and more until they hold ``rows`` rows."""
        order, held, tie, queue = [], 0, count(), [(0.0, 0, self.root)]
        while queue and (len(order) < leaves or held < rows):
            _, _, node = heappop(queue)
            if node.leaf >= 0:
                order.append(node.leaf)
                held += sizes.get(node.leaf, 0) if sizes else 0
                continue
            for distance, child in zip((1 - node.centroids @ query).tolist(), node.children):
                heappush(queue, (distance, next(tie) + 1, child))
        return order


def nearest(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``rows``, the k of largest cosine: ids and cosines, ties to the smaller id."""
    score = (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def _local(data: pd.DataFrame, asked: pd.DataFrame, k: int, visits: bool) -> pd.DataFrame:
    """Each query's k nearest among the group's rows - with ``visits`` those in leaves it visits."""
    ids, leaf, rows = data["id"].to_numpy(np.int64), data["leaf"].to_numpy(np.int64), matrix(data["v"])
    units = unit(rows)
    out = []
    for qid, key, v, seen in zip(asked["id"], asked["key"], asked["v"], asked["leaves"] if visits else [None] * len(asked)):
        q = matrix([v])[0]
        rough = units @ (q / np.linalg.norm(q))
        rough[ids == qid] = -np.inf
        if visits:
            rough[~np.isin(leaf, seen)] = -np.inf
        some = np.flatnonzero(rough > -np.inf)
        if len(some) > k:       # whatever rounding leaves in doubt is ranked by the exact measure
            some = some[rough[some] >= np.partition(rough[some], -k)[-k] - 1e-9]
        found, score = nearest(q, ids[some], rows[some], k)
        lookup = dict(zip(ids[some].tolist(), leaf[some].tolist()))
        out += [(int(qid), int(key), i, s, lookup[i]) for i, s in zip(found.tolist(), score.tolist())]
    return pd.DataFrame(out, columns=["query_id", "key", "vec_id", "score", "leaf"]).astype(
        {"query_id": "int64", "key": "int64", "vec_id": "int64", "score": "float64", "leaf": "int64"})


FOUND = "query_id bigint, key bigint, vec_id bigint, score double, leaf bigint"


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Index:
    """The tree with every row filed under its leaf, and the number of leaves to visit."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.id_col, self.vector_col = id_col, vector_col
        rows = self._clean(vectors)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        self.dim = int(sample["v"].map(len).mode().iloc[0]) if len(sample) else 0
        sample = sample[sample["v"].map(len) == self.dim]
        self.tree = Tree(matrix(sample["v"])) if len(sample) else None
        tree = self.tree

        def file(batches):
            salt = TaskContext.get().partitionId()      # counts on from there: equal rows are dealt evenly, too
            for b in batches:
                yield b.assign(leaf=tree.assign(unit(matrix(b["v"]))) if len(b) else [], salt=np.arange(salt, salt + len(b)))
                salt += len(b)

        rows = rows.where(F.size("v") == self.dim)
        self.rows = staged(rows.mapInPandas(file, "id bigint, v array<double>, leaf bigint, salt bigint"), "index") if tree else None
        if tree:
            self.sizes = {r["leaf"]: r["count"] for r in self.rows.groupBy("leaf").count().collect()}     # one row a leaf
            self._deal(self.sizes)

    def _clean(self, df: DataFrame) -> DataFrame:
        v = F.col(self.vector_col)
        real = F.exists(v, lambda x: x.cast("double") != 0)
        return (df.where(F.col(self.id_col).isNotNull() & usable(v) & real)
                .select(F.col(self.id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v")))

    def _deal(self, sizes: dict[int, int]) -> None:
        """Leaves into bins of about BIN rows: small neighbours share one, a large one has several."""
        self.first, self.parts, at, filled = {}, {}, 0, 0
        for leaf in range(self.tree.leaves):
            n = sizes.get(leaf, 0)
            if filled and filled + n > BIN:
                at, filled = at + 1, 0
            parts = max(1, -(-n // BIN))
            self.first[leaf], self.parts[leaf] = at, parts
            at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)

    def _bin(self, leaf: Column, salt: Column) -> Column:
        table = F.create_map(*[x for leaf_ in self.first for x in (F.lit(leaf_).cast("bigint"), F.struct(F.lit(self.first[leaf_]), F.lit(self.parts[leaf_])))])
        place = F.element_at(table, leaf)
        return (place["col1"] + F.pmod(salt, place["col2"])).cast("int")

    def _queries(self, queries: DataFrame) -> DataFrame:
        return (self._clean(queries).where(F.size("v") == self.dim).withColumn("key", F.xxhash64("id", "v")).dropDuplicates(["id", "key"]))

    def calibrate(self, queries: DataFrame, k: int) -> int:
        """Leaves to visit so that RECALL of the true neighbours of a bounded set of queries are met."""
        some = self._queries(queries).orderBy(F.xxhash64("key"), "id").limit(CALIBRATE).toPandas()
        shared = self.rows.sparkSession.sparkContext.broadcast(some)

        def scan(batches):
            for b in batches:
                if len(b):
                    yield _local(b, shared.value, k, False)

        true = _best(self.rows.mapInPandas(scan, FOUND), k).toPandas()          # CALIBRATE * k rows
        if not len(true):
            return 1
        place = {}
        for qid, key, v in zip(some["id"], some["key"], some["v"]):
            order = self.tree.visit(unit(matrix([v]))[0], self.tree.leaves)
            place[qid, key] = {leaf: i for i, leaf in enumerate(order)}
        depth = np.sort([place[q, key][leaf] + 1 for q, key, leaf in zip(true["query_id"], true["key"], true["leaf"])])
        return int(depth[min(len(depth) - 1, int(np.ceil(RECALL * len(depth))) - 1)])

    def _dealt(self, queries: DataFrame, k: int, leaves: int) -> tuple[DataFrame, DataFrame]:
        """The rows and the queries by (bin, part), about BIN and AT_ONCE of them at most in each."""
        tree, first, parts, sizes = self.tree, self.first, self.parts, self.sizes
        # rows of the query's own id are no candidates, so as many more must be met
        own = self.rows.groupBy("id").count().where("count > 1").withColumnRenamed("count", "own")
        asked = self._queries(queries).join(own, "id", "left").fillna(1, ["own"])

        def walk(batches):
            for b in batches:
                rows = []
                for qid, v, key, own_rows in zip(b["id"], b["v"], b["key"], b["own"]):
                    bins: dict[int, list[int]] = {}
                    for leaf in tree.visit(unit(matrix([v]))[0], leaves, sizes, k + int(own_rows)):
                        for part in range(parts[leaf]):
                            bins.setdefault(first[leaf] + part, []).append(leaf)
                    rows.append((qid, v, key, list(bins), list(bins.values())))
                yield pd.DataFrame(rows, columns=["id", "v", "key", "bins", "seen"])

        # each query walks the tree once, in tasks of about WALKS bins each, and its list is stored
        bins = max(first[leaf] + parts[leaf] for leaf in first)
        tasks = max(1, -(-asked.count() * min(bins, max(1, leaves)) // WALKS))
        walked = staged(asked.repartition(tasks).mapInPandas(
            walk, "id bigint, v array<double>, key bigint, bins array<int>, seen array<array<bigint>>"), "walks")
        # how many parts the queries of each bin need: one number a bin
        visits = walked.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
        cut = staged(visits.select("bin", F.ceil(F.col("n") / AT_ONCE).cast("int").alias("pieces")), "visits")
        each = walked.select("id", "v", "key", F.explode(F.arrays_zip("bins", "seen")).alias("b")).select("id", "v", "key", F.col("b.bins").alias("bin"), F.col("b.seen").alias("leaves"))
        # one row a bin of the index, which is smaller than the visits by far
        asked = each.join(cut, "bin").select("bin", F.pmod("key", "pieces").cast("int").alias("part"), "id", "v", "key", "leaves")
        data = self.rows.withColumn("bin", self._bin(F.col("leaf"), F.col("salt"))).join(cut, "bin")     # unvisited bins drop out
        return data.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces"), asked

    def search(self, queries: DataFrame, k: int, leaves: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score): each query's k nearest found, nearest first."""
        if self.tree is None:
            return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        data, asked = self._dealt(queries, k, leaves or self.calibrate(queries, k))

        def look(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(asked):
                return pd.DataFrame(columns=["query_id", "key", "vec_id", "score", "leaf"]).astype({"score": "float64"})
            return _local(rows, asked, k, True)

        found = data.groupBy("bin", "part").cogroup(asked.groupBy("bin", "part")).applyInPandas(look, FOUND)
        return _best(found, k).select("query_id", "rank", "vec_id", "score")
