"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning (labelled rows outside fold 2, a sample bounded by ``SAMPLE_ROWS``):

* Tokens are counted by distinct contexts (the words before and after), in toxic and in clean
  documents: copies of a document, however many, add nothing to what one of them says.
* Each token's toxic share is smoothed by a Dirichlet prior.  The prior
  is hierarchical: a word's prior mean is the estimate of its longest known prefix, a prefix's that
  of the next shorter one, down to the base rate.  So a word never seen in the sample takes the
  log-odds of the beginning it shares with known words.  Rows of folds 0 and 1 give the counts.
* Only entries whose log-odds exceed ``ODDS_MIN``, beyond doubt (``Z_MIN`` standard errors), are kept;
  all other tokens score ``-DRIFT``, which makes the expected score negative, as the theory of
  maximal segments requires.
* On clean documents of fold 3 the best segment's score follows an extreme-value law,
  P(S >= x) = 1 - exp(-K n exp(-lambda x)).  lambda is the positive root of E[exp(lambda s)] = 1 over
  clean tokens (Karlin and Altschul), K is matched to how often clean documents hold a segment.
* A document's statistic sums its significant segments' -ln(K n exp(-lambda x)) (at least 0); a one-variable
  logistic fit on fold 3 turns it into the probability of label 1.

Scoring reads whole texts: one linear pass (Ruzzo and Tompa) finds all maximal segments.

Defined cases: null, empty and word-free texts have the score of a text without a passage; very long texts are read whole;
adjoining segments of equal score stay apart, as maximal segments are unique; repeated rows each get the same score;
repeated labels of an id count once, as toxic if any says so; without both labels every text scores
the same low value; only doc_id, text and toxic are read, so further columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import bound_batches, fold, staged

SAMPLE_ROWS = 12_000     # bound on labelled rows a model is learned from
PREFIXES = (3, 4, 5, 6, 8)
PRIOR = 2.0              # pseudo-contexts of a prior
ODDS_MIN = 1.5
Z_MIN = 3.0
DRIFT = 0.25
TOP_SCORE = 8.0
CONTEXTS_AT_ONCE, WORDS_KNOWN = 50_000, 100_000    # what a worker holds in memory
WORD = re.compile(r"\w+")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)       # positive log-odds of words and, as "pre*", prefixes
    known: frozenset = frozenset()                              # words seen often enough to stand for themselves
    lam: float = 1.0
    log_k: float = 0.0
    bias: float = -2.0
    slope: float = 0.0

    def token(self, word: str) -> float:
        got = self.words.get(word)
        if got is None and word not in self.known:
            for n in reversed(PREFIXES):
                if len(word) > n and (got := self.words.get(word[:n] + "*")) is not None:
                    break
        return -DRIFT if got is None else got


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a score sequence, in linear time.

    Runs of equal sign act as one item, so long neutral stretches cost one step."""
    if not len(scores):
        return []
    sign = scores > 0
    edges = np.flatnonzero(np.diff(sign)) + 1
    starts = np.concatenate([[0], edges])
    sums = np.add.reduceat(scores, starts)
    ends = np.concatenate([edges, [len(scores)]]) - 1
    total, stack = 0.0, []                    # of (first, last, sum before it, sum through it)
    for a, z, s in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        seg = (a, z, before, total)
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= seg[2]:
                j -= 1
            if j < 0 or stack[j][3] >= seg[3]:
                break
            seg = (stack[j][0], seg[1], stack[j][2], seg[3])
            del stack[j:]
            j -= 1
        stack.append(seg)
    return [(a, z, r - l) for a, z, l, r in stack]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments over them."""
        words = WORD.findall(text.lower()) if text else []
        seen, token = self.seen, self.model.token
        if len(seen) > WORDS_KNOWN:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = token(w)
        scores = np.fromiter(map(seen.__getitem__, words), np.float64, len(words))
        return len(words), maximal_segments(scores)

    def statistic(self, n: int, segments) -> float:
        m = self.model
        return sum(max(0.0, m.lam * s - m.log_k - math.log(n)) for _, _, s in segments)

    def score(self, n: int, segments) -> float:
        x = self.model.bias + self.model.slope * math.log1p(self.statistic(n, segments))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def passages(self, text: str | None, e_max: float = 0.05) -> list[tuple[int, int, float, float]]:
        """Significant passages as (first character, end, score, expected number by chance)."""
        n, segments = self.segments(text)
        if not segments:
            return []
        low = text.lower()
        spans = [m.span() for m in WORD.finditer(low)]
        if len(low) != len(text):       # a letter may have several in lower case: back to the places in the text
            starts = list(accumulate((len(c.lower()) for c in text), initial=0))
            spans = [(bisect_right(starts, a) - 1, bisect_left(starts, z)) for a, z in spans]
        out = []
        for a, z, s in segments:
            e = math.exp(min(700.0, self.model.log_k + math.log(n) - self.model.lam * s))
            if e <= e_max:
                out.append((spans[a][0], spans[z][1], s, e))
        return out


# --- learning --------------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Distinct (fold, text, toxic) of up to ``rows`` labelled documents outside fold 2, chosen by id hash.

    Repeated labels of a document count once, as toxic if any says so; null labels and ids are skipped."""
    marks = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.where("text is not null").select("doc_id", "text")
    # the sample's size is bounded by ``rows`` ids, so it can be sent to every task
    return texts.join(F.broadcast(marks), "doc_id").select("fold", "text", (F.col("toxic") == 1).alias("toxic")).distinct()


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, hash of its neighbours, label) of the texts, distinct in every CONTEXTS_AT_ONCE or so."""
    columns = ["word", "ctx", "toxic"]
    for b in batches:
        seen: set[tuple[str, int, int]] = set()
        for text, toxic in zip(b["text"], b["toxic"]):
            words = ["", *WORD.findall(text.lower()), ""]
            label = int(toxic)
            seen.update((w, xxhash.xxh64_intdigest(f"{x} {y}") - 2**63, label) for x, w, y in zip(words, words[1:], words[2:]))
            if len(seen) > CONTEXTS_AT_ONCE:
                yield pd.DataFrame(list(seen), columns=columns)
                seen.clear()
        yield pd.DataFrame(list(seen), columns=columns)


def _log_odds(counts: pd.DataFrame, clean: int, toxic: int) -> dict[str, float]:
    """Hierarchically smoothed log-odds of the entries that are surely positive."""
    base = (toxic + 1) / (clean + toxic + 2)
    table = {e: (c, t) for e, c, t in zip(counts["entry"], counts["clean"], counts["toxic"])}
    share: dict[str, float] = {}

    def prior(entry: str) -> float:
        stem = entry.rstrip("*")
        for n in reversed(PREFIXES):
            if n < len(stem):
                above = stem[:n] + "*"
                if above in table:
                    return estimate(above)
        return base

    def estimate(entry: str) -> float:
        if entry not in share:
            c, t = table[entry]
            share[entry] = (t + PRIOR * prior(entry)) / (c + t + PRIOR)
        return share[entry]

    logit = lambda p: math.log(p / (1 - p))
    zero, words = logit(base), {}
    for entry, (c, t) in table.items():
        p = min(max(estimate(entry), 1e-9), 1 - 1e-9)
        odds, weight = logit(p) - zero, c + t + PRIOR
        # of the error at the estimate and at the base rate the smaller; the first vanishes for pure entries
        error = min(math.sqrt(1 / (weight * p * (1 - p))), math.sqrt(1 / (weight * base * (1 - base))))
        if odds >= max(ODDS_MIN, Z_MIN * error):
            words[entry] = min(odds, TOP_SCORE)
    return words


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model.  Without both labels in the sample every text scores the same low value."""
    bound_batches(docs.sparkSession)
    sample = staged(labelled_sample(docs, labels, rows), "toxic-sample")
    train = sample.where("fold in (0, 1)")
    contexts = train.select("text", "toxic").mapInPandas(_contexts, "word string, ctx long, toxic int").distinct()
    words = staged(contexts.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    stems = F.filter(F.array(*[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]),
                     lambda x: x.isNotNull())
    both = words.union(words.select(F.explode(stems), "clean", "toxic").groupBy("col").agg(F.sum("clean"), F.sum("toxic")))
    counts = staged(both.toDF("entry", "clean", "toxic"), "toxic-counts")
    clean, toxic = words.agg(F.sum("clean"), F.sum("toxic")).first()
    if not clean or not toxic:
        return Model()
    # what comes to the driver is counted over a sample of bounded size, and entries that are hardly
    # ever toxic stay behind, but for words that would inherit from the prefixes found
    words = _log_odds(counts.where("toxic > 1").toPandas(), clean, toxic)
    found = [w[:-1] for w in words if w.endswith("*")]
    heirs = F.lit(False)
    for n in PREFIXES:
        heirs = heirs | F.substring("entry", 1, n).isin([w for w in found if len(w) == n])
    known = counts.where(~F.col("entry").endswith("*") & (F.col("clean") + F.col("toxic") >= 3) & heirs).select("entry").toPandas()
    model = Model(words, frozenset(known["entry"]) - words.keys())

    def look(batches):
        scorer = Scorer(model)
        for b in batches:
            rows = []
            for text, label in zip(b["text"], b["toxic"]):
                n, segments = scorer.segments(text)
                scores = sorted((s for _, _, s in segments), reverse=True)
                found = np.fromiter((scorer.seen[w] for w in WORD.findall(text.lower())), np.float64)
                kinds, times = np.unique(np.round(found[found > 0], 3), return_counts=True)
                rows.append((int(label), n, scores, kinds.tolist(), times.tolist()))
            yield pd.DataFrame(rows, columns=["toxic", "n", "scores", "kinds", "times"])

    seen = (sample.where("fold = 3").mapInPandas(look, "toxic int, n long, scores array<double>, kinds array<double>, times array<long>")
            .toPandas())
    return _calibrate(model, seen)


def _calibrate(model: Model, seen: pd.DataFrame) -> Model:
    clean = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    tokens = int(clean["n"].sum())
    times: dict[float, int] = {}
    for kinds, counts in zip(clean["kinds"], clean["times"]):
        for k, t in zip(kinds, counts):
            times[k] = times.get(k, 0) + int(t)
    # one pseudo-token at the top score keeps the law proper when clean text holds no positive token
    times[TOP_SCORE] = times.get(TOP_SCORE, 0) + 1
    positive = sum(times.values())
    neutral = max(tokens - positive, positive * 20)

    def moment(lam: float) -> float:
        return (neutral * math.exp(-lam * DRIFT) + sum(t * math.exp(lam * k) for k, t in times.items())) / (neutral + positive) - 1

    lo, hi = 1e-6, 1e-6
    while hi < 50 and moment(hi) <= 0:
        hi *= 1.5
    lo = hi / 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) <= 0 else (lo, mid)
    model.lam = max(lo, 1e-3)
    # the best segment of a clean document has median ln(K n / ln 2) / lambda
    best = np.array([model.lam * (s[0] if len(s) else 0.0) - math.log(n) for n, s in zip(clean["n"], clean["scores"])])
    model.log_k = float(np.median(best)) + math.log(math.log(2)) if len(best) else 0.0
    scorer = Scorer(model)
    x = np.array([math.log1p(scorer.statistic(int(n), [(0, 0, s) for s in scores])) if n else 0.0
                  for n, scores in zip(seen["n"], seen["scores"])])
    y = seen["toxic"].to_numpy(float)
    if not len(y):
        return model
    # logistic fit by Newton steps with a weak pull towards a positive slope
    w = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.5])
    a = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.array([0.0, 0.01 * (w[1] - 1)])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-6, 0.01]), a.T @ (y - p) - pull)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(w[0]), float(max(w[1], 0.0))
    return model


# --- scoring ---------------------------------------------------------------------------------

def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for each whole text; null and empty texts have the score of no passage."""
    made: list[Scorer] = []

    @F.arrow_udf("double")
    def of(col: pa.Array) -> pa.Array:
        if not made:
            made.append(Scorer(model))
        return pa.array([made[0].score(*made[0].segments(t.as_py())) for t in col], pa.float64())
    return of(text)


def passages(text: Column, model: Model, e_max: float = 0.05) -> Column:
    """array of (first, end, score, expected): the significant toxic passages of each whole text."""
    made: list[Scorer] = []

    @F.pandas_udf("array<struct<first:int,end:int,score:double,expected:double>>")
    def of(col: pd.Series) -> pd.Series:
        if not made:
            made.append(Scorer(model))
        return pd.Series([[dict(zip(("first", "end", "score", "expected"), p)) for p in made[0].passages(t, e_max)] for t in col])
    return of(text)
