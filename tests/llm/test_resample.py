"""Importance resampling: CRC matrices against zlib, scores and draws against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketspark.llm import resample
from tests.llm.helpers import docs, prose, rows


def packed(words):
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def test_crc_matrices_equal_zlib():
    r = random.Random(1)
    words = [r.randbytes(n) for n in [*range(0, 40), 255, 256, 257, 511, 512, 513, 5000, 5000, 300_000] for _ in range(3)]
    r.shuffle(words)
    assert resample.crc32(*packed(words)).tolist() == [zlib.crc32(w) for w in words]
    assert resample.crc32(*packed([])).tolist() == []


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_features(text, lo=1, hi=1):
    w = slow_words(text)
    return [" ".join(w[i:i + k]) for k in range(lo, hi + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("lo,hi", [(1, 1), (1, 3), (2, 2)])
def test_features_of_a_batch(lo, hi):
    texts = ["Hello wOrld é-a 12 ;x", None, "", "  ", "a", "É ÀB c" * 5, prose(3, 500), "€uro" * 400]
    doc, bucket, counts = resample.features(pa.array([None if t is None else t.encode() for t in texts]), lo, hi, 10_000)
    want = [(i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in slow_features(t, lo, hi)]
    assert sorted(zip(doc.tolist(), bucket.tolist())) == sorted(want)
    assert counts.tolist() == [len(slow_words(t)) for t in texts]


def slow_resample(table, target, percent=10, seed="2024", lo=1, hi=1, buckets=10_000, least=20):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in slow_features(t, lo, hi))

    s, t = count(x for _, x in table), count(x for x in target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in table:
        found = [zlib.crc32(f.encode()) % buckets for f in slow_features(text, lo, hi)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (s_all + float(buckets)) / ((s[b] + 1.0) * (t_all + float(buckets))))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(slow_words(text))])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2]))
    for k, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def awkward():
    table = [(i, prose(i, 10 + i)) for i in range(60)] + [(60, prose(7, 90)), (60, prose(7, 90)), (61, None), (62, ""), (63, " ?! "), (None, prose(64, 40)),
                                                          (65, prose(65, 20_000)), (66, "x" * 5000 + " " + prose(66, 30))]
    return table, [prose(5, 60), None, "", prose(65, 100)]


@pytest.mark.parametrize("options", [{}, {"percent": 50, "lo": 1, "hi": 2, "buckets": 100}, {"percent": 0}, {"percent": 100, "min_words": 0}])
def test_resample_equals_a_plain_version(spark, options):
    table, target = awkward()
    df = docs(spark, [(i, t, "en", "s") for i, t in table])
    goal = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, weight int")
    plain = {"least" if k == "min_words" else k: v for k, v in options.items()}
    out = resample.resample(df, goal, **options)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(out, *out.columns) == slow_resample(table, target, **plain)


def test_ranges_number_rows_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 7)
    table, target = awkward()
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(docs(spark, [(i, t, "en", "s") for i, t in table]), goal, percent=100)
    assert rows(out, *out.columns) == slow_resample(table, target, percent=100)


def test_resample_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    df = docs(spark, [(1, prose(1, 30), "en", "s"), (2, "few words", "en", "s")])
    assert resample.resample(df.where("doc_id < 0"), none).count() == 0
    assert rows(resample.resample(df, none, percent=100), "doc_id", "rank") == [(1, 1), (2, None)]
