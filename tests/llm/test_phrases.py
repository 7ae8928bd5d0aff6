"""Collocations: the quicksort against counting, results against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketspark.llm import phrases
from tests.llm.helpers import docs, rows


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def slow_collocations(table, lo=2, hi=3, least=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, hi + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) >= lo and a >= least}
    longer = Counter()
    for (lang, p), a in cand.items():
        for m in range(lo, len(p)):
            for s in range(len(p) - m + 1):
                longer[lang, p[s:s + m]] = max(longer[lang, p[s:s + m]], a)
    found = []
    for (lang, p), a in cand.items():
        if (lang, p) in longer and 100 * longer[lang, p] >= share * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def texts(seed=4, many=80):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(14)] + ["Zé", "zé", "\xa0x", "über", "the"]
    table = []
    for i in range(many):
        body = ""
        for _ in range(r.randint(0, 60)):
            body += r.choice(["new york city ", "new york ", "the the ", r.choice(words) + " "]) + r.choice(["", "", "", ", ", ". ", "\n", "\t", "\x0b"])
        table.append((body, r.choice(["en", "en", "en", "fr", None, "und", ""])))
    return table + [(None, "en"), ("", "en"), (" .,;", "fr"), ("new york city " * 30_000, "fr"), (None, None), ("solo", "xx")]


@pytest.mark.parametrize("options", [{}, {"top": 5}, {"hi": 4, "least": 3, "share": 80}, {"lo": 3, "hi": 3}])
def test_collocations_equal_a_plain_version(spark, options):
    table = texts()
    df = docs(spark, [(k, t, lang, "s") for k, (t, lang) in enumerate(table)])
    out = phrases.collocations(df, **options)
    assert out.columns == COLUMNS and [f.dataType.simpleString() for f in out.schema][3:] == ["bigint"] * 5
    assert rows(out, *COLUMNS) == slow_collocations(table, **options)


def test_routes_that_split_prefixes(spark, monkeypatch):
    """Many small routes: leading words, pairs and languages span several, and hot suffixes come from many batches."""
    monkeypatch.setattr(phrases, "ROUTE_BYTES", 4000)
    table = texts(8)
    df = docs(spark, [(k, t, lang, "s") for k, (t, lang) in enumerate(table)]).repartition(6)
    assert rows(phrases.collocations(df), *COLUMNS) == slow_collocations(table)


def test_empty_tables(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, "en", "s"), (2, "few words", "en", "s")])).count() == 0


def test_quicksort_counts_prefixes():
    r = np.random.default_rng(3)
    for least in (1, 4, 9):
        keys = np.zeros((500, 4), np.int64)
        keys[:, 0] = r.integers(1, 3, 500)
        depth = r.integers(0, 4, 500)
        for d in range(3):
            keys[:, d + 1] = np.where(depth > d, r.zipf(1.6, 500) % 9 + 1, 0)
        weight = r.integers(1, 4, 500)
        want = Counter()
        for row, w in zip(keys.tolist(), weight.tolist()):
            for d in range(1, 5):
                if row[d - 1]:
                    want[tuple(row[:d])] += w
        ends = np.array([17, 400])
        got = {tuple(keys[row, :d].tolist()): c for row, d, c in phrases.frequent_prefixes(keys, weight, least, ends)}
        kept = {tuple(keys[e, :d].tolist()) for e in ends for d in range(1, 5) if keys[e, d - 1]}
        assert got == {p: c for p, c in want.items() if c >= least or p in kept}
    assert list(phrases.frequent_prefixes(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), 1, np.zeros(0, np.int64))) == []


def test_exact_arithmetic(spark):
    """Products of counts beyond 64 bits, by the score expression on given counts."""
    a, left, right = 3 * 10 ** 12, 7 * 10 ** 12, 5 * 10 ** 12
    got = spark.sql(f"SELECT (CAST({a} AS {phrases.COUNT}) * CAST({a} AS {phrases.COUNT}) * CAST(1000000 AS decimal(7,0))) "
                    f"div (CAST({left} AS {phrases.COUNT}) * CAST({right} AS {phrases.COUNT})) AS s").first()["s"]
    assert got == 1000000 * a * a // (left * right)


def test_batch_suffixes_pack_or_not():
    from marketspark.llm.tokens import Words
    col = pa.array([b"a b c. a b", b"", None, b"b b b b"])
    words = Words(col, phrases.ENDS, phrases.BREAKS)
    keys = phrases._suffix_keys(words, np.zeros(4, np.int64), 3)
    small = phrases._combined(keys, [1, 10, 10, 10])
    wide = phrases._combined(keys, [1, 1 << 30, 1 << 30, 1 << 30])
    assert sorted(zip(*[k.tolist() for k in small[0]], small[1].tolist())) == sorted(zip(*[k.tolist() for k in wide[0]], wide[1].tolist()))
    assert sum(small[1]) == len(words.ids) == 9


def test_packed_suffixes_come_back():
    lang = pa.array([b"en", b"fr", b"en"], pa.binary())
    batch = phrases.Batch(lang, pa.array([b"b a c. a b", b"x \xc3\xa9 y", b"b a c"]), 3)
    bounds = sorted([(b"en", b"a", b"b", b""), (b"en", b"b", b"", b""), (b"fr", b"", b"", b""), (b"fr", b"x", b"z", b""), (b"zz", b"", b"", b"")])
    back, last = {}, -1
    for route, name, words, blob in batch.packed(bounds):
        known, codes, times = phrases.unpacked(words, blob, 3)
        for row, n in zip(codes.T.tolist(), times.tolist()):
            suffix = (name, *[known[k - 1] if k else b"" for k in row])
            assert (bounds[route - 1] <= suffix if route else True) and (suffix < bounds[route] if route < len(bounds) else True)
            back[suffix] = n
        assert route >= last
        last = route
    assert back == {(b"en", b"b", b"a", b"c"): 2, (b"en", b"a", b"c", b""): 2, (b"en", b"c", b"", b""): 2, (b"en", b"a", b"b", b""): 1,
                    (b"en", b"b", b"", b""): 1, (b"fr", b"x", b"\xc3\xa9", b"y"): 1, (b"fr", b"\xc3\xa9", b"y", b""): 1, (b"fr", b"y", b"", b""): 1}


def test_the_sort_holds_little_beside_its_keys():
    import tracemalloc
    r = np.random.default_rng(1)
    keys = r.integers(1, 400, (200_000, 4)).astype(np.int32)
    weight = np.ones(len(keys), np.int64)
    tracemalloc.start()
    found = sum(1 for _ in phrases.frequent_prefixes(keys, weight, 10, np.array([0, 1])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 50 * len(keys)
