"""b-bit MinHash near-duplicates against brute force and the stated cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from marketspark.llm import minhash
from tests.llm.helpers import docs, prose, rows


def slow_set(text, shingle=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < shingle:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + shingle]) for i in range(len(words) - shingle + 1))


def slow_classes(table, shingle=2, percent=80):
    """(doc_id, n_shingles, component_id, kept) by all comparisons."""
    sets = [slow_set(t, shingle) for _, t in table]
    kinds = list({s for s in sets if s})
    group = list(range(len(kinds)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    holders, common = defaultdict(list), Counter()
    for k, s in enumerate(kinds):
        for g in s:
            holders[g].append(k)
    for same in holders.values():
        common.update((a, b) for i, a in enumerate(same) for b in same[i + 1:])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(kinds[a]) + len(kinds[b]) - c):
            group[top(a)] = top(b)
    place, low = {s: k for k, s in enumerate(kinds)}, {}
    for (i, _), s in zip(table, sets):
        if s and i is not None:
            low[top(place[s])] = min(low.get(top(place[s]), i), i)
    out = []
    for (i, _), s in zip(table, sets):
        c = low.get(top(place[s])) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def awkward():
    base = prose(1, 300).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in (5, 90, 200)]
    far = " ".join(base[:150] + prose(2, 150).split())
    return [(5, " ".join(base)), (3, near[0]), (9, near[1]), (4, near[2].upper()), (6, far), (7, None), (8, ""), (10, " \n\t"), (11, "one"), (12, "ONE"),
            (13, "two words"), (14, "two  words"), (None, near[0] + " x"), (None, None), (15, "one"), (15, "one"), (16, "a " * 5000),
            (17, "a a"), (18, prose(4, 20000)), (19, "É é"), (20, "é é")]


def test_classes_equal_brute_force(spark):
    table = awkward()
    df = docs(spark, [(i, t, "en", "s") for i, t in table])
    out = minhash.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows(out, *out.columns) == slow_classes(table)
    assert minhash.near_duplicates(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("shingle,percent", [(1, 70), (5, 80)])
def test_other_parameters(spark, shingle, percent):
    table = awkward()
    got = rows(minhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in table]), shingle, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == slow_classes(table, shingle, percent)


def test_family_around_the_threshold(spark, monkeypatch):
    """Copies that are linked to some of their family only: classes hold together over several bands and chunks."""
    monkeypatch.setattr(minhash, "CHUNK", 16)
    r, base = random.Random(3), prose(9, 200).split()
    table = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for k in r.sample(range(200), r.choice([4, 8, 12, 16, 20])):
            words[k] = f"w{i}x{k}"
        table.append((i, " ".join(words)))
    got = rows(minhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in table])), "doc_id", "n_shingles", "component_id", "kept")
    assert got == slow_classes(table)
    assert 3 < sum(x[3] for x in got) < 140


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(5)
    pool = r.integers(1 << 63, size=40_000, dtype=np.uint64)
    estimates = []
    for k in range(40):
        both, own = pool[k * 900: k * 900 + 600], pool[k * 900 + 600: k * 900 + 900]
        a, b = np.sort(np.concatenate([both, own[:150]])), np.sort(np.concatenate([both, own[150:]]))
        low = minhash.packed(minhash.minima(np.concatenate([a, b]), np.array([0, 750, 1500])))
        d = low[0] ^ low[1]
        same = minhash.LANES - int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(minhash._one_per_lane())).sum())
        estimates.append(minhash.estimate(same))
    assert abs(np.mean(estimates) - 600 / 900) < 0.03
    assert minhash.estimate(minhash.LANES) == 1.0 and 70 < minhash.least_lanes(80) < 100


def test_parity_sketch_never_hides_a_link():
    """Differing parities count at most the shingles that one set holds alone, also when sketches are folded."""
    r = np.random.default_rng(2)
    for n, m in ((50, 55), (300, 260), (4000, 5000), (64, 65)):
        pool = r.integers(1 << 63, size=n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[: n - n // 6], pool[n: n + m - n + n // 6]])
        x, y = (np.frombuffer(minhash.parity_sketch(s), np.uint64)[None, :] for s in (a, b))
        while x.shape[1] > y.shape[1]:
            x = minhash._folded(x)
        while y.shape[1] > x.shape[1]:
            y = minhash._folded(y)
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert 0.7 * apart <= np.bitwise_count(x ^ y).sum() <= apart


def test_best_candidate_of_two_classes():
    sets = [np.sort(np.random.default_rng(7).integers(1 << 63, size=100, dtype=np.uint64))]
    sets += [np.sort(np.concatenate([sets[0][k:], np.arange(k, dtype=np.uint64)])) for k in (2, 5, 60)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = minhash.packed(minhash.minima(np.concatenate(sets), bounds)).view(np.int64)
    group = pd.DataFrame({"v": [7] * 4, "chunk": [-1] * 4, "sid": [1, 2, 3, 4], "root": [1, 2, 2, 4], "n": [100] * 4, "sig": list(sig), "odd": [minhash.parity_sketch(s) for s in sets]})
    best = minhash.compare(group, 80, True)
    assert best[["src", "dst"]].to_numpy().tolist() == [[2, 1]]
    assert sorted(map(tuple, minhash.compare(group, 80, False)[["src", "dst"]].to_numpy().tolist())) == [(2, 1), (3, 1)]
    group["v"] = [7, 9, 7, 9]                       # other bands do not meet, nor do rows of one chunk
    assert minhash.compare(group, 80, False)[["src", "dst"]].to_numpy().tolist() == [[3, 1]]
    assert not len(minhash.compare(group.assign(chunk=[0, 0, 0, 1]), 80, False))


def test_pairs_of_a_band_come_in_steps(monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_AT_ONCE", 5)
    v = np.sort(np.random.default_rng(3).integers(0, 6, 40))
    got = [(i, k) for x, y in minhash._in_band(v, np.full(40, -1)) for i, k in zip(x.tolist(), y.tolist())]
    assert sorted(got) == [(i, k) for i in range(40) for k in range(i + 1, 40) if v[i] == v[k]]
    assert not list(minhash._in_band(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_shingle_sets_of_a_batch():
    texts = ["a b c a b", None, "x", "", "A  B"]
    h, bounds = minhash.shingle_sets(pa.array([None if t is None else t.encode() for t in texts]), 2)
    assert np.diff(bounds).tolist() == [len(slow_set(t)) for t in texts]
    first, last = set(h[bounds[0]:bounds[1]].tolist()), set(h[bounds[4]:bounds[5]].tolist())
    assert last < first
