"""SimHash near-duplicates and line dedup against brute force and the stated cases."""

import random

import numpy as np
import pytest
import xxhash

from marketspark.llm import linededup, simhash
from tests.llm.helpers import docs, prose, rows


def slow_fingerprint(text, shingle=4):
    """The contract, bit by bit."""
    words = bytes(text or "", "utf-8").lower().split()
    grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) * 2 > len(grams):
            out |= 1 << bit
    return out


def slow_components(pairs, distance=4):
    """(id, fingerprint) -> smallest reachable id, by all comparisons."""
    group = list(range(len(pairs)))
    for _ in pairs:
        changed = False
        for i in range(len(pairs)):
            for j in range(len(pairs)):
                if group[i] != group[j] and bin(pairs[i][1] ^ pairs[j][1]).count("1") <= distance:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
        if not changed:
            break
    lows = {}
    for g, (i, _) in zip(group, pairs):
        if i is not None:
            lows[g] = min(lows.get(g, i), i)
    return [lows.get(g) for g in group]


@pytest.mark.parametrize("text", ["", "  \t\n", "one", "One two THREE", "É é Ÿ ÿ a\x0bb\x1cc d e f", prose(1, 70), "a b " * 90])
def test_fingerprint_is_the_contract(text):
    assert simhash.shingle_fingerprint(text.encode()) == slow_fingerprint(text)


def test_index_finds_every_link():
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(60)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(12)} | {0, 2**64 - 1}
    fps = np.array(sorted(fps), np.uint64)
    index = simhash.GrayIndex(fps)
    found = {(q, p) for qs, a, z in index.links(index.fps, 4) for q, f, l in zip(qs.tolist(), a.tolist(), z.tolist()) for p in range(f, l + 1)}
    wanted = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bin(int(index.fps[i]) ^ int(index.fps[j])).count("1") <= 4}
    assert found == wanted


def test_dense_class_is_cut_into_groups_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 32)
    base = 0x5555AAAA0F0F3333
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)] + [base ^ (0xFFFF << 40), 1, 2]
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    marked = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.link_components(marked).collect()}
    assert [got[f] for f in signed] == slow_components(list(enumerate(fps)))


def awkward():
    near = prose(5, 400).split()
    copy = " ".join(near[:-1] + ["changed"])
    return [(5, prose(2, 80), "en", "a"), (3, prose(2, 80), "en", "b"), (9, " ".join(near), None, None), (7, copy, "en", "a"),
            (11, None, "en", "a"), (12, "", "en", "a"), (2, " \n ", "en", "a"), (None, prose(2, 80), "en", "a"), (None, prose(8, 30), None, "a"),
            (None, prose(8, 30), None, "b"), (20, "one", "en", "a"), (20, "one", "en", "a"), (21, prose(9, 9000), "en", "a"),
            (22, "two words", "en", "a"), (22, prose(10, 60), "en", "a")]


def test_simhash_rows(spark):
    table = awkward()
    got = rows(simhash.near_duplicates(docs(spark, table)), "doc_id", "fingerprint", "component_id")
    pairs = [(i, slow_fingerprint(t)) for i, t, _, _ in table]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(pairs, slow_components(pairs))), key=repr)
    assert got == want


def test_keep_one_of_each_class(spark):
    table = awkward()
    df = docs(spark, table)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    pairs = [(i, slow_fingerprint(t)) for i, t, _, _ in table]
    classes = {}
    for (i, f), c, row in zip(pairs, slow_components(pairs), table):
        classes.setdefault((c, None if c is not None and c != 22 else f), set()).add(i)
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=repr) == sorted((c[0] for c in classes), key=repr)
    assert simhash.keep_one(df.where("doc_id < 0")).count() == 0


def test_keep_one_drops_a_near_copy_whose_id_is_kept_elsewhere(spark):
    near = prose(70, 60)
    df = docs(spark, [(3, near, "en", "a"), (5, prose(71, 60), "en", "a"), (5, near, "en", "a"), (9, prose(72, 60), "en", "a")])
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(df).select("doc_id", "text").collect())
    assert kept == sorted([(3, near), (5, prose(71, 60)), (9, prose(72, 60))])


# --- line dedup ------------------------------------------------------------------------------

def slow_line_dedup(table, min_words):
    """The stated definition by plain loops: {(doc_id, text): kept text}."""
    order = sorted({(i, t) for i, t, _, _ in table if t is not None},
                   key=lambda d: (d[0] is None, d[0] or 0))
    split = {}
    for d in order:
        lines, last = [], -1                      # (line, words, blank lines before it, position)
        for p, x in enumerate(d[1].split("\n")):
            if x.split():
                lines.append((x.strip(" \t\r\f\x0b"), len(x.split()), p - last - 1, p))
                last = p
        split[d] = lines
    first, gone = {}, {d: set() for d in order}
    for d in order:
        lines = split[d]
        for i in range(len(lines)):
            total, j = 0, i
            while j < len(lines) and total < min_words:
                total += lines[j][1]
                j += 1
            if total < min_words:
                continue
            key = ((lines[i][0], 0), *[(x, g) for x, _, g, _ in lines[i + 1:j]])
            if key not in first:
                first[key] = (d, i)
                continue
            e, k = first[key]
            while j < len(lines) and k + j - i < len(split[e]) and (lines[j][0], lines[j][2]) == (split[e][k + j - i][0], split[e][k + j - i][2]):
                # follow as far as the next line's own reach goes
                if sum(w for _, w, _, _ in lines[i + 1:j]) >= min_words:
                    break
                j += 1
            gone[d].update(range(lines[i][3], lines[j - 1][3] + 1))
    out = {}
    for d in order:
        left = [x for p, x in enumerate(d[1].split("\n")) if p not in gone[d]]
        out[d] = "" if gone[d] and not "".join(left).split() else "\n".join(left)
    return out


def line_table():
    long_, short = prose(30, 60), [prose(40 + k, 20) for k in range(6)]
    return [(1, long_ + "\nalone\n" + "\n".join(short), None, "s"), (2, "intro\n" + long_ + "\ntail", None, "s"),
            (3, "\n".join(["before"] + short[1:5] + ["after"]), None, "s"), (4, "\n".join(short[:2]), None, "s"),
            (5, "  " + long_ + " \r\nown words", None, "s"), (6, None, None, None), (7, "", None, "s"), (8, "\n\n", None, "s"),
            (9, long_, None, "s"), (9, long_, None, "s"), (None, "x\n" + long_, None, "s"), (10, (prose(77, 55) + "\n") * 3, None, "s"),
            (11, "\n".join(["w"] * 300), None, "s"), (12, "\n".join([short[1], "", short[2], "", short[3]]), None, "s"),
            (13, "\n".join(["z", short[1], "", short[2], "", short[3]]), None, "s"), (14, prose(50, 3000), None, "s")]


def test_line_dedup_equals_the_definition(spark):
    table = line_table()
    df = docs(spark, table)
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "_ld_lines", "_ld_deleted"]
    want = slow_line_dedup(table, 50)
    assert rows(out, "doc_id", "text") == sorted(((i, None if t is None else want[i, t]) for i, t, _, _ in table), key=repr)
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[2]["text"] == "intro\ntail" and by[2]["_ld_deleted"] == 1 and by[9]["text"] == ""
    assert by[3]["text"] == "before\nafter" and by[4]["_ld_deleted"] == 0 and by[6]["_ld_lines"] == 0


def test_line_dedup_random_texts(spark):
    r = random.Random(9)
    pool = [prose(100 + k, r.choice([1, 2, 5, 9])) for k in range(7)] + [""]
    table = [(i, "\n".join(r.choices(pool, k=r.randint(0, 25))), None, "s") for i in range(120)]
    out = linededup.dedup_lines(docs(spark, table), min_words=8)
    want = slow_line_dedup(table, 8)
    assert rows(out, "doc_id", "text") == sorted(((i, want[i, t]) for i, t, _, _ in table), key=repr)


def test_line_dedup_of_very_many_blank_lines(spark):
    """200,000 line feeds in a text cost nothing; blank runs inside a repeat must agree and go with it."""
    import time
    blank, run = "\n" * 200_000, [prose(200 + k, 30) for k in range(3)]
    table = [(1, blank + "word", None, "s"), (2, "word" + blank, None, "s"), (3, (blank + "\n").join(run), None, "s"),
             (4, "x\n" + (blank + "\n").join(run) + "\ny", None, "s"), (5, (blank + "\n\n").join(run), None, "s"), (6, blank, None, "s")]
    start = time.time()
    got = dict(rows(linededup.dedup_lines(docs(spark, table)), "doc_id", "text"))
    assert time.time() - start < 60
    assert got[4] == "x\ny" and all(got[i] == t for i, t, _, _ in table if i != 4)
    want = slow_line_dedup(table, 50)
    assert all(got[i] == want[i, t] for i, t, _, _ in table)


def test_line_dedup_of_a_common_passage(spark, monkeypatch):
    """Later windows of a passage that most documents hold are dealt over tasks, with the same result."""
    from marketspark.operators import skew
    monkeypatch.setattr(skew, "KEY_ROWS", 5)
    passage = "\n".join(prose(300 + k, 20) for k in range(4))
    table = [(i, prose(i, 12) + "\n" + passage + "\n" + prose(900 + i, 12), None, "s") for i in range(60)]
    df = docs(spark, table)
    want = slow_line_dedup(table, 50)
    assert rows(linededup.dedup_lines(df), "doc_id", "text") == sorted(((i, want[i, t]) for i, t, _, _ in table), key=repr)


def test_line_dedup_empty_table(spark):
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
