"""Tokenizer, language identification and toxicity."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from marketspark.llm import bpe, langid, toxicity
from tests.llm.helpers import docs, prose, rows

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(bpe.load_ranks(PATH), public.PATTERN)


def texts():
    r = random.Random(3)
    marks = ["a", "b", " ", " ", "\n", "\t", "1", "²", "½", ".", "é", "ß", "\x1c", "\x85", "\xa0", " ", "'s", "'ll", "日", "😀", "_", "²"]
    out = ["", " ", "  ", "\n", "hello world", " lead and trail ", "x" * 3000, "ab" * 2500 + "c", " " * 4000, "=-" * 900, "日本語" * 400,
           "<|endoftext|>", "1234567890" * 200, "".join(r.choices("abcdefghij", k=5000)), "naïve café ÀÉÎ", "don't we'll I'D"]
    return out + ["".join(r.choices(marks, k=r.randint(1, 60))) for _ in range(800)] + [prose(k, 40) for k in range(40)]


def test_encoding_equals_the_library(tokenizer, reference):
    given = texts()
    for text, ids in zip(given, tokenizer.encode_batch(given)):
        assert ids.tolist() == reference.encode_ordinary(text), text[:60]
        assert tokenizer.decode(ids) == text.encode()


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(bpe, "TEXT_AT_ONCE", 300)
    small = bpe.Tokenizer(bpe.load_ranks(PATH), public.PATTERN)
    given = texts()[-60:]
    assert [x.tolist() for x in small.encode_batch(given)] == [reference.encode_ordinary(t) for t in given]


def test_pair_table_holds_every_pair():
    r = np.random.default_rng(1)
    pairs = np.unique(r.integers(0, 3000, (20_000, 2)), axis=0)
    table = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    assert (table.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (table.find(pairs[:, 0] + 3000, pairs[:, 1]) == bpe.NONE).all()


def test_digest_rows(spark, reference):
    table = [(1, "hello world", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (1, "hello world", "en", "a"), (None, prose(1, 5000), None, "b")]
    got = rows(bpe.digests(docs(spark, table), bpe.Codec(spark, PATH, public.PATTERN)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t, _, _ in table:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(docs(spark, []), bpe.Codec(spark, PATH, public.PATTERN)).count() == 0


# --- language --------------------------------------------------------------------------------

LETTERS = {"aa": "abcdeio", "bb": "klmnou", "cc": "rstvwé"}


def languages(n=150):
    r = random.Random(2)
    return [(k, prose(k, 30, LETTERS[lang]), lang, "s") for k in range(n) for lang in [r.choice(list(LETTERS))]]


def test_counts_cover_the_whole_text_in_any_chunks(monkeypatch):
    text = prose(3, 400, "abcé ")
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (langid.ngram_counts(text) == whole).all() and whole.sum() > 3 * len(text) * 0.9
    assert langid.ngram_counts("12 3! \n") is None and langid.ngram_counts("") is None


def test_language_rows(spark):
    table = languages() + [(500, None, "aa", "s"), (501, "", "aa", "s"), (502, "123 456", "bb", "s"), (503, prose(7, 20_000, LETTERS["bb"]), None, "s"),
                           (None, prose(8, 50, LETTERS["cc"]), "cc", "s"), (3, languages()[3][1], languages()[3][2], "s")]
    df = docs(spark, table)
    model = langid.learn(df, per_lang=30, clusters=2)
    assert set(model.langs) == set(LETTERS) and len(model.langs) <= 6
    out = df.select("doc_id", "lang", langid.predict(F.col("text"), model).alias("p")).select("doc_id", "lang", "p.*").collect()
    assert len(out) == len(table)
    for r in out:
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] == (r["lang"] or "bb") and 0 <= r["score"] <= 1
    far = spark.createDataFrame([("zxq zxq qqz",)], "text string").select(langid.predict(F.col("text"), model).alias("p")).first()["p"]
    assert far["rejected"]


def test_language_without_labels(spark):
    for df in (docs(spark, []), docs(spark, [(1, "some words", None, "s")])):
        model = langid.learn(df)
        assert all(r["p"]["lang_pred"] == "und" for r in df.select(langid.predict(F.col("text"), model).alias("p")).collect())


# --- toxicity --------------------------------------------------------------------------------

def slow_segments(scores):
    """All maximal segments by the recursive definition: the best segment (longest start cut off),
    then the same to its left and right."""
    def go(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (i, j, total)
        return [] if best is None else go(lo, best[0]) + [best] + go(best[1] + 1, hi)
    return go(0, len(scores))


def test_linear_scan_finds_the_maximal_segments():
    r = random.Random(5)
    for _ in range(300):
        scores = np.array([r.choice([-0.25, -0.25, -1.03, 0.71, 2.9, 1.37]) + r.random() / 7 for _ in range(r.randint(0, 25))])
        got = [s for _, _, s in toxicity.maximal_segments(scores)]
        want = [s for _, _, s in slow_segments(scores.tolist())]
        assert np.allclose(got, want), scores
    assert toxicity.maximal_segments(np.zeros(0)) == []


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def toxic_rows(n=700):
    r = random.Random(6)
    table, labels = [], []
    for i in range(n):
        words = prose(i, r.randint(20, 90)).split()
        bad = r.random() < 0.2
        if bad:
            for _ in range(r.randint(3, 6)):
                words.insert(r.randrange(len(words)), r.choice(["zounds", "zwork" + r.choice("abcdefgh") * 3, "zlout"]))
        table.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return table, labels


def test_toxicity_held_out(spark):
    table, labels = toxic_rows()
    more = [(2000, None, "en", "s"), (2001, "", "en", "s"), (None, "zounds you zlout zworkaaa", None, None), (5, *table[5][1:]),
            (2002, prose(1, 30_000), "en", "s")]
    odd = [(None, 1, 1), (2000, 0, 1), (2001, None, 0), (7, 1, None), (3, 1, labels[3][2]), (9999, 0, 1)]
    df, marks = docs(spark, table + more), spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, marks)
    assert any(w.startswith("zwork") for w in model.words) and "zounds" in model.words
    out = df.select("doc_id", toxicity.score(F.col("text"), model).alias("p")).collect()
    assert len(out) == len(table) + len(more)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], r["p"])
    held = [(got[i], y) for i, _, y in labels if fold(i) == 2]
    assert np.mean([(p >= 0.3) == y for p, y in held]) > 0.97
    assert got[2000] < 0.3 and got[2001] < 0.3 and got[2002] < 0.3 and got[None] >= 0.3
    text = prose(50, 40) + " Zounds, zlout! zworkccc " + prose(51, 40)
    found = spark.createDataFrame([(text,)], "text string").select(toxicity.passages(F.col("text"), model).alias("x")).first()["x"]
    assert len(found) == 1 and text[found[0]["first"]:found[0]["end"]].startswith("Zounds, zlout! zworkccc")


def test_toxicity_without_labels(spark):
    df = docs(spark, [(1, "words here", "en", "s")])
    for marks in ([], [(1, 1, 0)], [(1, 1, None)]):
        model = toxicity.learn(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
        assert 0 <= df.select(toxicity.score(F.col("text"), model).alias("p")).first()["p"] < 0.3
    assert docs(spark, []).select(toxicity.score(F.col("text"), toxicity.Model()).alias("p")).count() == 0


def test_passages_are_placed_in_the_text_as_written():
    """Lower case may be longer than the text: places are those of the text."""
    model = toxicity.Model({"zounds": 4.0}, frozenset())
    model.lam, model.log_k = 1.0, -2.0
    for lead in ("", "İİİİ fine day ", "fine day ", "İx İ "):
        text = lead + "Zounds zounds" + " mild İ words" * 3
        (a, z, score, _), = toxicity.Scorer(model).passages(text, 1.0)
        assert text[a:z] == "Zounds zounds" and score == 8.0


def test_sample_of_a_hot_language_is_thinned_alike(spark):
    """The ids of least hash, whatever the language's share of the table."""
    table = [(k, f"text {k}", "aa" if k % 10 else f"l{k % 30}", "s") for k in range(3000)]
    got = langid.labelled_sample(docs(spark, table), 20)
    by = {}
    for r in docs(spark, table).where(langid.fold(F.col("doc_id")) != 2).select("text", "lang", F.xxhash64("doc_id").alias("h")).collect():
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    want = sorted((lang, t) for lang, v in by.items() for _, t in sorted(v)[:20])
    assert rows(got, "lang", "text") == want


def test_texts_are_encoded_once(spark):
    """The digests' query calls the encoder once for each row."""
    import marketspark.llm.bpe as module
    from marketspark.llm.queries import codec
    df = docs(spark, [(k, prose(k, 30), "en", "s") for k in range(40)]).repartition(2)
    plan = module.digests(df, codec(spark), keep_ids=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "(ids(" not in plan and plan.split("ArrowEvalPython")[1].split("]")[0].count("both(") == 1
