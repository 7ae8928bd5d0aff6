"""The registered queries without SQL, over whole tables, against brute force or held-out labels."""

import hashlib

import numpy as np
import public_tokenizers as public
import tiktoken

from marketspark.llm import bpe
from marketspark.llm.queries import QUERIES
from tests.llm.test_dedup import slow_components, slow_fingerprint
from tests.llm.test_tables import cosine

SMALL, MEDIUM, LARGE = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def test_simhash_query(spark):
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in table(spark, SMALL, "documents")]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(rows, slow_components(rows))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op5_simhash"](spark, SMALL).collect()}
    assert got == want


def test_tokenizer_query(spark):
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken")))
    want = {}
    for r in table(spark, MEDIUM, "documents"):
        ids = encoding.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op6_byte_bpe"](spark, MEDIUM).collect()} == want


def test_language_query(spark):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, MEDIUM, "documents")}
    got = QUERIES["op1_langid"](spark, MEDIUM).collect()
    assert len(got) == len(langs)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(held) > 200 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97


def test_toxicity_query(spark):
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, LARGE, "labels")}
    got = QUERIES["op3_toxicity"](spark, LARGE).collect()
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in got)
    held = [(r["score"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    bad, good = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    # a few rows labelled toxic here hold no word that any other toxic row holds
    assert (bad[:, None] > good[None, :]).mean() > 0.93
    assert (bad >= 0.3).mean() > 0.9 and (good >= 0.3).mean() < 0.03


def test_nearest_neighbour_query(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, MEDIUM, "embeddings")}
    got = {}
    for r in QUERIES["op9_ann"](spark, MEDIUM).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        best = sorted((-cosine(rows[q], v), i) for i, v in rows.items() if i != q)[:5]
        assert all(abs(s - cosine(rows[q], rows[i])) < 1e-12 for _, i, s in found) and len(found) == 5
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 5 * len(got)
