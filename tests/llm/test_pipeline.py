"""Every pipeline stage against a plain version of it, and the registration of all queries."""

import hashlib
import math

import public_tokenizers as public
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from marketspark.llm import bpe, toxicity
from marketspark.llm.common import read, staged
from marketspark.llm.queries import TOXIC_FROM
from tests.llm.helpers import docs
from tests.llm.test_dedup import slow_components, slow_fingerprint, slow_line_dedup
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]


def test_a_query_per_operator_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14)) and "pipeline" in NAMES
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    n, problems = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems, problems
    assert n > 0


def texts(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()), key=repr)


def slow_mix(table):
    """Weights in code-point order, shares filled up to the limits, copies by the seeded digest."""
    sizes = {}
    for _, t, s in table:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().replace(b"\x1c", b"x").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        unit = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in order if s not in full and weight[s] * unit > 2 * sizes[s]}
        if not more:
            break
        full |= more
    out = []
    for i, t, s in table:
        rate = min(2.0, (2 * sizes[s] if s in full else weight[s] * unit) / sizes[s]) if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix-1 {i}".encode()).hexdigest()[:13], 16) / 16**13
        out += [(i, t, s)] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return sorted(out, key=repr)


def test_stages(spark):
    given = read(spark, SF, "documents")
    table = given.collect()
    stage = dict(corpus_pipeline.STAGES)

    model = toxicity.learn(given, read(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    clean = staged(stage["toxicity"](spark, given, SF), "t")
    assert clean.columns == given.columns
    assert texts(clean) == sorted(((r["doc_id"], r["text"], r["source"]) for r in table
                                   if scorer.score(*scorer.segments(r["text"])) < TOXIC_FROM), key=repr)

    lined = staged(stage["line dedup"](spark, clean, SF), "t")
    assert lined.columns == given.columns
    before = [(i, t, None, s) for i, t, s in texts(clean)]
    kept = slow_line_dedup(before, 50)
    assert texts(lined) == sorted(((i, kept[i, t], s) for i, t, _, s in before), key=repr)

    single = staged(stage["simhash near-dedup"](spark, lined, SF), "t")
    assert single.columns == given.columns
    rows = texts(lined)
    lows = slow_components([(i, slow_fingerprint(t)) for i, t, _ in rows])
    assert texts(single) == sorted((r for r, low in zip(rows, lows) if r[0] == low), key=repr)

    mixed = staged(stage["source mixing"](spark, single, SF), "t")
    assert mixed.columns == given.columns
    assert texts(mixed) == slow_mix(texts(single))

    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken")))
    want = sorted((i, tuple(encoding.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in texts(mixed))
    got = sorted((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in stage["byte-level BPE"](spark, mixed, SF).collect())
    assert got == want


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    odd = [(1, None, None, None), (2, "", "en", "a"), (None, "x y z", None, "a"), (2, "", "en", "a"), (4, "words " * 9000, "de", "b"), (5, "tie", None, "b"), (5, "tie", None, "b")]
    for k, rows in enumerate([odd, []]):
        folder = str(tmp_path / f"t{k}")
        docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() <= 2 * len(rows)
