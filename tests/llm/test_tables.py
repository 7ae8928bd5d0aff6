"""WARC archives, URL filter, mixing, vector search and the pipeline."""

import base64
import hashlib
import math
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marketspark.llm import anntree, mixing, urlfilter, vafile, warc
from marketspark.llm.queries import OP10_SQL, SQL, URL_RULES
from tests.llm.helpers import docs, prose, rows

PAGES = "page_id long, url string, html string, payload string, digest string, top long, host string, n long"


def pages(spark, table):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in table], PAGES)


# --- WARC ------------------------------------------------------------------------------------

def html_rows():
    r = random.Random(1)
    body = [f"<p>{prose(k, 40)}</p>" for k in range(12)] + ["", None, "é日\r\n\r\nWARC/1.1\r\n\r\n", "y" * 300_000]
    table = [(k, f"http://h{k % 3}.org/a b\n{k}?é", r.choice(body)) for k in range(200)]
    return table + [(None, None, body[0]), (None, "u", "only null ids"), (None, "u", "only null ids"), (199, "again", table[199][2]), (300, "", "single")]


def slow_warc(table, min_bytes=0):
    raw = [(p, (h or "").encode()) for p, _, h in table]
    top = {}
    for p, b in raw:
        top[b] = p if top.get(b) is None else top[b] if p is None else max(top[b], p)
    out = []
    for p, b in raw:
        refers = top[b] if len(b) >= min_bytes and top[b] != p else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("min_bytes", [0, 1000])
def test_round_trip(spark, min_bytes, monkeypatch):
    monkeypatch.setattr(warc, "PAYLOAD_AT_ONCE", 20_000)
    table = html_rows()
    back = warc.records(warc.archives(pages(spark, table), min_bytes))
    assert rows(back, *COLUMNS) == slow_warc(table, min_bytes)
    for r in back.where("record_type = 'response'").select("payload", "payload_digest").collect():
        assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["payload_digest"]


def test_files(spark, tmp_path):
    table = html_rows()
    warc.export(warc.archives(pages(spark, table)), str(tmp_path / "w")).count()
    files = spark.read.format("binaryFile").load(str(tmp_path / "w" / "*.warc.zst"))
    assert rows(warc.records(files, payloads=False), *COLUMNS) == slow_warc(table)


def test_no_pages(spark):
    assert warc.records(warc.archives(pages(spark, []))).count() == 0


def one():
    return warc.record(4, "http://a.org/", b"<p>", hashlib.sha1(b"<p>").digest(), None)


def test_compressed_dictionary_is_read():
    raw = zstandard.ZstdCompressionDict(b"WARC/1.1 response http " * 40, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor().compress(raw.as_bytes())
    frame = zstandard.ZstdCompressor(dict_data=raw).compress(one())
    assert list(warc.frames(struct.pack("<II", warc.MAGIC, len(packed)) + packed + frame)) == [one()]


@pytest.mark.parametrize("damage", [
    lambda b: b[:-3], lambda b: b"\0" + b, lambda b: b[:4], lambda b: b[:-40] + b"\xff" * 40,
    lambda b: b + zstandard.ZstdCompressor().compress(one().replace(b"Content-Length: 3\r", b"Content-Length: 9\r")),
    lambda b: b + zstandard.ZstdCompressor().compress(one().replace(b"<p>", b"<q>")),
    lambda b: b + zstandard.ZstdCompressor().compress(one().replace(b"WARC/1.1", b"HTTP/1.1")),
    lambda b: b + zstandard.ZstdCompressor().compress(one().replace(b"WARC-Date", b"X-Date")),
    lambda b: b + zstandard.ZstdCompressor().compress(one()[:-2])])
def test_damage_is_found(damage):
    good = warc.archive([one()] * 3)
    assert [warc.parse(f)["page_id"] for f in warc.frames(good)] == [4, 4, 4]
    with pytest.raises(warc.WarcError):
        [warc.parse(f) for f in warc.frames(damage(good))]


# --- URLs ------------------------------------------------------------------------------------

def url_rows():
    r = random.Random(2)
    hosts = ["A.example.org", "b.example.net", "c.example.com", "d.com", "notorg", "org"]
    table = [(k, f"http://{r.choice(hosts)}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randint(1, 3000)}{r.choice(['', '.html', '/', '?q=/de/', '#x'])}") for k in range(400)]
    table += [(1000 + k, f"https://blog.net/{prose(k, 1)}/post-{k}") for k in range(60)]
    return table + [(2000, None), (2001, ""), (2002, "no scheme/en/1"), (2003, "http://"), (2004, "x://y://org/fr/"), (2005, "HTTP://EXAMPLE.ORG/es/1"),
                    (2006, "http://example.org"), (2007, "http://ÄÖ.org/é/ü"), (None, "http://a.com/de/5"), (3, "http://d.com/fr/7"), (3, "http://d.com/fr/7"),
                    (2008, "http://deep.org/" + "/".join("abcdefgh" * 400)), (2009, "http://q.com?x=/de/"), (2010, "http://example.org:80/en/1")]


def deep_rows(seed):
    """Urls of one to eight segments: hot hosts, variable and fixed segments and labels at every level."""
    r, table = random.Random(seed), []
    few = ["shop", "item", "info", "spam"]
    for k in range(900):
        host = r.choice(["hot.com"] * 5 + ["www.example.org"] * 3 + ["a.com", "free.net", "free.net", "x.org"])
        path = [r.choice(["de", "fr", "es", "en"])] if r.random() < 0.8 else []
        for level in range(r.randint(0, 7)):
            path.append(r.choice([r.choice(few[:1 + level % 4]), r.choice(few), f"{'abcdefgh'[level]}{prose(r.randint(0, 40), 1)}", str(r.randint(1, 30)), few[0]]))
        table.append((k, f"http://{host}/" + "/".join(path) + r.choice(["", "", "/"])))
    return table


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_urls_equal_the_sql(spark, seed):
    import duckdb
    table = url_rows() if seed is None else deep_rows(seed)
    df = pages(spark, [(p, u, None) for p, u in table])
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [list(t) for t in table])
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['op2_url_filter']})").fetchall()
    assert rows(urlfilter.judge(df, URL_RULES), *columns) == sorted(want, key=repr)


def slow_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else (None, None)


def test_rules_by_hand(spark):
    table = url_rows()
    got = urlfilter.judge(pages(spark, [(p, u, None) for p, u in table]), URL_RULES).collect()
    want = {}
    for p, u in table:
        want.setdefault(p, []).append(slow_rule(u))
    assert len(got) == len(table)
    for r in got:
        fit = [(rule, verdict) for host, path, (rule, verdict) in want[r["page_id"]] if (host, path) == (r["host"], r["path"])]
        assert fit and fit[0][0] == r["rule"]
        assert r["verdict"] == fit[0][1] if r["rule"] else r["verdict"] in ("allow", "block")


def test_variable_segments_merge_and_pure_templates_are_rejected(spark):
    table = [(k, f"http://shop.net/{prose(k, 1)}{k}/view") for k in range(40)]
    table += [(100 + k, f"http://bad.net/x/{k}") for k in range(40)] + [(200 + k, f"http://bad.net/x/sub/{k}") for k in range(40)]
    rules = [("block", "bad.net", "/x/1"), ("block", "bad.net", "/x/2"), ("block", "bad.net", "/x/3")]
    got = {r["page_id"]: r for r in urlfilter.judge(pages(spark, [(*t, None) for t in table]), rules).collect()}
    assert {got[k]["template"] for k in range(40)} == {"/~/view"}      # one variable branch, which is all of its host
    assert got[104]["rule"] is None and got[104]["verdict"] == "block"      # its template is labelled bad
    assert got[5]["verdict"] == "allow"
    assert urlfilter.judge(pages(spark, []), URL_RULES).count() == 0
    assert urlfilter.judge(pages(spark, [(1, "http://a.b/c", None)]), []).first()["verdict"] == "allow"


def test_deep_paths_generalise_and_merge_at_every_level(spark):
    word = lambda k, at: prose(1000 * at + k, 1) + "abcdefghij"[k % 10] * at
    table = [(k, f"http://shop.net/shop/item/{word(k, 3)}{k}x/{'spam' if k % 2 else 'info'}") for k in range(80)]
    table += [(200 + k, f"http://five.net/a/b/c/{word(k, 4)}x{k}/{'spam' if k % 2 else 'info'}/end") for k in range(80)]
    table += [(400 + k, f"http://like.net/a/s/{'red' if k % 2 else 'blue'}/{'x' if k % 4 < 2 else 'y'}/end") for k in range(80)]
    table += [(600, "http://like.net/a/s/red"), (601, "http://like.net/a")]
    labelled = [("block", h, urlfilter_path(u)) for h in ("shop.net", "five.net") for _, u in [x for x in table if h in x[1] and "/spam" in x[1]][:20]]
    labelled += [("allow", h, urlfilter_path(u)) for h in ("shop.net", "five.net") for _, u in [x for x in table if h in x[1] and "/info" in x[1]][:20]]
    got = {r["page_id"]: r for r in urlfilter.judge(pages(spark, [(*t, None) for t in table]), labelled).collect()}
    assert {got[k]["template"] for k in range(80)} == {"/~/item/*/spam", "/~/item/*/info"}
    left = [got[k] for k in (*range(80), *range(200, 280)) if got[k]["rule"] is None]
    assert len(left) == 80 and all(r["verdict"] == ("block" if "/spam" in r["path"] else "allow") for r in left)
    assert {got[200 + k]["template"] for k in range(80)} == {"/~/b/c/*/spam/end", "/~/b/c/*/info/end"}
    assert len({got[400 + k]["template"] for k in range(80)}) < 4        # red and blue, or x and y, are one branch
    assert len(got) == len(table)


def test_sections_of_a_large_host_keep_their_labels(spark):
    names = [a + b for a in "abcd" for b in "efghijklmn"]                      # 40 even sections, 2.5% each
    table = [(100 * i + k, f"http://hot.net/{s}/{k + 100}") for i, s in enumerate(names) for k in range(40)]
    table += [(9000 + k, f"http://hot.net/zz/{prose(k, 1)}{'xyz'[k % 3]}/{k + 100}") for k in range(16)]       # small, but all blocked
    table += [(9500 + k, f"http://hot.net/user{prose(k, 1)}{'abcdefghij'[k % 10] * 3}{'uvwxyz'[k % 6]}/9") for k in range(60)]
    rules = [("block", "hot.net", f"/{names[3]}/11"), ("block", "hot.net", f"/{names[3]}/12")]
    rules += [("block", "hot.net", urlfilter_path(u)) for p, u in table if 9000 <= p < 9012] + [("allow", "hot.net", f"/{s}/11") for s in names if s != names[3]]
    got = {r["page_id"]: r for r in urlfilter.judge(pages(spark, [(*t, None) for t in table]), rules).collect()}
    assert got[300]["template"] == f"/{names[3]}/#" and got[300]["verdict"] == "block"
    assert all(r["verdict"] == "allow" for p, r in got.items() if p < 4000 and p // 100 != 3)
    assert got[9012]["template"].startswith("/zz/") and got[9500]["template"] == "/~/#"
    assert len({r["template"] for p, r in got.items() if p < 4000 and p // 100 != 3}) == 1         # alike sections are one branch
    # a level down, names of 40 urls each: those that are alike stay one template, the blocked one has its own
    low = [(p, u.replace("hot.net/", "low.net/in/")) for p, u in table if p < 4000]
    rules = [(v, "low.net", f"/in{p}") for v, _, p in rules if p.count("/") == 2] + [("allow", "low.net", "/out/")]
    got = {r["page_id"]: r for r in urlfilter.judge(pages(spark, [(*t, None) for t in [*low, (8000, "http://low.net/out/a")]]), rules).collect()}
    assert {got[p]["template"] for p in got if p < 4000 and p // 100 != 3} == {"/~/*/#"}
    assert got[300]["template"] == f"/~/{names[3]}/#" and got[300]["verdict"] == "block"


def urlfilter_path(url):
    return "/" + url.split("/", 3)[3]


# --- mixing ----------------------------------------------------------------------------------

def mix_rows():
    r = random.Random(3)
    table = [(k, prose(k, r.randint(0, 40)), "en", r.choice(["a"] * 10 + ["b", "é", "Z", None])) for k in range(900)]
    return table + [(2000, None, None, "empty"), (2001, " \t\n\x0b", None, "empty"), (None, "null id", None, "a"), (None, None, None, None), (7, *table[7][1:]),
                    (2002, prose(1, 20_000), None, "long")]


def test_mixing_equals_the_sql(spark):
    import duckdb
    table = mix_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[i, t, s] for i, t, _, s in table])
    out = mixing.plan(docs(spark, table)).withColumn("target", F.round("target", 6))
    got = rows(out, "doc_id", "size", "source_size", "target", "taken")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP10_SQL})").fetchall()
    for g, w in zip(got, sorted(want, key=repr)):
        assert g[:3] + g[4:] == w[:3] + w[4:] and math.isclose(g[3], w[3], abs_tol=1e-5)
    assert len(got) == len(want) == len(table)


def test_targets_stop_at_the_limit_and_use_the_share(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 5), (None, 300), ("z", 0)]
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    assert math.isclose(sum(r["target"] for r in got.values()), 1.5 * 1315)
    assert got["b"]["target"] == 20 and got["c"]["target"] == 10 and got["z"]["target"] == 0 and got["z"]["rate"] == 0
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in got.values())


def test_mixed_rows(spark):
    table = mix_rows()
    df = docs(spark, table)
    plan = {}
    for r in mixing.plan(df).select("doc_id", "size", "source", "copies", "target", "taken").collect():
        plan.setdefault((r["doc_id"], r["source"], r["size"]), []).append(r)
    out = mixing.mix(df)
    assert out.columns == df.columns
    times = {}
    for r in out.select("doc_id", "source", mixing.words(F.col("text")).alias("size")).collect():
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert times == {k: n for k, v in plan.items() if (n := sum(r["copies"] for r in v))}
    taken = {}
    for v in plan.values():
        for r in v:
            assert r["taken"] <= 2 * r["size"]
            taken.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert abs(taken["a"][0] - taken["a"][1]) < 0.1 * taken["a"][1]
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, out.collect()))
    assert mixing.mix(docs(spark, [])).count() == 0


# --- vector search ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, key long, block long, score double"


def vectors(spark, table):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 0.5) for i, v in table], VECTORS)


def vector_rows(n=260, dim=6):
    r = np.random.default_rng(4)
    table = [(int(k), [float(x) for x in np.float32(r.normal(0, 0.4, dim))]) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    same = table[3][1]
    return table + [(1000 + k, same) for k in range(30)] + [(5000, None), (5001, [None] * dim), (5020, [nan] * dim), (5040, [inf] + same[1:]),
                                                           (None, same), (20, table[20][1]), (40, table[41][1]), (5060, [0.0] * dim), (5080, [1.0, 2.0])]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 64)
    monkeypatch.setattr(vafile, "QUERIES_AT_ONCE", 7)
    table = vector_rows()
    got = rows(vafile.top_k(vectors(spark, table), vectors(spark, table).where("vec_id % 20 = 0"), k=7), "query_id", "rank", "vec_id", "score")
    clean = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in table if i is not None and usable(v)]
    want = []
    for q, v in {c for c in clean if c[0] % 20 == 0}:
        all_ = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(all_[:7])]
    assert got == sorted(want, key=repr)


def test_top_k_of_large_numbers_and_few_rows(spark):
    table = [(0, [1e30, 1.0]), (20, [2e9, -2e9]), (21, [2e9, 2e9]), (22, [1.0, 0.0])]
    got = rows(vafile.top_k(vectors(spark, table), vectors(spark, table[1:2]), k=20), "query_id", "rank", "vec_id", "score")
    f = [[math.floor(64 * float(np.float32(x))) for x in v] for _, v in table]
    exact = lambda a, b: min(2**63 - 1, sum(x * y for x, y in zip(a, b)))
    want = sorted(((-exact(f[1], f[k]), table[k][0]) for k in (0, 2, 3)))
    assert got == [(20, n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert vafile.top_k(vectors(spark, []), vectors(spark, []), k=3).count() == 0


def test_va_bounds_hold():
    r = np.random.default_rng(5)
    x, q = r.integers(-90, 90, (300, 8)), r.integers(-90, 90, (40, 8))
    upper, lower = vafile.VAFile(x).bounds(q)
    exact = q @ x.T
    assert (upper >= exact).all() and (lower <= exact).all() and (upper - lower).max() > 0


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())))


def test_tree_search(spark, monkeypatch):
    monkeypatch.setattr(anntree, "BIN", 50)
    monkeypatch.setattr(anntree, "LEAF", 12)
    table = vector_rows(900)
    df = vectors(spark, table)
    index = anntree.Index(df)
    out = index.search(df.where("vec_id % 20 = 0"), k=5).collect()
    clean = [(i, v) for i, v in table if i is not None and usable(v) and len(v) == 6 and any(v)]
    by = dict(reversed(clean))
    hit = total = 0
    for q in {i for i, _ in clean if i % 20 == 0}:
        if q in (20, 40):               # ids of several rows
            continue
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 6))
        assert all(math.isclose(s, cosine(v, by[q]), rel_tol=1e-12) for _, i, s in mine for j, v in clean if i == j and i not in (20, 40))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        best = sorted((-cosine(v, by[q]), i) for i, v in clean if i != q)[:5]
        total += 5
        hit += sum(s >= -best[-1][0] - 1e-12 for _, _, s in mine)
    assert hit >= 0.9 * total
    assert index.tree.leaves > 20 and index.rows.count() == len(clean)


def test_groups_of_the_tree_search_are_bounded_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = [(k, [float(x) for x in rng.normal(0, 1, 4)]) for k in range(300)] + [(400, [1.0, 2.0, 3.0, 4.0])] * 90
    df = vectors(spark, table)
    asked = df.where("vec_id < 150")
    want = rows(anntree.Index(df).search(asked, k=4, leaves=3), "query_id", "rank", "vec_id")
    monkeypatch.setattr(anntree, "BIN", 40)
    monkeypatch.setattr(anntree, "AT_ONCE", 20)
    index = anntree.Index(df)
    assert rows(index.search(asked, k=4, leaves=3), "query_id", "rank", "vec_id") == want
    data, routed = index._dealt(asked, 4, index.tree.leaves)           # every query visits every bin
    assert max(r["count"] for r in data.groupBy("bin", "part").count().collect()) <= 60        # 90 rows of one id and vector, too
    groups = {(r["bin"], r["part"]): r["count"] for r in routed.groupBy("bin", "part").count().collect()}
    assert max(groups.values()) <= 45 and {part for _, part in groups} == set(range(8))        # about AT_ONCE by hash, never all 150
    assert data.select("bin", "part").distinct().count() == len(groups)


def test_tree_of_equal_few_or_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(anntree, "LEAF", 4)
    monkeypatch.setattr(anntree, "BIN", 10)
    same = [(k, [0.5, 0.5]) for k in range(60)]
    df = vectors(spark, same)
    got = rows(anntree.Index(df).search(df.where("vec_id = 50"), k=5), "query_id", "rank", "vec_id")
    assert got == [(50, n + 1, n) for n in range(5)]
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert rows(anntree.Index(few).search(few.where("vec_id = 0"), k=5), "rank", "vec_id") == [(1, 2), (2, 1)]
    none = vectors(spark, [])
    assert anntree.Index(none).search(none, k=5).count() == 0


# --- odd numbers and names -------------------------------------------------------------------

def test_top_k_of_components_beyond_every_integer(spark):
    """Finite components whose scaled value leaves the doubles are still exact integers."""
    from fractions import Fraction
    r = random.Random(6)
    big = [1e307, -1e307, 1.7e308, 3e200, 2.0 ** 600, 0.25, -3.0, 1e18]
    table = [(k, [r.choice(big) for _ in range(3)]) for k in range(30)] + [(30 + k, [float(k), 1.0, -1.0]) for k in range(10)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in table}
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    want = []
    for q in (0, 7, 35):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q))[:4]
        want += [(q, k + 1, i, clip(-s)) for k, (s, i) in enumerate(best)]
    got = rows(vafile.top_k(vectors, vectors.where("vec_id in (0, 7, 35)"), k=4), "query_id", "vec_id", "score")
    assert {(q, i, s) for q, i, s in got} <= {(q, i, clip(sum(a * b for a, b in zip(whole[q], whole[i])))) for q in (0, 7, 35) for i in whole}
    inside = {(q, i) for q, _, i, s in want if abs(s) < 2 ** 63 - 1}
    assert inside <= {(q, i) for q, i, _ in got} and len(got) == 12


@pytest.mark.parametrize("operator", ["mix", "keep_one", "dedup_lines"])
def test_columns_with_the_names_used_inside(spark, operator):
    """Every name that the operators use inside, as a further column: values come through unchanged."""
    from marketspark.llm import linededup, simhash
    inside = ["_copy", "_copies", "_rate", "_source", "_row", "row", "rows", "id", "of", "fp", "root", "doc", "_sh_fp", "_sh_rows", "_sh_of", "_id", "_th",
              "pos", "v", "p", "gap", "s1", "s2", "nxt", "at", "n", "there", "then", "_skew_n", "u", "rate", "target", "place", "weight", "a.b"]
    table = [(k, prose(k, 20), "en", "ab"[k % 2]) for k in range(30)] + [(40, prose(3, 20), "en", "a"), (None, prose(4, 20), None, None)]
    df = docs(spark, table, clash=False)
    for name in inside:
        df = df.withColumn(name, F.concat(F.lit(name + " "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = {"mix": mixing.mix, "keep_one": simhash.keep_one, "dedup_lines": linededup.dedup_lines}[operator](df)
    assert out.columns[:len(df.columns)] == df.columns
    got = out.select([F.col(f"`{c}`") for c in ["doc_id", *inside]]).collect()
    assert len(got) > 20
    for r in got:
        assert list(r[1:]) == [f"{name} {'none' if r[0] is None else r[0]}" for name in inside]
