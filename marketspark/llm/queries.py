"""One production query per operator, over its whole table, with oracle SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm import anntree, bpe, langid, linededup, minhash, mixing, phrases, resample, simhash, toxicity, urlfilter, vafile, warc
from marketspark.llm.common import held_out, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return deco


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 4-word shingles, links at 4 bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), distance=4, shingle=4).drop("fp", "root")


OP8_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
lines AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS h,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w FROM raw),
placed AS (
  SELECT doc_id, text, pos, h, w, pos - coalesce(lag(pos) OVER d, -1) - 1 AS gap, sum(w * 1000 + 1) OVER d - (w * 1000 + 1) AS s
  FROM lines WHERE w > 0 WINDOW d AS (PARTITION BY doc_id, text ORDER BY pos)),
reached AS (
  SELECT *, list({'h': h, 'gap': gap}) OVER r AS ls, list(pos) OVER r AS ps, max(s + w * 1000 + 1) OVER r AS fin FROM placed
  WINDOW r AS (PARTITION BY doc_id, text ORDER BY s RANGE BETWEEN 0 PRECEDING AND 49999 FOLLOWING)),
following AS (
  SELECT *, coalesce(lead(ls) OVER o, []) AS nxt, coalesce(lead(ps) OVER o, []) AS nps,
         list_transform(ls, lambda l, i: {'h': l.h, 'gap': CASE WHEN i > 1 THEN l.gap ELSE 0 END}) AS win
  FROM reached WINDOW o AS (PARTITION BY doc_id, text ORDER BY s)),
wins AS (
  SELECT doc_id, text, pos, ps, nxt, nps, row_number() OVER k AS nth, first(nxt) OVER k AS there
  FROM following WHERE fin >= s + 50000
  WINDOW k AS (PARTITION BY win ORDER BY doc_id NULLS LAST, text, pos)),
runs AS (
  SELECT doc_id, text, pos AS first, greatest(ps[len(ps)], coalesce(nps[coalesce(list_position(list_transform(range(1, len(nxt) + 1),
         lambda i: nxt[i] IS NOT DISTINCT FROM there[i]), false) - 1, len(nxt))], 0)) AS last
  FROM wins WHERE nth > 1),
gone AS (SELECT DISTINCT l.doc_id, l.text, l.pos FROM raw l JOIN runs r
         ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.text = r.text AND l.pos BETWEEN r.first AND r.last),
done AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_deleted, count(*) FILTER (WHERE g.pos IS NULL AND l.w > 0) AS worded,
         coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.pos = g.pos
  GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines,
       CASE WHEN x.n_deleted > 0 AND x.worded = 0 THEN x.n_lines ELSE coalesce(x.n_deleted, 0) END AS n_deleted,
       CASE WHEN x.n_deleted > 0 AND x.worded = 0 THEN '' ELSE x.kept END AS text
FROM documents d LEFT JOIN done x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text
"""


@query(OP8_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all documents without the later of repeated runs of 50 words or more."""
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_deleted").alias("n_deleted"), "text")


def codec(spark: SparkSession) -> bpe.Codec:
    """The production vocabulary: a public byte-level BPE for many languages."""
    import public_tokenizers as public
    return bpe.Codec(spark, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and what they decode to, as digests."""
    return bpe.digests(read(spark, sf_dir, "documents"), codec(spark))


TOXIC_FROM = 0.3


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows outside fold 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


@query()
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from labelled rows outside fold 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix-1 ' || coalesce(doc_id::VARCHAR, 'text ' || coalesce(md5(text), ''))), 1, 13))::BIGINT::DOUBLE / pow(16, 13) AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS step, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM sources)::DOUBLE AS unit
  UNION ALL
  SELECT step + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (WHERE weight * unit > 2.0::DOUBLE * source_size), 0))
                           / (sum(weight) FILTER (WHERE weight * unit <= 2.0::DOUBLE * source_size)) FROM sources)::DOUBLE
  FROM fill WHERE step < 40),
goal AS (
  SELECT source, source_size, least(weight * unit, 2.0::DOUBLE * source_size) AS target FROM sources, (SELECT max(unit) AS unit FROM fill)),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM goal)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
       (d.size * (floor(r.rate) + CASE WHEN d.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""


@query(OP10_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weights 3, 1, 2 of 150% of all words takes of every document."""
    out = mixing.plan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
             max(page_id) OVER (PARTITION BY sha1(body), strlen(body)) AS top FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]),
                      'string_agg', '') AS payload_digest,
       CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM b
"""


@query(OP4_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    table = warc.archives(read(spark, sf_dir, "pages"), min_bytes=0)
    return warc.records(table, payloads=False).drop("url")


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _alike_sql(node: str) -> str:
    """Window expressions: a head's sub-templates and block rate against its node's pool."""
    return f"""sum(n) OVER (PARTITION BY {node}, head) AS nb, sum(allow) OVER (PARTITION BY {node}, head) AS ab,
      sum(block) OVER (PARTITION BY {node}, head) AS kb, sum(n) OVER (PARTITION BY {node}) AS nh, sum(allow) OVER (PARTITION BY {node}) AS ah,
      sum(block) OVER (PARTITION BY {node}) AS kh, count(DISTINCT tail) OVER (PARTITION BY {node}) AS kinds,
      n * (sum(n) OVER (PARTITION BY {node}, head, tail))::DOUBLE / sum(n) OVER (PARTITION BY {node}, tail) AS part"""


_RATE = """(ab + kb = 0 OR kh = 0 OR ah = 0 OR pow(kb - (ab + kb) * (kh / (ah + kh)::DOUBLE), 2)
         <= 9.0::DOUBLE * (ab + kb) * (kh / (ah + kh)::DOUBLE) * (1 - kh / (ah + kh)::DOUBLE))"""
_ALIKE = f"(q * nh / nb - nb <= kinds - 1 + 3.0::DOUBLE * sqrt(2.0::DOUBLE * (kinds - 1)) + 1e-9 AND {_RATE})"
_SHARED = """coalesce(list_position(list_transform(range(1, greatest(len(lo), len(hi)) + 1), lambda i: lo[i] IS NOT DISTINCT FROM hi[i]), false) - 1, len(lo))"""

#: The whole rule, level by level to any depth, as two recursions over the urls' remaining segments.
OP2_SQL = rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN ['example.org/en/1', 'block']
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN ['example.org/es/', 'block']
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN ['com/de/', 'block']
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN ['com/fr/', 'allow']
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN ['org/', 'allow'] END AS r,
    regexp_replace(path, '[0-9]+', '#', 'g') AS masked FROM parsed),
urls AS (
  SELECT host, masked, count(*)::BIGINT AS n, count(DISTINCT path)::BIGINT AS urls, count(*) FILTER (WHERE r[2] = 'allow')::BIGINT AS allow,
         count(*) FILTER (WHERE r[2] = 'block')::BIGINT AS block FROM ruled GROUP BY host, masked),
gen AS (
  SELECT *, '' AS t, []::BOOLEAN[] AS own, list_transform(string_split(masked, '/')[2:], lambda x: '/' || x) AS rest, false AS done FROM urls
  UNION ALL
  SELECT host, masked, n, urls, allow, block,
         CASE WHEN few THEN t || array_to_string(rest, '') ELSE t || array_to_string(rest[:c], '') || CASE WHEN literal OR seg = '' THEN seg ELSE '/*' END END,
         CASE WHEN few THEN own || list_transform(rest, lambda x: false)
              ELSE own || list_transform(rest[:c], lambda x: false) || [literal AND NOT kept] END,
         CASE WHEN few THEN [] ELSE rest[c + 2:] END, few OR seg = ''
  FROM (
    SELECT *, kept OR u >= 30 OR (ab + kb >= 8 AND NOT {_RATE}) AS literal FROM (
      SELECT *, kinds < 8 OR k >= 0.05::DOUBLE * total AS kept FROM (
        SELECT *, sum(n) OVER (PARTITION BY host, t, seg) AS k, sum(urls) OVER (PARTITION BY host, t, seg) AS u,
               sum(allow) OVER (PARTITION BY host, t, seg) AS ab, sum(block) OVER (PARTITION BY host, t, seg) AS kb,
               sum(n) OVER (PARTITION BY host, t) AS total, sum(allow) OVER (PARTITION BY host, t) AS ah, sum(block) OVER (PARTITION BY host, t) AS kh,
               count(DISTINCT seg) OVER (PARTITION BY host, t) AS kinds FROM (
          SELECT *, coalesce(rest[c + 1], '') AS seg FROM (
            SELECT *, {_SHARED} AS c FROM (
              SELECT *, min(rest) OVER (PARTITION BY host, t) AS lo, max(rest) OVER (PARTITION BY host, t) AS hi,
                     count(*) OVER (PARTITION BY host, t) < 8 AS few FROM gen WHERE NOT done))))))),
tree AS (SELECT host, masked, n, allow, block, t, own FROM gen WHERE done),
flat AS (
  SELECT *, coalesce(rest[1], '') AS head, array_to_string(rest[2:], '') AS tail FROM (
    SELECT host, t, max(own) AS own, sum(n)::BIGINT AS n, sum(allow)::BIGINT AS allow, sum(block)::BIGINT AS block,
           list_transform(string_split(t, '/')[2:], lambda x: '/' || x) AS rest FROM tree GROUP BY host, t)),
tested AS (SELECT *, sum(part) OVER (PARTITION BY host, head) AS q FROM (SELECT *, {_alike_sql('host')} FROM flat)),
mrg AS (
  SELECT host, t, n, allow, block, CASE WHEN {_ALIKE} THEN '/~' ELSE head END AS template, own[2:] AS own, rest[2:] AS rest, len(rest) AS deep, false AS done FROM tested
  UNION ALL
  SELECT host, t, n, allow, block,
         template || CASE WHEN NOT open THEN '' WHEN {_ALIKE} AND far AND below > 0 THEN '/~' WHEN {_ALIKE} AND mine THEN '/*' ELSE head END,
         CASE WHEN open THEN own[c + 2:] ELSE own END, CASE WHEN open THEN rest ELSE [] END, deep, NOT open
  FROM (
    SELECT *, sum(part) OVER (PARTITION BY host, template, open, head) AS q, max(len(rest)) OVER (PARTITION BY host, template, open, head) AS below FROM (
      SELECT *, {_alike_sql('host, template, open')} FROM (
        SELECT host, t, n, allow, block, own, deep, open, far, c, template || array_to_string(CASE WHEN open THEN rest[:c] ELSE rest END, '') AS template,
               coalesce(rest[c + 1], '') AS head, coalesce(own[c + 1], false) AS mine, rest[c + 2:] AS rest, array_to_string(rest[c + 2:], '') AS tail FROM (
          SELECT *, (far AND down - c > 1) OR (evident AND down > c) AS open FROM (
            SELECT *, {_SHARED} AS c FROM (
              SELECT *, min(rest) OVER w AS lo, max(rest) OVER w AS hi, max(len(rest)) OVER w AS down, max(deep) OVER w > 3 AS far,
                     bool_or(list_contains(own, true)) OVER w AS evident FROM mrg WHERE NOT done WINDOW w AS (PARTITION BY host, template)))))))),
named AS (SELECT host, t, template FROM mrg WHERE done),
placed AS (SELECT host, masked, n, allow, block, template FROM tree JOIN named USING (host, t)),
base AS (SELECT least(0.5::DOUBLE, (coalesce(sum(block), 0) + 1.0::DOUBLE) / (coalesce(sum(allow + block), 0) + 2.0::DOUBLE)) AS b FROM placed),
marks AS (SELECT host, sum(allow)::BIGINT AS ah, sum(block)::BIGINT AS kh FROM placed GROUP BY host),
judged AS (
  SELECT host, template, (sum(block) + 5.0::DOUBLE * ((any_value(kh) + 5.0::DOUBLE * any_value(b)) / (any_value(ah + kh) + 5.0::DOUBLE)))
                         / (sum(allow + block) + 5.0::DOUBLE) AS purity
  FROM placed JOIN marks USING (host), base GROUP BY host, template)
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN purity >= 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 9) AS purity
FROM ruled JOIN placed USING (host, masked) JOIN judged USING (host, template)
"""


@query(OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, else by its path template."""
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query(OP7_SQL)
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector against all."""
    vectors = read(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


@query()
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine of every fiftieth vector against all."""
    vectors = read(spark, sf_dir, "embeddings")
    return anntree.Index(vectors).search(vectors.where("vec_id % 50 = 0"), k=5)


OP11_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, row, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded),
kinds AS (SELECT list_sort(s) AS s, min(row) AS kind, min(doc_id) AS low, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT kind, n, unnest(s) AS item FROM kinds),
both_ AS (SELECT a.kind AS x, b.kind AS y, a.n + b.n AS total, count(*) AS c FROM items a JOIN items b ON a.item = b.item AND a.kind < b.kind
          GROUP BY a.kind, b.kind, a.n, b.n),
links AS (SELECT x, y FROM both_ WHERE c * 100 >= (total - c) * 80 UNION ALL SELECT y, x FROM both_ WHERE c * 100 >= (total - c) * 80),
reach AS (SELECT kind AS x, kind AS y FROM kinds UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT r.x AS kind, min(k.low) AS component_id FROM reach r JOIN kinds k ON r.y = k.kind GROUP BY r.x)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component_id END AS component_id,
       d.doc_id IS NOT DISTINCT FROM (CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component_id END) AS kept
FROM sets d LEFT JOIN kinds k ON len(d.s) > 0 AND list_sort(d.s) = k.s LEFT JOIN classes c USING (kind)
"""


@query(OP11_SQL)
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 2-word shingles, 80% similar sets."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


OP12_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c)) AS t),
worded AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
uses AS (SELECT side, row, unnest(w) AS word FROM worded),
words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM uses),
bucketed AS (
  SELECT word, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT),
         lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM words, crc_table),
counted AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM uses JOIN bucketed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counted),
gains AS (
  SELECT bucket, floor(1000::DOUBLE * ln((t + 1)::DOUBLE * (s_all + 10000::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000::DOUBLE))))::BIGINT AS gain
  FROM counted, totals),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM uses JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)
                                                             / 4294967296::DOUBLE))))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, weight DESC) AS r,
         count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS draw FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= draw THEN r END AS rank FROM placed
"""


@query(OP12_SQL)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's word distribution."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, seed="2024")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: list_slice(w, i, i + size - 1))) AS g
  FROM split, (SELECT unnest([1, 2, 3]) AS size)),
freq AS (SELECT lang, g, len(g) AS size, count(*) AS a FROM grams GROUP BY lang, g),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM freq WHERE size = 1 GROUP BY lang),
cand AS (SELECT * FROM freq WHERE size >= 2 AND a >= 10),
cuts AS (SELECT lang, g, a, k, list_slice(g, 1, k) AS head, list_slice(g, k + 1, size) AS tail FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, h.a AS l, t.a AS r, (1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a) AS score
  FROM cuts c JOIN freq h ON h.lang = c.lang AND h.g = c.head JOIN freq t ON t.lang = c.lang AND t.g = c.tail),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM scored),
around AS (
  SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, unnest([list_slice(g, 1, 2), list_slice(g, 2, 3)]) AS g FROM cand WHERE size = 3) GROUP BY lang, g),
free AS (SELECT x.*, array_to_string(x.g, ' ') AS phrase FROM lowest x LEFT JOIN around y ON x.lang = y.lang AND x.g = y.g
         WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query(OP13_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of 2 and 3 words in every language, 2,000 at most."""
    return phrases.collocations(read(spark, sf_dir, "documents"), lo=2, hi=3, least=10, top=2000, share=50)
