"""URL filter: host rules first, then a tree of path templates judged by labelled purity.

Rules label the urls they fit.  All urls, labelled or not, build a tree per host:

1. Generalise.  Runs of digits become ``#``.  Level by level, down to the deepest path, a node with
   ``FEW`` children or more keeps those that hold ``LITERAL`` of its urls or ``MANY`` distinct urls,
   and those with ``FEW`` labelled urls or more whose block rate differs from the node's; the
   others, variable segments, become ``*``.
2. Merge.  A host's branches (first segments) are compared with the host's pooled distribution over
   sub-templates by a chi-square statistic, and by the block rate of their labelled urls.
   Branches that do not differ significantly form one merged branch ``~``; comparing with the pool
   instead of with each other keeps this linear in the number of branches.  The same goes on, level
   by level, in nodes that reach below the third segment, for branches that hold a sub-tree.
3. Reject.  A template's block purity is smoothed towards its host's, and the host's towards the
   corpus's (at most one half).  Urls that no rule fits are blocked if their template's purity is ``REJECT`` or more.

Pages are reduced to counts per (host, masked path) before anything is joined, and partial sums
absorb hot hosts.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import staged

FEW, LITERAL = 8, 0.05
MANY = 30                 # distinct urls that make a child well populated, whatever its share
SMOOTH, REJECT = 5.0, 0.8
SIGMAS = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null.  ``rules``: a short list of
    (verdict, host, path); a rule fits its host and all subdomains if the path starts with its path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for v, h, p in ordered])
    fit = F.filter(known, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    return F.when(F.size(fit) > 0, F.struct(F.concat(fit[0]["h"], fit[0]["p"]).alias("rule"), fit[0]["v"].alias("verdict")))


def _masked(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def _segments(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.concat(F.lit("/"), x))


def _shared(low: Column, high: Column) -> Column:
    """Length of the common prefix of the least and the greatest of some arrays, hence of all of them."""
    differ = F.array_position(F.zip_with(low, high, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(low)).otherwise(differ - 1).cast("int")


def _after(rest: Column, k: Column) -> Column:
    return F.slice(rest, k + 1, F.size(rest))


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _same_rate() -> Column:
    """Whether the block rate of a child's labels (ab, kb) does not differ from its node's (ah, kh)."""
    seen, rate = F.col("ab") + F.col("kb"), F.col("kh") / (F.col("ah") + F.col("kh"))
    gap = F.col("kb") - seen * rate
    return F.when((seen == 0) | (F.col("kh") == 0) | (F.col("ah") == 0), True).otherwise(
        gap * gap <= SIGMAS * SIGMAS * seen * rate * (1 - rate))


def _generalised(urls: DataFrame) -> DataFrame:
    """``urls`` (host, masked, counts) with the template ``t`` and, for each of its segments, whether it is
    literal by evidence alone (``own``), a level of every open node a round.

    Where all urls of a node share further segments these are taken at once, and a node of fewer than ``FEW``
    masked paths is done, as no node below it can have more children."""
    todo = urls.withColumn("t", F.lit("")).withColumn("own", F.array().cast("array<boolean>")).withColumn("rest", _segments(F.col("masked")))
    names, done, level = [*urls.columns, "t", "own"], [], 0
    node = ["host", "t"]
    while level == 0 or not todo.isEmpty():
        level += 1
        spread = todo.groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.count("*").alias("paths"))
        spread = spread.select(*node, _shared(F.col("lo"), F.col("hi")).alias("c"), (F.col("paths") < FEW).alias("few"))
        step = todo.join(spread, node)
        step = step.withColumn("c", F.when(F.col("few"), F.size("rest")).otherwise(F.col("c")))
        step = step.withColumn("t", F.concat("t", F.array_join(F.slice("rest", F.lit(1), F.col("c")), "")))
        step = step.withColumn("own", F.concat("own", F.array_repeat(F.lit(False), F.col("c"))))
        step = step.withColumn("seg", F.coalesce(F.get("rest", F.col("c")), F.lit(""))).withColumn("rest", _after(F.col("rest"), F.col("c") + 1))
        step = staged(step.drop("c"), f"tree{level}")
        done.append(step.where("few").select(*names))
        step = step.where("NOT few").drop("few")
        kids = step.groupBy(*node, "seg").agg(F.sum("n").alias("k"), F.sum("urls").alias("u"), F.sum("allow").alias("ab"), F.sum("block").alias("kb"))
        sizes = kids.groupBy(*node).agg(F.sum("k").alias("all"), F.count("*").alias("kinds"), F.sum("ab").alias("ah"), F.sum("kb").alias("kh"))
        seen = F.col("ab") + F.col("kb")
        kept = (F.col("kinds") < FEW) | (F.col("k") >= LITERAL * F.col("all"))
        own = (F.col("u") >= MANY) | ((seen >= FEW) & ~_same_rate())
        literal = kids.join(sizes, node).where(kept | own).select(*node, "seg", F.lit(True).alias("literal"), (~kept).alias("mine"))
        step = step.join(literal, [*node, "seg"], "left")
        variable = F.col("literal").isNull() & (F.col("seg") != "")
        step = step.withColumn("own", F.concat("own", F.array(F.coalesce("mine", F.lit(False))))).drop("mine")
        step = staged(step.withColumn("t", F.concat("t", F.when(variable, "/*").otherwise(F.col("seg")))).drop("literal"), f"level{level}")
        done.append(step.where("seg = ''").select(*names))
        todo = step.where("seg <> ''").drop("seg")
        if len(done) > 30:
            done = [staged(_united(done), "done")]
    return staged(_united(done), "generalised")


def _alike(cells: DataFrame, node: list[str]) -> DataFrame:
    """(node, head, alike): whether a head's sub-templates ``tail`` and block rate do not differ from its node's pool."""
    cells = cells.groupBy(*node, "head", "tail").agg(*[F.sum(c).alias(c) for c in ("n", "allow", "block")])
    branch = cells.groupBy(*node, "head").agg(F.sum("n").alias("nb"), F.sum("allow").alias("ab"), F.sum("block").alias("kb"))
    pool = cells.groupBy(*node, "tail").agg(F.sum("n").alias("ns"))
    whole = pool.groupBy(*node).agg(F.sum("ns").alias("nh"), F.count("*").alias("kinds"))
    marks = cells.groupBy(*node).agg(F.sum("allow").alias("ah"), F.sum("block").alias("kh"))
    part = cells.select(*node, "head", "tail", "n").join(pool, [*node, "tail"])
    fit = part.groupBy(*node, "head").agg(F.sum(F.col("n") * F.col("n") / F.col("ns").cast("double")).alias("q"))
    both = branch.join(fit, [*node, "head"]).join(whole, node).join(marks, node)
    free = F.col("kinds") - 1
    chi = F.col("q") * F.col("nh") / F.col("nb") - F.col("nb")
    shape = chi <= free + SIGMAS * F.sqrt(2.0 * free) + 1e-9
    return both.select(*node, "head", (shape & _same_rate()).alias("alike"))


def _merged(tree: DataFrame) -> DataFrame:
    """(host, t, template): ``t`` with ``~`` for the branches that do not differ from their node's pool.

    First the host's branches, then level by level those of every node that reaches below the third
    segment, has several branches, and holds sub-trees: ends of paths are not compared below the first level.
    Children that are literal by evidence alone are compared in any node, and join ``*`` if alike."""
    rows = tree.groupBy("host", "t").agg(F.max("own").alias("own"), *[F.sum(c).alias(c) for c in ("n", "allow", "block")]).withColumn("rest", _segments(F.col("t")))
    head, tail = F.coalesce(F.get("rest", F.lit(0)), F.lit("")), _after(F.col("rest"), F.lit(1))
    rows = rows.withColumn("deep", F.size("rest")).withColumn("head", head).withColumn("rest", tail).withColumn("own", _after(F.col("own"), F.lit(1))).withColumn("tail", F.array_join("rest", ""))
    todo = rows.join(_alike(rows, ["host"]), ["host", "head"]).withColumn("template", F.when(F.col("alike"), "/~").otherwise(F.col("head")))
    kept = ["host", "t", "template", "own", "rest", "deep", "n", "allow", "block"]
    todo, done, level, node = staged(todo.select(*kept), "branches1"), [], 1, ["host", "template"]
    while level == 1 or not todo.isEmpty():
        level += 1
        spread = todo.groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.max(F.size("rest")).alias("down"), F.max("deep").alias("deep_"),
                                          F.max(F.array_contains("own", True)).alias("some"))
        spread = spread.select(*node, _shared(F.col("lo"), F.col("hi")).alias("c"), "down", (F.col("deep_") > 3).alias("far"), "some")
        spread = spread.withColumn("open", (F.col("far") & (F.col("down") - F.col("c") > 1)) | (F.col("some") & (F.col("down") > F.col("c")))).drop("down", "some")
        step = todo.join(spread, node)
        step = step.withColumn("c", F.when(F.col("open"), F.col("c")).otherwise(F.size("rest")))
        step = step.withColumn("template", F.concat("template", F.array_join(F.slice("rest", F.lit(1), F.col("c")), "")))
        step = step.withColumn("head", F.coalesce(F.get("rest", F.col("c")), F.lit(""))).withColumn("rest", _after(F.col("rest"), F.col("c") + 1))
        step = step.withColumn("mine", F.coalesce(F.get("own", F.col("c")), F.lit(False))).withColumn("own", _after(F.col("own"), F.col("c") + 1))
        step = staged(step.drop("c"), f"nodes{level}")
        done.append(step.where("NOT open").select("host", "t", "template"))
        step = step.where("open").drop("open").withColumn("tail", F.array_join("rest", ""))
        if step.isEmpty():
            break
        inner = step.groupBy(*node, "head").agg(F.max(F.size("rest")).alias("below"))
        step = step.join(_alike(step, node).join(inner, [*node, "head"]), [*node, "head"])
        branch = F.when(F.col("alike") & F.col("far") & (F.col("below") > 0), "/~").when(F.col("alike") & F.col("mine"), "/*").otherwise(F.col("head"))
        step = step.withColumn("template", F.concat("template", branch))
        todo = staged(step.select(*kept), f"branches{level}")
        if len(done) > 30:
            done = [staged(_united(done), "done")]
    return _united(done)


def _purity(block: Column, seen: Column, prior: Column) -> Column:
    return (block + SMOOTH * prior) / (seen + SMOOTH)


def templates(urls: DataFrame) -> DataFrame:
    """(host, masked, template, purity) for ``urls`` (host, masked, n, urls, allow, block)."""
    tree = _generalised(urls)
    tree = staged(tree.join(_merged(tree), ["host", "t"]), "branches")
    total = tree.agg(F.sum("block").alias("k"), (F.sum("allow") + F.sum("block")).alias("l")).first()
    # at most even odds: no template is rejected without labelled relatives
    base = F.lit(min(0.5, ((total["k"] or 0) + 1.0) / ((total["l"] or 0) + 2.0)))
    hosts = tree.groupBy("host").agg(F.sum("block").alias("kh"), F.sum(F.col("allow") + F.col("block")).alias("lh"))
    key = ["host", "template"]
    found = tree.groupBy(*key).agg(F.sum("block").alias("k"), F.sum(F.col("allow") + F.col("block")).alias("l")).join(hosts, "host")
    judged = found.select(*key, _purity(F.col("k"), F.col("l"), _purity(F.col("kh"), F.col("lh"), base)).alias("purity"))
    return tree.join(judged, key).select("host", "masked", "template", "purity")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    Null and malformed urls share the empty host and path; repeated rows each count and each give a
    row; other columns are not read; an empty table gives no rows."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), _masked(F.col("path")).alias("masked"))
    distinct = rows.groupBy("host", "masked", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"))
    counted = distinct.groupBy("host", "masked").agg(F.count("*").alias("urls"), *[F.sum(c).alias(c) for c in ("n", "allow", "block")])
    known = staged(templates(staged(counted, "urls")), "templates")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(known, ["host", "masked"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
