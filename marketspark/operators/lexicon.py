"""Lexicon (valence) sentiment scorer as Spark array logic, each text in its own row.

Per post: tokens = words (letters and '$') and single symbols (emoji) of the whole text; each token's valence
comes from the lexicon; a negator among the three previous tokens flips and damps it, a booster /
dampener right before it adds / takes ``BOOST`` in the valence's direction.  Then, as in the published
lexicon method (Hutto & Gilbert, 2014): compound = s / sqrt(s^2 + ALPHA) with s the valence sum; pos / neg / neu are
the shares of (|v| + 1) mass of positive / negative tokens and the count of neutral tokens.

``Rules(clauses=True)`` adds the method's further rules: boosters up to three tokens back, fading with
distance and not across a valued token; words in capitals in a text that is not all capitals; a contrast word that
damps what comes before it and raises what follows; exclamation and question marks.  Entries of the lexicon may be
phrases, matched longest first from the left; the words of a matched phrase count as one token.

A lexicon of up to ``IN_ROW`` entries is looked up inside the row, in a hash table that enters the plan as one folded
constant: no token leaves its row and the texts are scanned once, without any exchange.  A larger one is joined:
each text's distinct tokens (and word groups) by their hash key, hot tokens dealt over tasks, and only hits come back, as a
map of the text's own valued tokens.  Both ways feed the same expressions.

Rows that share an id but not the text are scored apart.  A token listed twice takes the mean of its valences.
A null or token-free text scores 0 throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.skew import skew_join
from marketspark.functions.sentiment import NEGATIVE_WORDS, POSITIVE_WORDS, scale_score, with_scores

# ---------------------------------------------------------------------------
# Fixed values of the lexicon method (published constants).
ALPHA = 15.0          # compound normalisation
NEGATION = -0.74      # factor applied when negated
BOOST = 0.293         # booster / dampener increment
NEGATION_SCOPE = 3    # how many previous tokens a negator reaches
TOKEN_PATTERN = r"[\p{L}$]+|\p{So}"
NEGATORS = ["not", "no", "never", "none", "nothing", "neither", "nor", "nobody", "nowhere", "without",
            "cannot"]
BOOSTERS = ["very", "really", "extremely", "absolutely", "completely", "totally", "incredibly",
            "hugely", "so", "most"]
DAMPENERS = ["slightly", "somewhat", "barely", "hardly", "marginally", "partly"]
BOOST_FADE = [1.0, 0.95, 0.9]          # by distance of the booster
CAPITALS = 0.733                       # a word in capitals
CONTRAST = ["but"]
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAIM, MOST_EXCLAIMS = 0.292, 4      # per mark
QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
DEFAULT_VALENCE = 2.0  # bundled default lexicon: the keyword lists at +/- this valence
# ---------------------------------------------------------------------------


def default_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(w, DEFAULT_VALENCE) for w in POSITIVE_WORDS] + [(w, -DEFAULT_VALENCE) for w in NEGATIVE_WORDS]
    return spark.createDataFrame(rows, "token string, valence double")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


@dataclass(frozen=True)
class Rules:
    """The word lists and which rules apply; the defaults are the published ones without the clause rules."""
    negators: list[str] = field(default_factory=lambda: list(NEGATORS))
    boosters: list[str] = field(default_factory=lambda: list(BOOSTERS))
    dampeners: list[str] = field(default_factory=lambda: list(DAMPENERS))
    contrast: list[str] = field(default_factory=lambda: list(CONTRAST))
    clauses: bool = False


IN_ROW = 20_000          # lexicon entries that may enter the plan
PHRASE_WORDS = 4         # words of the longest phrase that is looked for


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(slots)).cast("int")


def _quoted(token: str) -> str:
    return "'" + token.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _constant(entries: list[tuple[str, float]]) -> Callable[[Column], Column]:
    """Valence of a token (null if unlisted) from a hash table of constants: one array access and a look at its few entries."""
    slots = max(16, 1 << (2 * len(entries)).bit_length())
    table: list[list[str]] = [[] for _ in range(slots)]
    for token, v in entries:
        table[zlib.crc32(token.encode()) % slots].append(f"named_struct('t', {_quoted(token)}, 'v', {float(v)!r}D)")
    none = "CAST(array() AS array<struct<t:string,v:double>>)"
    known = F.expr("array(" + ", ".join(f"array({', '.join(x)})" if x else none for x in table) + ")")
    return lambda token: F.get(F.filter(F.get(known, _slot(token, slots)), lambda e: e["t"] == token), 0)["v"]


def _entries(lexicon: DataFrame) -> DataFrame:
    return (lexicon.where(F.col("token").isNotNull() & F.col("valence").isNotNull()).groupBy("token")
            .agg(F.avg(F.col("valence").cast("double")).alias("valence")))


def neighbours(low: Column, words: int) -> Column:
    """All groups of ``words`` neighbouring tokens, joined by a space."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(low) - words + 1, F.lit(1))), lambda i: i + words - 1 <= F.size(low))
    return F.transform(at, lambda i: F.array_join(F.slice(low, i, words), " "))


def _joined(rows: DataFrame, lex: DataFrame, longest: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``rows`` with the map ``_m`` of their valued tokens, and the look-up in it."""
    every = F.array_distinct(F.flatten(F.array(F.col("_low"), *[neighbours(F.col("_low"), n) for n in range(2, longest + 1)])))
    used = rows.select("_h", F.explode(every).alias("token")).distinct()
    hits = skew_join(used, lex, ["token"]).groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("token", "valence"))).alias("_m"))
    return rows.join(hits, "_h", "left"), lambda token: F.element_at("_m", token)


def _phrases(low: Column, single: Column, valence: Callable[[Column], Column], longest: int) -> Column:
    """Chosen phrases, left to right and longest first: array of (at, words, v); ``at`` counts from 0."""
    found = F.filter(F.flatten(F.array(*[F.filter(F.transform(neighbours(low, n), lambda g, i: F.struct(
        i.alias("at"), F.lit(-n).alias("less"), valence(g).alias("v"))), lambda e: e["v"].isNotNull()) for n in range(longest, 1, -1)])), lambda e: e["at"] >= 0)
    none = F.array().cast("array<struct<at:int,words:int,v:double>>")
    start = F.struct(F.lit(0).alias("free"), none.alias("kept"))
    take = F.aggregate(F.array_sort(found), start, lambda t, e: F.when(e["at"] < t["free"], t).otherwise(F.struct(
        (e["at"] - e["less"]).alias("free"), F.concat(t["kept"], F.array(F.struct(e["at"].alias("at"), (-e["less"]).alias("words"), e["v"].alias("v")))).alias("kept"))))
    return take["kept"]


def _with_phrases(raw: Column, phrases: Column) -> Column:
    """``raw`` put together from the stretches between the chosen phrases: each token is copied once, whatever their number."""
    def end(p):
        return p["at"] + p["words"]

    def stretch(p, k):
        before = F.when(k == 0, F.lit(0)).otherwise(end(F.get(phrases, k - 1)))
        return F.concat(F.slice(raw, before + 1, p["at"] - before), F.array(p["v"]), F.array_repeat(F.lit(None).cast("double"), p["words"] - 1))

    rest = F.slice(raw, end(F.get(phrases, F.size(phrases) - 1)) + 1, F.size(raw))
    return F.when(F.size(phrases) == 0, raw).otherwise(F.concat(F.flatten(F.transform(phrases, stretch)), rest))


def _capital(token: Column) -> Column:
    """A word of capitals only: it has a letter with case and none in lower case."""
    return (F.upper(token) == token) & (F.lower(token) != token)


def _boost(rules: Rules, previous: Column) -> Column:
    return F.when(previous.isin(*rules.boosters), F.lit(BOOST)).when(previous.isin(*rules.dampeners), F.lit(-BOOST)).otherwise(F.lit(0.0))


def _valences(rules: Rules) -> Column:
    """Adjusted valence of every token of ``_low`` (``_raw`` its valence, ``_tok`` as written); 0 for unvalued ones."""
    low, raw = F.col("_low"), F.col("_raw")

    def back(array, i, k):
        return F.when(i >= k, F.get(array, i - k))

    def adjusted(v, i):
        negated = F.coalesce(F.greatest(*[F.coalesce(back(low, i, F.lit(k)).isin(*rules.negators), F.lit(False))
                                          for k in range(1, NEGATION_SCOPE + 1)]), F.lit(False))
        if rules.clauses:
            loud = F.when(F.col("_mixed") & _capital(F.get("_tok", i)), F.lit(CAPITALS)).otherwise(F.lit(0.0))
            v = v + F.signum(v) * loud
            for k, fade in enumerate(BOOST_FADE, 1):
                quiet = F.coalesce(back(raw, i, F.lit(k)), F.lit(0.0)) == 0
                caps = F.when(F.col("_mixed") & _capital(F.coalesce(back(F.col("_tok"), i, F.lit(k)), F.lit(""))), F.lit(CAPITALS)).otherwise(F.lit(0.0))
                b = _boost(rules, F.coalesce(back(low, i, F.lit(k)), F.lit("")))
                v = v + F.when(quiet, F.signum(v) * (b + F.signum(b) * caps) * fade).otherwise(F.lit(0.0))
        else:
            v = v + F.signum(v) * _boost(rules, F.coalesce(back(low, i, F.lit(1)), F.lit("")))
        return F.when(negated, v * NEGATION).otherwise(v)

    return F.transform(raw, lambda v, i: F.when(F.coalesce(v, F.lit(0.0)) == 0, F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))).otherwise(adjusted(v, i)))


def _finish(s: Column, pos_mass: Column, neg_mass: Column, neu_n: Column) -> Column:
    total = pos_mass + neg_mass + neu_n
    share = lambda x: F.when(total > 0, F.round(x / total, 3)).otherwise(F.lit(0.0))
    return F.struct(F.round(s / F.sqrt(s * s + F.lit(ALPHA)), 4).alias("compound"), share(pos_mass).alias("pos"),
                    share(neg_mass).alias("neg"), share(neu_n).alias("neu"))


def _marks(text: Column) -> Column:
    """What exclamation and question marks add."""
    text = F.coalesce(text, F.lit(""))
    bangs = F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_EXCLAIMS)) * F.lit(EXCLAIM)
    asks = F.regexp_count(text, F.lit(r"\?"))
    return bangs + F.when(asks > MOST_QUESTIONS, F.lit(MANY_QUESTIONS)).when(asks > 1, asks * F.lit(QUESTION)).otherwise(F.lit(0.0))


def score_lexicon(posts: DataFrame, lexicon: DataFrame | None = None, text_col: str = "text",
                  id_col: str = "post_id", rules: Rules = Rules()) -> DataFrame:
    """Append compound/pos/neg/neu from the lexicon scorer (see module doc)."""
    lex = _entries(lexicon if lexicon is not None else default_lexicon(posts.sparkSession))
    some = lex.limit(IN_ROW + 1).collect()                         # the lexicon itself where it is small
    longest = lex.agg(F.max(F.size(F.split("token", " ")))).first()[0] or 1 if len(some) > IN_ROW else \
        max((len(r["token"].split(" ")) for r in some), default=1)
    longest = min(longest, PHRASE_WORDS)
    packed = posts.select(F.struct(*[F.col(f"`{c}`") for c in posts.columns]).alias("_row"))
    text = F.col(f"_row.`{text_col}`")
    rows = packed.withColumn("_tok", F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0), F.array().cast("array<string>")))
    rows = rows.withColumn("_low", tokens(text) if not rules.clauses else F.transform("_tok", lambda t: F.lower(t)))
    rows = rows.withColumn("_low", F.coalesce("_low", F.array().cast("array<string>")))
    if len(some) > IN_ROW:
        rows, valence = _joined(rows.withColumn("_h", F.struct(F.xxhash64("_low"), F.xxhash64(F.lit(1), "_low"))), lex, longest)
    else:
        valence = _constant([(r["token"], r["valence"]) for r in some])
    rows = rows.withColumn("_raw", F.transform("_low", lambda t: F.coalesce(valence(t), F.lit(0.0))))
    if longest > 1:                      # a phrase's valence stands at its first word; its other words leave the count
        rows = rows.withColumn("_phrases", _phrases(F.col("_low"), F.col("_raw"), valence, longest))
        rows = rows.withColumn("_raw", _with_phrases(F.col("_raw"), F.col("_phrases")))
    if rules.clauses:
        words = F.filter("_tok", lambda t: F.lower(t) != F.upper(t))
        loud = F.size(F.filter(words, _capital))
        rows = rows.withColumn("_mixed", (loud > 0) & (loud < F.size(words)))
    rows = rows.withColumn("_v", _valences(rules))
    if rules.clauses:
        turn = F.filter(F.transform("_low", lambda t, i: F.when(t.isin(*rules.contrast), i)), lambda i: i.isNotNull())
        rows = rows.withColumn("_turn", F.get(turn, 0)).withColumn("_v", F.when(F.col("_turn").isNull(), F.col("_v")).otherwise(
            F.transform("_v", lambda v, i: v * F.when(i < F.col("_turn"), F.lit(BEFORE_CONTRAST)).when(i > F.col("_turn"), F.lit(AFTER_CONTRAST)).otherwise(F.lit(1.0)))))
    rows = rows.withColumn("_some", F.filter("_v", lambda v: v != 0)).withColumn("_none", F.size(F.filter("_v", lambda v: v == 0)).cast("double"))
    add = lambda keep: F.aggregate("_some", F.lit(0.0), lambda t, v: t + keep(v))
    rows = rows.select("_row", "_none", add(lambda v: v).alias("_sum"), add(lambda v: F.when(v > 0, v + 1).otherwise(0.0)).alias("_pm"),
                       add(lambda v: F.when(v < 0, -v + 1).otherwise(0.0)).alias("_nm"))
    if rules.clauses:
        rows = rows.withColumn("_mark", _marks(text))
        more = F.when(F.col("_sum") == 0, F.lit(0.0)).otherwise(F.signum("_sum") * F.col("_mark"))
        rows = rows.select("_row", "_none", (F.col("_sum") + more).alias("_sum"),
                           (F.col("_pm") + F.when(F.col("_pm") > F.col("_nm"), F.col("_mark")).otherwise(F.lit(0.0))).alias("_pm"),
                           (F.col("_nm") + F.when(F.col("_nm") > F.col("_pm"), F.col("_mark")).otherwise(F.lit(0.0))).alias("_nm"))
    out = rows.select("_row", _finish(F.col("_sum"), F.col("_pm"), F.col("_nm"), F.col("_none")).alias("_s"))
    return out.select("_row.*", *[F.coalesce(F.col(f"_s.{f}"), F.lit(0.0)).alias(f) for f in ("compound", "pos", "neg", "neu")])


def score_posts(posts: DataFrame, model: str | None = None, text_col: str = "text", id_col: str = "post_id",
                rules: Rules = Rules()) -> DataFrame:
    """Append compound/pos/neg/neu by scorer name, case-insensitive: ``vader`` (also the default, and
    what unknown names and ``finbert``, whose runtime is absent, fall back to) is the lexicon
    scorer, ``llm`` the scaled lexicon score, ``keyword`` the keyword scorer."""
    name = (model or "vader").lower()
    if name == "keyword":
        return with_scores(posts, text_col, "keyword")
    scored = score_lexicon(posts, text_col=text_col, id_col=id_col, rules=rules)
    if name != "llm":
        return scored
    s = scale_score(F.struct("compound", "pos", "neg", "neu"))
    return scored.select(*posts.columns, *[s[f].alias(f) for f in ("compound", "pos", "neg", "neu")])
