"""Labels, bands, indexes and formats: Column -> Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (thresholds and label texts of the reference).
LABEL_THRESHOLD = 0.15                 # post label BULLISH / BEARISH, strict
STATUS_STRONG, STATUS_MODERATE, STATUS_BEAR = 0.4, 0.1, -0.1
MOOD5_CUTS = (25, 45, 55, 75)          # <25, <45, <=55, <=75, else
MOOD5_LABELS = ("EXTREME FEAR", "FEAR", "NEUTRAL", "GREED", "EXTREME GREED")
MOOD3_GREED, MOOD3_FEAR = 55, 45       # >55 GREED, <45 FEAR, else NEUTRAL
MACRO_DEFAULT_AVG = 0.15               # macro report default when the average is NULL or 0
CORR_STRONG, CORR_WEAK, CORR_MISSING = 0.5, 0.2, 0.5
# ---------------------------------------------------------------------------


def label(c: Column, t: float = LABEL_THRESHOLD) -> Column:
    return F.when(c > t, "BULLISH").when(c < -t, "BEARISH").otherwise("NEUTRAL")


def status(c: Column) -> Column:
    return (F.when(c > STATUS_STRONG, "strongly bullish").when(c > STATUS_MODERATE, "moderately bullish")
            .when(c < STATUS_BEAR, "bearish").otherwise("neutral"))


def chart_band(c: Column, t: float = LABEL_THRESHOLD) -> Column:
    """Chart colouring band: inclusive thresholds (unlike ``label``)."""
    return F.when(c >= t, "up").when(c <= -t, "down").otherwise("flat")


def corr_band(r: Column, same: Column) -> Column:
    v = F.coalesce(r, F.lit(CORR_MISSING))
    return (F.when(same, "diagonal").when(v > CORR_STRONG, "strong").when(v < CORR_WEAK, "weak")
            .otherwise("mid"))


def fear_greed(avg: Column) -> Column:
    """int((avg + 1) * 50) with truncation toward zero; NULL average counts as 0."""
    return ((F.coalesce(avg, F.lit(0.0)) + 1.0) * 50).cast("int")


def mood5(score: Column) -> Column:
    a, b, c, d = MOOD5_CUTS
    l0, l1, l2, l3, l4 = MOOD5_LABELS
    return (F.when(score < a, l0).when(score < b, l1).when(score <= c, l2).when(score <= d, l3)
            .otherwise(l4))


def mood3(score: Column) -> Column:
    return F.when(score > MOOD3_GREED, "GREED").when(score < MOOD3_FEAR, "FEAR").otherwise("NEUTRAL")


def open_or_price(open_: Column, price: Column) -> Column:
    """``open or price``: a NULL or zero open falls back to the price."""
    return F.coalesce(F.nullif(open_, F.lit(0.0)), price)


def pct_change(price: Column, base: Column) -> Column:
    """Percent change vs ``base`` rounded to 2 digits; base <= 0 (or NULL) -> 0.0."""
    return F.when(base > 0, F.round((price - base) / base * 100, 2)).otherwise(F.lit(0.0))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def thousands(n: Column) -> Column:
    """Integer with thousands separators (``{:,}``)."""
    return F.format_number(n.cast("long"), 0)


def py_strip(text: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind (Spark's
    ``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
