"""Exact fixed-point number text as native Spark expressions.

Java's formatter (behind ``format_string``) rounds the shortest decimal string of a
double, so 2.675 prints as '2.68' although the stored binary value is 2.67499999...
Python's ``format(x, '.2f')`` and a browser's ``x.toFixed(2)`` round the exact binary
value instead; they differ only on exact binary ties (0.125 -> '0.12' in Python, '0.13'
in a browser).

The exact value is recovered without leaving the JVM: for a finite |x| in
[2^e, 2^(e+1)), L = |x| * 2^(52 - e) is an integer below 2^53 (scaling by a power of two
is exact), so |x| * 10^d = L * 10^d / 2^(52 - e) exactly, and the rounding is integer
arithmetic on DECIMAL(38, 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEC = "decimal(38,0)"
_TINY = 2.0 ** -70          # below this, |x| * 10^d (d <= 6) rounds to 0 without a tie


def _pow2_dec(s: Column) -> Column:
    """2^s as DECIMAL(38, 0) for 0 <= s <= 124, exactly (two exact long shifts)."""
    one = F.lit(1).cast("long")
    lo = F.call_function("shiftleft", one, F.least(s, F.lit(62))).cast(_DEC)
    hi = F.call_function("shiftleft", one, F.greatest(s - 62, F.lit(0))).cast(_DEC)
    return F.when(s <= 62, lo).otherwise(lo * hi)


def _exponent(a: Column) -> Column:
    """floor(log2(a)) for a > 0, corrected for floating error in log2."""
    e0 = F.floor(F.log2(a)).cast("int")
    e1 = e0 - F.when(F.pow(F.lit(2.0), e0) > a, 1).otherwise(0)
    return e1 + F.when(F.pow(F.lit(2.0), e1 + 1) <= a, 1).otherwise(0)


def with_fixed_text(df: DataFrame, specs: dict) -> DataFrame:
    """Append text columns ``{out: (x, digits, ties)}``: x rounded to ``digits`` decimals on
    its exact binary value.

    ``ties='even'``: Python ``format(x, '.Nf')`` (half-even; '-' kept for -0.0).
    ``ties='away'``: browser ``toFixed`` (half away from zero; no sign for -0.0).
    Supports 0 <= digits <= 6 and |x| < 1e12; other finite values fall back to Java's
    formatter, non-finite values to their cast text.  Each step is one projection holding
    that step for every spec, so every intermediate is computed once, the generated code
    stays small and the plan stays shallow.
    """
    for out, (_, digits, ties) in specs.items():
        if not 0 <= digits <= 6:
            raise ValueError("digits must be in 0..6")
        if ties not in ("even", "away"):
            raise ValueError("ties must be 'even' or 'away'")

    def c(out: str, name: str) -> str:
        return f"_fx_{out}_{name}"

    def col(out: str, name: str) -> Column:
        return F.col(c(out, name))

    def step(d: DataFrame, name: str, make) -> DataFrame:
        return d.withColumns({c(o, name): make(o, x, dg, t) for o, (x, dg, t) in specs.items()})

    scale = lambda dg: F.lit(10 ** dg).cast(_DEC)
    d = step(df, "x", lambda o, x, dg, t: x.cast("double"))
    d = step(d, "a", lambda o, x, dg, t: F.abs(col(o, "x")))
    d = step(d, "e", lambda o, x, dg, t: _exponent(col(o, "a")))
    d = step(d, "n", lambda o, x, dg, t: (col(o, "a") * F.pow(F.lit(2.0), F.lit(52) - col(o, "e")))
             .cast("long").cast(_DEC) * scale(dg))
    d = step(d, "d", lambda o, x, dg, t: _pow2_dec(F.lit(52) - col(o, "e")))
    # decimal division rounds the quotient, so floor() may be one off: the exact remainder
    # fixes it
    d = step(d, "f", lambda o, x, dg, t: F.floor(col(o, "n") / col(o, "d")).cast(_DEC))
    d = step(d, "r", lambda o, x, dg, t: col(o, "n") - col(o, "f") * col(o, "d"))
    d = step(d, "q0", lambda o, x, dg, t: F.when(col(o, "r") < 0, col(o, "f") - 1)
             .when(col(o, "r") >= col(o, "d"), col(o, "f") + 1).otherwise(col(o, "f")))
    d = step(d, "r2", lambda o, x, dg, t: (col(o, "n") - col(o, "q0") * col(o, "d")) * F.lit(2).cast(_DEC))

    def rounded(o, x, dg, t):
        tie_up = (F.pmod(col(o, "q0"), F.lit(2).cast(_DEC)) == 1) if t == "even" else F.lit(True)
        q = col(o, "q0") + F.when(col(o, "r2") > col(o, "d"), 1).when((col(o, "r2") == col(o, "d")) & tie_up, 1) \
            .otherwise(0)
        return F.when(col(o, "a") < F.lit(_TINY), F.lit(0).cast(_DEC)).otherwise(q.cast(_DEC))
    d = step(d, "q", rounded)

    def text(o, x, dg, t):
        xx, q = col(o, "x"), col(o, "q")
        int_part = F.floor(q / scale(dg)).cast("long").cast("string")
        frac = F.lpad(F.pmod(q, scale(dg)).cast("long").cast("string"), dg, "0")
        body = F.concat(int_part, F.lit("."), frac) if dg else int_part
        neg = ((xx < 0) | ((xx == 0) & xx.cast("string").startswith("-"))) if t == "even" else (xx < 0)
        txt = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body)
        finite = ~F.isnan(xx) & (col(o, "a") != F.lit(float("inf")))
        return (F.when(xx.isNull(), F.lit(None).cast("string")).when(~finite, xx.cast("string"))
                .when(col(o, "a") < F.lit(1e12), txt).otherwise(F.format_string(f"%.{dg}f", xx)))
    d = d.withColumns({o: text(o, x, dg, t) for o, (x, dg, t) in specs.items()})
    return d.drop(*[c(o, n) for o in specs for n in ("x", "a", "e", "n", "d", "f", "r", "q0", "r2", "q")])
