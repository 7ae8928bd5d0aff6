"""Guarded Pearson correlation built from partial-aggregatable built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Aggregate Column: Pearson r of (x, y) over complete pairs.

    n <= 1 -> 0.0; zero variance on either side -> 0.0; else cov / sqrt(varx * vary).
    ``F.corr`` is avoided on purpose: under ANSI mode it raises on zero variance even
    inside a CASE.  covar_pop / var_pop merge map-side, so a hot group is pre-reduced
    before the shuffle.
    """
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    n = F.count(xx)
    den = F.sqrt(F.var_pop(xx) * F.var_pop(yy))
    r = F.try_divide(F.covar_pop(xx, yy), den)
    flat = (F.max(xx) == F.min(xx)) | (F.max(yy) == F.min(yy))
    return F.when((n <= 1) | flat | (den == 0) | r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r)
