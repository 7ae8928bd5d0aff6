"""Text helpers: fixed templates and browser rounding.

Exact fixed-point number text (Python / browser rules) lives in ``functions/fixed.py``
and runs natively; nothing here needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """``Math.round``: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def render(template: str, **parts: Column) -> Column:
    """Fill the ``{key}`` slots of a fixed text template with Columns (one ``concat``)."""
    out, rest = [], template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        out.append(F.lit(rest[:i]))
        out.append(parts[rest[i + 1:j]])
        rest = rest[j + 1:]
    out.append(F.lit(rest))
    return F.concat(*out)
