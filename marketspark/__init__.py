"""marketspark — market-sentiment analytics as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) plus parameters and returns a
DataFrame (or Column).  Nothing is collected to the driver except single scalars
used as literals (for example an ``as_of`` instant), so Catalyst can push them into
the parquet scan.
"""

from marketspark.session import build_session, checkpoint_dir, ensure_utc

__all__ = ["build_session", "checkpoint_dir", "ensure_utc"]
