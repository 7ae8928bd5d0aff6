"""DataFrame-in, DataFrame-out operators."""

from marketspark.operators.align import asof_join, attach_containing_window, rolling_sentiment_at_ticks
from marketspark.operators.correlation import correlation_matrix, window_correlation
from marketspark.operators.lexicon import score_lexicon
from marketspark.operators.records_ops import change_feed, dedupe, manual_posts
from marketspark.operators.sequence import forward_fill, lag_rows, previous_value, row_index
from marketspark.operators.signals import (alert_buffer, filter_alerts, post_alerts, signal_alerts, signals,
                                           signals_stream_preset, strong_buy_flag)
from marketspark.operators.topk import (first_k_by_ordinal, in_universe, last_n_per_key, latest_per_key,
                                        merge_board, top_k, unsupported)
from marketspark.operators.windows import (join_windows, ohlc_bars, price_windows, sentiment_windows,
                                           trailing_sentiment)

__all__ = ["asof_join", "attach_containing_window", "rolling_sentiment_at_ticks", "correlation_matrix",
           "window_correlation", "score_lexicon", "change_feed", "dedupe", "manual_posts", "forward_fill",
           "lag_rows", "previous_value", "row_index", "alert_buffer", "filter_alerts", "post_alerts",
           "signal_alerts", "signals", "signals_stream_preset", "strong_buy_flag", "first_k_by_ordinal",
           "in_universe", "last_n_per_key", "latest_per_key", "merge_board", "top_k", "unsupported",
           "join_windows", "ohlc_bars", "price_windows", "sentiment_windows", "trailing_sentiment"]
