from marketspark.functions.bands import (chart_band, clock, corr_band, fear_greed, iso, label, mood3, mood5,
                                        open_or_price, pct_change, status, thousands)
from marketspark.functions.sentiment import (get_scorer, keyword_counts, scale_score, score_keyword,
                                            tone_from_logits, with_scores)
from marketspark.functions.fixed import with_fixed_text
from marketspark.functions.formats import js_round, render
from marketspark.functions.stats import pearson

__all__ = ["chart_band", "clock", "corr_band", "fear_greed", "iso", "label", "mood3", "mood5", "pct_change", "open_or_price",
           "status", "thousands", "get_scorer", "keyword_counts", "scale_score", "score_keyword",
           "tone_from_logits", "with_scores", "pearson", "with_fixed_text", "js_round", "render"]
