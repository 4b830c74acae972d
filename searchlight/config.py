"""Thresholds of the search-overlap analysis. Overriding an unknown name is an error."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class OverlapConfig:
    # The usual thresholds.
    recent_window_days: int = 90
    trend_weeks: int = 26
    idf_topic_max_df_fraction: float = 0.30
    distinct_page_unique_share: float = 0.60
    dup_content_min: float = 0.94
    dup_twin_topic_min: float = 0.88
    dup_twin_content_min: float = 0.50
    overlap_watch_topic_min: float = 0.80
    overlap_watch_content_min: float = 0.78
    overlap_watch_min_shared: int = 2
    shortlist_min_click_cosine: float = 0.30
    shortlist_min_impr_cosine: float = 0.40
    shortlist_min_topic_profile_sim: float = 0.85
    shortlist_min_shared_topic_queries: int = 1
    shortlist_max_pairs_per_url: int = 12
    cosine_max_posting_df_fraction: float = 1.0
    ongoing_min_click_parity: float = 0.40
    ongoing_min_impr_parity: float = 0.40
    ongoing_max_position_delta: float = 5.0
    ongoing_max_position_abs: float = 10.0
    ongoing_min_simultaneity_pct: float = 0.50
    ongoing_min_qualifying_queries: int = 1
    ongoing_min_query_total_clicks: int = 15
    ongoing_min_query_clicks_each_side: int = 3
    ongoing_min_weeks_observed: int = 8
    cluster_min_clicks_for_single_query_ongoing: int = 50
    redundant_min_shared_queries: int = 3
    redundant_dominance_frac: float = 0.70
    redundant_buried_position: float = 15.0
    redundant_max_weak_click_share: float = 0.25
    handoff_smoothing_weeks: int = 4
    handoff_min_anticorrelation: float = -0.30
    handoff_min_coexistence_weeks: int = 3
    handoff_post_silence_weeks: int = 6
    leakage_warning_pct: float = 0.10
    leakage_critical_pct: float = 0.25
    serp_non_web_appearance_dominance: float = 0.40
    serp_attribution_min_delta: float = 0.30
    score_weight_clicks: float = 0.5
    score_weight_trend: float = 0.3
    score_weight_position: float = 0.2
