"""Floating-point columns of the catalogue's queries."""

from __future__ import annotations

FLOATS: dict[str, list[str]] = {
    "ip_profile": ["admin_share"],
    "traffic_segments": ["pct"],
    "agent_rollup": ["pct"],
    "status_mix": ["pct"],
    "log_window": ["span_hours"],
    "suspect_profile": ["content_share"],
    "health_score": ["value"],
    "search_universe": ["position"],
    "query_idf": ["idf"],
    "weekly_series": ["position"],
    "mann_kendall": ["s", "z"],
    "trend_label": ["trend_slope"],
    "page_rollup": ["avg_position_90d", "trend_slope"],
    "monthly_trend": ["position", "ctr"],
    "brand_split": ["position", "ctr", "click_share"],
    "zero_click_queries": ["ctr", "position"],
    "position_bands": ["p1_3", "p4_10", "p11_20", "p21", "median_ctr_4_10"],
    "graduation_score": ["nonbrand_share", "nonbrand_position", "page1_share", "ctr_at_rank", "score"],
    "window_delta": ["position_long", "position_short", "position_delta"],
    "opportunity_queries": ["position", "ctr"],
    "ctr_position_reading": ["position", "ctr"],
    "cosine_pairs": ["click_cosine", "impression_cosine", "topic_cosine"],
    "shortlist_pairs": ["click_cosine", "impression_cosine", "topic_cosine", "score"],
    "unique_click_share": ["share_a", "share_b"],
    "align_weekly": ["position_a", "position_b"],
    "parity_test": ["position_a", "position_b", "simultaneity", "click_parity", "impression_parity", "position_delta"],
    "assess_redundant": ["dominance", "median_position", "weak_click_share"],
    "spearman": ["rho"],
    "rolling_clicks": ["mean_a", "mean_b"],
    "cohort_join": ["position_a", "position_b"],
    "headline_per_day": ["clicks_per_day", "impressions_per_day", "ctr"],
    "shift_share": ["lost_clicks", "new_clicks", "retained_change", "share_lost", "share_retained", "share_new"],
    "position_decomposition": ["a_all", "a_retained", "b_retained", "b_all", "compositional", "real"],
    "categorical_effect": ["chi2", "cramers_v"],
    "categorical_effect_p": ["chi2", "cramers_v", "p"],
    "ctr_at_rank": ["coefficient", "standard_error"],
    "link_velocity": ["links_a_domain", "follow_share", "follow_domain_share", "won_a_month", "lost_a_month"],
    "changepoint": ["sup_f", "before", "after"],
    "categorical_effect_two": ["chi2", "cramers_v"],
    "counterfactual": ["slope", "intercept", "r2", "actual", "elasticity", "predicted", "deviation"],
    "anchor_profile": ["money_pct", "brand_pct", "toxic_pct"],
    "keyword_master": ["search_volume", "kd", "cpc"],
    "keyword_clusters": ["volume"],
    "templated_ratio": ["templated"],
    "doorway_verdict": ["templated"],
    "parse_stats": ["rate"],
    "appearance_share": ["web_share", "non_web_share"],
    "surface_filter": ["delta"],
    "leakage": ["change"],
    "host_profile": ["hero_frac"],
    "brand_leakage": ["position"],
    "host_scores": ["overall"],
    "attribution_reconcile": ["gap_share"],
    "read_period_export": ["ctr"],
    "pair_verdict": ["score", "topic_cosine"],
    "cluster_winner": ["score"],
    "plan_summary": ["share"],
    "template_similarity": ["similarity"],
    "template_candidates": ["similarity"],
}
