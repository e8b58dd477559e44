"""Declarative rule tables of the engine, as plain rows and as small broadcast frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Metric, bad_dir, scope, absolute rules (op, threshold, severity), z bounds of severity 2 and 3.
REGISTRY = [
    ("vix_contango_pct", -1, "MACRO", [("<", 0.0, 3), ("<", 3.0, 1)], 2.0, 3.0),
    ("move", 1, "MACRO", [(">", 120.0, 2), (">", 100.0, 1)], 2.0, 3.0),
    ("vix", 1, "MACRO", [(">", 30.0, 2), (">", 22.0, 1)], 2.0, 3.0),
    ("vvix", 1, "MACRO", [], 2.0, 3.0),
    ("vrp_num", 1, "MACRO", [(">", 10.0, 1)], 2.0, 3.0),
    ("vix_term_ratio", 1, "MACRO", [(">=", 1.0, 2)], 2.0, 3.0),
    ("dix_pct", -1, "MACRO", [], 2.0, 3.0),
    ("gex_billions", -1, "MACRO", [], 2.0, 3.0),
    ("credit_spread", 1, "MACRO", [(">", 5.0, 2)], 2.0, 3.0),
    ("credit_z", 1, "MACRO", [(">", 2.0, 2), (">", 1.0, 1)], 2.0, 3.0),
    ("nfci", 1, "MACRO", [(">", 0.0, 2), (">", -0.3, 1)], 2.0, 3.0),
    ("hyg_tlt_ratio", -1, "MACRO", [], 2.0, 3.0),
    ("net_liq", -1, "MACRO", [], 2.0, 3.0),
    ("pct_200ma", -1, "MACRO", [("<", 30.0, 2), ("<", 40.0, 1)], 2.0, 3.0),
    ("pct_20ma", -1, "MACRO", [], 2.0, 3.0),
    ("breadth_diff_pct", 1, "MACRO", [(">", 1.5, 1)], 2.0, 3.0),
    ("trin", 1, "MACRO", [(">", 2.0, 1)], 2.5, 3.5),
    ("dxy", 1, "MACRO", [], 2.0, 3.0),
    ("cg_z", -1, "MACRO", [("<", -2.0, 2), ("<", -1.0, 1)], 2.0, 3.0),
    ("tqqq_drag_pct", -1, "MACRO", [("<", -2.0, 1)], 2.0, 3.0),
    ("dpsv_pct", 0, "STOCK", [], 2.0, 3.0),
    ("ivr_pct", -1, "STOCK", [("<", 10.0, 1)], 2.0, 3.0),
    ("expected_move_pct", 1, "STOCK", [], 2.5, 3.5),
    ("short_gamma_m", -1, "STOCK", [], 2.5, 3.5),
    ("oi_pcr", 0, "STOCK", [], 2.5, 3.5),
    ("zgl_price", 0, "STOCK", [], 2.5, 3.5),
    ("call_wall", 0, "STOCK", [], 2.5, 3.5),
    ("put_wall", 0, "STOCK", [], 2.5, 3.5),
    ("distance_to_call_wall_pct", 0, "STOCK", [], 2.5, 3.5),
    ("distance_to_put_wall_pct", 0, "STOCK", [], 2.5, 3.5),
    ("distance_to_zgl_pct", 0, "STOCK", [], 2.5, 3.5),
    ("gamma_0dte_m", -1, "STOCK", [], 2.5, 3.5),
    ("gamma_1_7d_m", -1, "STOCK", [], 2.5, 3.5),
    ("gamma_8_30d_m", 0, "STOCK", [], 2.5, 3.5),
    ("gamma_31_60d_m", 0, "STOCK", [], 2.5, 3.5),
    ("gamma_all_m", 0, "STOCK", [], 2.5, 3.5),
    ("vanna_m", 0, "STOCK", [], 2.5, 3.5),
    ("charm_m", 0, "STOCK", [], 2.5, 3.5),
    ("long_gamma_m", 0, "STOCK", [], 2.5, 3.5),
    ("iv_skew", 0, "STOCK", [], 2.5, 3.5),
]

# Theme, hits needed, base severity, conditions (input, op, threshold).
THEMES = [
    ("high_risk_selloff", 3, 3, [("vix_contango_pct", "<", 3.0), ("move", ">", 110.0), ("hyg_tlt_ratio_roc", "<", -2.0), ("pct_200ma", "<", 45.0), ("credit_z", ">", 1.0)]),
    ("fake_selloff_reversal", 3, 2, [("trin", ">", 2.0), ("vrp_num", ">", 10.0), ("pct_20ma", "<", 15.0)]),
    ("crowding_fragility", 3, 2, [("breadth_diff_pct", ">", 1.5), ("pct_20ma", "<", 40.0), ("ivr_low", "<", 15.0), ("pct_200ma", "<", 55.0)]),
]

# Fixed values of the alert gate.
GATE = {"floor": 0.35, "solo_severity": 3, "solo_confidence": 0.5, "cluster_severity": 2, "cluster_confidence": 0.5, "cluster_count": 2}

# Index, metric, scope, weight.
ENVIRONMENT = [
    ("idx_risk_pressure", "vix", "MACRO", 1.0), ("idx_risk_pressure", "vvix", "MACRO", 0.6), ("idx_risk_pressure", "move", "MACRO", 0.8), ("idx_risk_pressure", "vix_contango_pct", "MACRO", 1.0),
    ("idx_liquidity_stress", "credit_spread", "MACRO", 1.0), ("idx_liquidity_stress", "nfci", "MACRO", 1.0),
    ("idx_breadth_decay", "pct_200ma", "MACRO", 1.0), ("idx_breadth_decay", "pct_20ma", "MACRO", 0.7), ("idx_breadth_decay", "trin", "MACRO", 0.5), ("idx_breadth_decay", "breadth_diff_pct", "MACRO", 0.8),
    ("idx_options_fragility", "ivr_pct", "STOCK_ANY", 1.0), ("idx_options_fragility", "expected_move_pct", "STOCK_ANY", 0.8), ("idx_options_fragility", "short_gamma_m", "STOCK_ANY", 0.6),
    ("idx_flow_behavior", "dix_pct", "MACRO", 1.0), ("idx_flow_behavior", "gex_billions", "MACRO", 0.8), ("idx_flow_behavior", "tqqq_drag_pct", "MACRO", 0.5),
]
MIN_OBSERVATIONS, MIN_INDEX_COVERAGE, MIN_STATE_COVERAGE = 60, 0.50, 0.65

# Pillar, weight.
PILLARS = [("water_stock", 1.25), ("flow_pulse", 1.15), ("funding_health", 1.25), ("credit_transmission", 1.0), ("market_distribution", 0.85), ("tail_resilience", 0.75)]
MIN_PILLAR_COVERAGE, MIN_COMPOSITE_COVERAGE = 0.35, 0.50

# Component, pillar, column, weight, direction, mode, window, least observations, baseline, tolerated lag.
COMPONENTS = [
    ("net_liq_level", "water_stock", "net_liq_b", 1.25, 1, "level", 0, 52, 156, 8),
    ("reserves_buffer", "water_stock", "reserves_t", 1.1, 1, "reserves_buffer", 0, 1, 1, 8),
    ("m2_growth", "water_stock", "m2_yoy", 0.65, 1, "level", 0, 12, 36, 40),
    ("net_liq_20d", "flow_pulse", "net_liq_b", 1.25, 1, "change", 20, 40, 156, 8),
    ("tga_5d", "flow_pulse", "tga_b", 1.0, -1, "change", 5, 40, 252, 3),
    ("fed_assets_20d", "flow_pulse", "fed_assets_b", 0.75, 1, "change", 20, 40, 156, 8),
    ("sofr_iorb", "funding_health", "sofr_iorb_bps", 0.9, -1, "level", 0, 40, 252, 3),
    ("tgcr_iorb", "funding_health", "tgcr_iorb_bps", 0.8, -1, "level", 0, 40, 252, 3),
    ("effr_iorb", "funding_health", "effr_iorb_bps", 0.8, -1, "level", 0, 40, 252, 3),
    ("sofr_75_iorb", "funding_health", "sofr_75_iorb_bps", 0.65, -1, "level", 0, 40, 252, 3),
    ("sofr_dispersion", "funding_health", "sofr_dispersion_bps", 0.65, -1, "level", 0, 40, 252, 3),
    ("nfci", "funding_health", "nfci", 1.1, -1, "level", 0, 26, 104, 8),
    ("move", "funding_health", "move", 0.55, -1, "level", 0, 60, 252, 3),
    ("hy_spread", "credit_transmission", "hy_spread", 1.2, -1, "level", 0, 60, 252, 3),
    ("ig_spread", "credit_transmission", "ig_spread", 0.8, -1, "level", 0, 60, 252, 3),
    ("hyg_tlt_21d", "credit_transmission", "hyg_tlt_ratio", 0.85, 1, "pct_change", 21, 60, 252, 3),
    ("hyg_shares_20d", "credit_transmission", "hyg_sh_m", 0.45, 1, "pct_change", 20, 40, 252, 3),
    ("jnk_shares_20d", "credit_transmission", "jnk_sh_m", 0.35, 1, "pct_change", 20, 40, 252, 3),
    ("breadth_20", "market_distribution", "pct_20ma", 0.9, 1, "level", 0, 60, 252, 3),
    ("breadth_50", "market_distribution", "pct_50ma", 0.8, 1, "level", 0, 60, 252, 3),
    ("breadth_200", "market_distribution", "pct_200ma", 1.0, 1, "level", 0, 60, 252, 3),
    ("concentration", "market_distribution", "breadth_diff_pct", 0.85, -1, "level", 0, 60, 252, 3),
    ("vix_futures_curve", "tail_resilience", "vix_futures_contango_pct", 0.8, 1, "level", 0, 60, 252, 3),
    ("vix_spot_curve", "tail_resilience", "vix_ratio_contango_pct", 0.4, 1, "level", 0, 60, 252, 3),
    ("vvix", "tail_resilience", "vvix", 0.7, -1, "level", 0, 60, 252, 3),
    ("skew", "tail_resilience", "skew", 0.55, -1, "level", 0, 60, 252, 3),
]
# Column, bound that the latest value reaches under stress.
FUNDING_GUARDS = [("sofr_iorb_bps", 5.0), ("tgcr_iorb_bps", 5.0), ("effr_iorb_bps", 5.0), ("sofr_75_iorb_bps", 10.0), ("sofr_dispersion_bps", 25.0), ("nfci", 0.25), ("move", 130.0)]
CREDIT_GUARDS = [("hy_spread", 5.0), ("ig_spread", 1.5)]


def registry(spark: SparkSession, rows: list[tuple] = REGISTRY) -> DataFrame:
    return spark.createDataFrame(rows, "metric string, bad_dir int, kind string, rules array<struct<op:string,bound:double,sev:int>>, z2 double, z3 double")


def themes(spark: SparkSession, rows: list[tuple] = THEMES) -> DataFrame:
    """One row per condition."""
    flat = [(t, need, base, *c) for t, need, base, conditions in rows for c in conditions]
    return spark.createDataFrame(flat, "theme string, min_hits int, base_sev int, input string, op string, bound double")


def environment(spark: SparkSession, rows: list[tuple] = ENVIRONMENT) -> DataFrame:
    return spark.createDataFrame(rows, "index string, metric string, spec_scope string, weight double")


def components(spark: SparkSession, rows: list[tuple] = COMPONENTS) -> DataFrame:
    return spark.createDataFrame(rows, "component string, pillar string, column string, weight double, direction int, mode string, step int, min_obs int, baseline int, tolerance int")


def pillars(spark: SparkSession, rows: list[tuple] = PILLARS) -> DataFrame:
    return spark.createDataFrame(rows, "pillar string, pillar_weight double")
