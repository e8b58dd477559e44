"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

import re

from .plans import specs

FACTS = """
daily AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'MACRO' ELSE o_orderpriority END AS scope, o_orderdate::DATE AS d,
    sum((o_totalprice::DECIMAL(18, 2) * 100)::BIGINT)::BIGINT AS total, (max(o_totalprice::DECIMAL(18, 2)) * 100)::BIGINT AS most, count(*) AS n FROM orders GROUP BY ALL
), facts AS (
  SELECT scope, m.metric AS metric, d, m.value AS value FROM (SELECT scope, d, unnest([
    {'metric': 'vix', 'value': (total // 200)::DOUBLE / 10000}, {'metric': 'move', 'value': (most // 30)::DOUBLE / 10000},
    {'metric': 'vix_contango_pct', 'value': (total // n // 400 - 20000)::DOUBLE / 10000}, {'metric': 'pct_200ma', 'value': n::DOUBLE * 20},
    {'metric': 'credit_z', 'value': ((total - most) // 1000)::DOUBLE / 10000}, {'metric': 'trin', 'value': n::DOUBLE / 2}]) AS m FROM daily)
)"""

RULES = ", ".join(f"('{m}', {i}, '{op}', {bound}, {sev})" for m, _, _, rules, _, _ in specs.REGISTRY for i, (op, bound, sev) in enumerate(rules))
BOUNDS = ", ".join(f"('{m}', {direction}, {z2}, {z3})" for m, direction, _, _, z2, z3 in specs.REGISTRY)

GIVEN = ("('vix_contango_pct', 'MACRO', 'vix_contango_pct'), ('move', 'MACRO', 'move'), ('pct_200ma', 'MACRO', 'pct_200ma'), ('credit_z', 'MACRO', 'credit_z'), ('trin', 'MACRO', 'trin'), ('hyg_tlt_ratio_roc', '5-LOW', 'vix'), "
         "('vrp_num', '2-HIGH', 'vix'), ('pct_20ma', '2-HIGH', 'trin'), ('breadth_diff_pct', '3-MEDIUM', 'trin'), ('ivr_low', '4-NOT SPECIFIED', 'trin')")  # fmt: skip
CONDITIONS = ("('high_risk_selloff', 3, 3, 'vix_contango_pct', '<', 3), ('high_risk_selloff', 3, 3, 'move', '>', 110), ('high_risk_selloff', 3, 3, 'hyg_tlt_ratio_roc', '<', -2), ('high_risk_selloff', 3, 3, 'pct_200ma', '<', 45), ('high_risk_selloff', 3, 3, 'credit_z', '>', 1), "
              "('fake_selloff_reversal', 3, 2, 'trin', '>', 2), ('fake_selloff_reversal', 3, 2, 'vrp_num', '>', 10), ('fake_selloff_reversal', 3, 2, 'pct_20ma', '<', 15), "
              "('crowding_fragility', 3, 2, 'breadth_diff_pct', '>', 1.5), ('crowding_fragility', 3, 2, 'pct_20ma', '<', 40), ('crowding_fragility', 3, 2, 'ivr_low', '<', 15), ('crowding_fragility', 3, 2, 'pct_200ma', '<', 55)")  # fmt: skip

STATS = FACTS + f""", rules(metric, i, op, bound, sev) AS (VALUES {RULES}), registry(metric, bad, z2, z3) AS (VALUES {BOUNDS}),
windowed AS (
  SELECT *, row_number() OVER w AS n, avg(value) OVER f AS mean, stddev_samp(value) OVER f AS dev, list(value) OVER f AS seen,
    value - lag(value, 1) OVER w AS c1, value - lag(value, 5) OVER w AS c5, value - lag(value, 21) OVER w AS c21, value - lag(value, 63) OVER w AS c63
  FROM facts WINDOW w AS (PARTITION BY scope, metric ORDER BY d), f AS (PARTITION BY scope, metric ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)
), stats AS (
  SELECT * EXCLUDE (seen, mean, dev), CASE WHEN n >= 30 THEN CASE WHEN dev > 0 THEN (value - mean) / dev ELSE 0 END END AS z,
    CASE WHEN n >= 30 THEN len([x FOR x IN seen IF x < value])::DOUBLE / len(seen) * 100 END AS pct FROM windowed
), hits AS (
  SELECT s.scope, s.metric, s.d, max(r.sev) AS abs_sev FROM stats s JOIN rules r USING (metric)
  WHERE (r.op = '<' AND s.value < r.bound) OR (r.op = '>' AND s.value > r.bound) OR (r.op = '>=' AND s.value >= r.bound) GROUP BY ALL
), graded AS MATERIALIZED (
  SELECT s.*, g.bad, coalesce(h.abs_sev, 0) AS abs_sev,
    CASE WHEN g.bad <> 0 AND z * g.bad >= g.z3 THEN 3 WHEN g.bad <> 0 AND z * g.bad >= g.z2 THEN 2 ELSE 0 END AS z_sev
  FROM stats s JOIN registry g USING (metric) LEFT JOIN hits h USING (scope, metric, d)
), entry AS (
  SELECT metric, arg_min(op, sev * 100 + i) AS op, arg_min(bound, sev * 100 + i) AS bound FROM rules GROUP BY metric
), events AS MATERIALIZED (
  SELECT d, scope, metric, value, '1D' AS window_scope, 'single' AS layer, abs_sev::INTEGER AS severity, round(greatest(0.5, least(1.0, n / 252.0)), 3) AS confidence,
    CASE WHEN bad >= 0 THEN 'up' ELSE 'down' END AS direction, '' AS resonance_key FROM graded WHERE abs_sev > 0
  UNION ALL SELECT d, scope, metric, value, '252D', 'single', z_sev::INTEGER, round(least(1.0, n / 252.0), 3), CASE WHEN z > 0 THEN 'up' ELSE 'down' END, '' FROM graded WHERE z_sev > 0
  UNION ALL SELECT d, scope, metric, value, '1D+5D+21D', 'multiwindow', 3, round(least(1.0, n / 252.0), 3), CASE WHEN bad > 0 THEN 'up' ELSE 'down' END, ''
    FROM graded WHERE bad <> 0 AND c1 * bad > 0 AND c5 * bad > 0 AND ((bad > 0 AND pct >= 90) OR (bad < 0 AND pct <= 10))
), given(input, scope, metric) AS (VALUES {GIVEN}), themes(theme, need, base, input, op, bound) AS (VALUES {CONDITIONS}), inputs AS (
  SELECT d, input, CASE WHEN input = 'hyg_tlt_ratio_roc' THEN value / nullif(lag(value, 20) OVER (PARTITION BY scope, metric ORDER BY d), 0) * 100 - 100 ELSE value END AS value FROM facts JOIN given USING (scope, metric)
), themed AS (
  SELECT d, theme, need, base, count(*) AS hits FROM inputs JOIN themes USING (input) WHERE (op = '<' AND value < bound) OR (op = '>' AND value > bound) GROUP BY ALL
), resonated AS (
  SELECT d, theme AS resonance_key, least(3, base + hits - need)::INTEGER AS severity, round(least(1.0, 0.5 + 0.12 * hits), 3)::DOUBLE AS confidence FROM themed WHERE hits >= need
), everything AS (
  SELECT d, scope, metric, window_scope, layer, severity, confidence, resonance_key FROM events
  UNION ALL SELECT d, 'MACRO', 'RESONANCE', 'multi', 'resonance', severity, confidence, resonance_key FROM resonated
), eligible AS MATERIALIZED (
  SELECT *, count(*) FILTER (layer = 'single' AND severity >= 2 AND confidence >= 0.5) OVER (PARTITION BY d) AS crowd FROM everything WHERE confidence >= 0.35
), alerts AS (
  SELECT d, metric, scope, window_scope, layer, severity::INTEGER AS severity, confidence, resonance_key FROM eligible
  WHERE layer <> 'single' OR (severity >= 3 AND confidence >= 0.5) OR (severity >= 2 AND confidence >= 0.5 AND crowd >= 2)
  QUALIFY row_number() OVER (PARTITION BY d, metric, scope, window_scope, layer ORDER BY severity DESC, confidence DESC, resonance_key) = 1
)"""

SPINE = """ends AS (SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders), spine AS (SELECT unnest(range(first, last + 1, INTERVAL 1 DAY))::DATE AS d FROM ends), weekdays AS (SELECT d FROM spine WHERE isodow(d) < 6)"""


def _nth(month: int, weekday: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"{first} + (({weekday} - isodow({first}) + 7) % 7 + {7 * (n - 1)})::INT"


def _near(month: int, day: int, saturday: str, sunday: str = "d + 1") -> str:
    return f"(SELECT CASE isodow(d) WHEN 6 THEN {saturday} WHEN 7 THEN {sunday} ELSE d END FROM (SELECT make_date(y, {month}, {day}) AS d))"


#: ``sessions`` (d, seq, half_day) of the days from ``ends.first`` to ``ends.last``.
SESSIONS = f"""years AS (SELECT unnest(range(year(first), year(last) + 1)) AS y FROM ends), golden AS (
  SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) // 4 AS dd, (y // 100) % 4 AS e, (y // 100 - (y // 100 + 8) // 25 + 1) // 3 AS g FROM years
), moons AS (SELECT *, (19 * a + b - dd - g + 15) % 30 AS h FROM golden), sundays AS (SELECT *, (32 + 2 * e + 2 * (c // 4) - h - c % 4) % 7 AS l FROM moons
), easters AS (SELECT y, make_date(y, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31, (h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1) AS d FROM sundays
), holidays AS (
  SELECT {_near(1, 1, "NULL")} AS d FROM years UNION ALL SELECT {_nth(1, 1, 3)} FROM years WHERE y >= 1998 UNION ALL SELECT {_nth(2, 1, 3)} FROM years UNION ALL SELECT d - 2 FROM easters
  UNION ALL SELECT make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INT FROM years UNION ALL SELECT {_near(6, 19, "d - 1")} FROM years WHERE y >= 2022 UNION ALL SELECT {_near(7, 4, "d - 1")} FROM years
  UNION ALL SELECT {_nth(9, 1, 1)} FROM years UNION ALL SELECT {_nth(11, 4, 4)} FROM years UNION ALL SELECT {_near(12, 25, "d - 1")} FROM years
  UNION ALL SELECT unnest(['1994-04-27', '2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14', '2004-06-11', '2007-01-02', '2012-10-29', '2012-10-30', '2018-12-05', '2025-01-09'])::DATE
), early AS (
  SELECT make_date(y, 7, 3) AS d FROM years WHERE (y >= 1995 AND isodow(make_date(y, 7, 3)) IN (1, 2, 4)) OR (y >= 2013 AND isodow(make_date(y, 7, 3)) = 3)
  UNION ALL SELECT make_date(y, 7, 5) FROM years WHERE y BETWEEN 1995 AND 2012 AND isodow(make_date(y, 7, 5)) = 5
  UNION ALL SELECT {_nth(11, 4, 4)} + 1 FROM years WHERE y >= 1993 UNION ALL SELECT make_date(y, 12, 24) FROM years WHERE y >= 1993 AND isodow(make_date(y, 12, 24)) < 5
), sessions AS (
  SELECT d, row_number() OVER (ORDER BY d) AS seq, d IN (SELECT d FROM early) AS half_day FROM (SELECT unnest(range(first, last + 1, INTERVAL 1 DAY))::DATE AS d FROM ends) WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM holidays WHERE d IS NOT NULL)
), ordinals AS (SELECT d, count(seq) OVER (ORDER BY d) AS upto FROM (SELECT unnest(range(first - 1, last + 1, INTERVAL 1 DAY))::DATE AS d FROM ends) LEFT JOIN sessions USING (d))"""

ALIGNED = FACTS + f""", {SPINE}, names AS (SELECT DISTINCT scope, metric FROM facts), aligned AS (
  SELECT n.scope, n.metric, w.d, f.value, f.d AS source_date FROM (SELECT * FROM names, weekdays) AS n(scope, metric, d) JOIN weekdays w ON w.d = n.d
  ASOF LEFT JOIN facts f ON f.scope = n.scope AND f.metric = n.metric AND f.d <= n.d
), counted AS (SELECT d, sum((isodow(d) < 6)::INT) OVER (ORDER BY d) AS upto FROM (SELECT unnest(range(first - 40, last + 10, INTERVAL 1 DAY))::DATE AS d FROM ends))"""

DAILY = "o AS (SELECT o_orderdate::DATE AS d, count(*) AS n, max(o_totalprice) AS price FROM orders GROUP BY 1), s AS (SELECT l_shipdate::DATE AS d, count(*) AS n, max(l_extendedprice) AS ship_price FROM lineitem GROUP BY 1)"

ENVIRONMENT = STATS + f""", days AS (
  SELECT d, m AS metric, g.scope, pct, n, g.bad AS own_bad FROM graded g JOIN (VALUES ('vix', true, 'vix'), ('move', true, 'move'), ('vix_contango_pct', true, 'vix_contango_pct'), ('pct_200ma', true, 'pct_200ma'),
    ('trin', true, 'trin'), ('credit_spread', true, 'credit_z'), ('nfci', true, 'credit_z'), ('ivr_pct', false, 'vix'), ('expected_move_pct', false, 'move')) x(m, macro, own) ON g.metric = x.own AND (g.scope = 'MACRO') = x.macro
), spec(idx, metric, weight) AS (VALUES {", ".join(f"('{i}', '{m}', {w})" for i, m, _, w in specs.ENVIRONMENT)}), quality AS (
  SELECT days.d, s.idx, s.metric, s.weight, least(1.0, n / 252.0) AS q, CASE WHEN r.bad > 0 THEN pct ELSE 100 - pct END AS danger
  FROM days JOIN spec s USING (metric) JOIN registry r USING (metric) WHERE n >= 60 AND pct IS NOT NULL
), part AS (SELECT d, idx, metric, weight, sum(danger * q) / sum(q) AS danger, avg(q) AS q FROM quality GROUP BY ALL
), scores AS (
  SELECT d, p.idx AS "index", round(sum(danger * weight * q) / sum(weight * q), 1) AS score, round(sum(weight * q) / any_value(t.total), 3) AS coverage
  FROM part p JOIN (SELECT idx, sum(weight) AS total FROM spec GROUP BY idx) t ON t.idx = p.idx GROUP BY d, p.idx
)"""

LIQUIDITY = ALIGNED + f""", spec(component, pillar, col, weight, dir, mode, step, min_obs, base, tol) AS (VALUES {", ".join(str(c) for c in specs.COMPONENTS)}),
mapped(col, scope, metric) AS (VALUES ('net_liq_b', '2-HIGH', 'vix'), ('reserves_t', '2-HIGH', 'trin'), ('tga_b', '3-MEDIUM', 'vix'), ('fed_assets_b', '3-MEDIUM', 'move'), ('sofr_iorb_bps', '4-NOT SPECIFIED', 'trin'),
  ('nfci', '4-NOT SPECIFIED', 'vix_contango_pct'), ('move', 'MACRO', 'move'), ('hy_spread', 'MACRO', 'credit_z'), ('hyg_tlt_ratio', '5-LOW', 'vix'), ('pct_20ma', '5-LOW', 'pct_200ma'), ('vvix', 'MACRO', 'vix')),
held AS (
  SELECT s.*, a.d, a.value, a.source_date, CASE s.step WHEN 5 THEN lag(value, 5) OVER w WHEN 20 THEN lag(value, 20) OVER w WHEN 21 THEN lag(value, 21) OVER w END AS back
  FROM aligned a JOIN mapped m USING (scope, metric) JOIN spec s USING (col) WHERE a.value IS NOT NULL WINDOW w AS (PARTITION BY s.component ORDER BY a.d)
), moved AS (
  SELECT *, CASE mode WHEN 'change' THEN value - back WHEN 'pct_change' THEN value / nullif(back, 0) * 100 - 100 ELSE value END AS signal FROM held
), ranked AS (
  SELECT m.*, count(DISTINCT source_date) FILTER (signal IS NOT NULL) OVER (PARTITION BY component ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS observations,
    list(signal) FILTER (signal IS NOT NULL) OVER (PARTITION BY component ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS seen FROM moved m
), lagged AS (
  SELECT r.*, (b.upto - a.upto)::INTEGER AS lag_days FROM ranked r JOIN counted a ON a.d = r.source_date - 1 JOIN counted b ON b.d = r.d - 1
), components AS (
  SELECT d, component, pillar, weight, observations, lag_days, signal IS NOT NULL AND observations >= min_obs AS enough,
    CASE WHEN mode = 'reserves_buffer' THEN CASE WHEN value >= 3 THEN least(100, 80 + (value - 3) * 40) WHEN value >= 2.85 THEN 55 + (value - 2.85) / 0.15 * 25 WHEN value >= 2.65 THEN 25 + (value - 2.65) / 0.2 * 30 ELSE greatest(0, 25 - (2.65 - value) * 50) END
      ELSE CASE WHEN list_min(seen) = list_max(seen) THEN 50.0 WHEN dir > 0 THEN len([x FOR x IN seen IF x <= signal]) * 100.0 / len(seen) ELSE 100 - len([x FOR x IN seen IF x <= signal]) * 100.0 / len(seen) END END AS raw_score,
    least(1.0, observations / greatest(1, base)) * 0.85::DOUBLE ** greatest(0, lag_days - tol) AS raw_quality FROM lagged
), scored AS (
  SELECT d, component, pillar, weight, CASE WHEN enough THEN round(raw_score, 1)::DOUBLE END AS score, CASE WHEN enough THEN round(raw_quality, 3)::DOUBLE ELSE 0.0::DOUBLE END AS quality, observations, lag_days FROM components
), totals AS (SELECT pillar, sum(round(weight * 100)::BIGINT)::BIGINT * 1000 AS total FROM spec GROUP BY pillar
), sums AS (
  SELECT d, pillar, coalesce(sum(round(weight * 100)::BIGINT * round(quality * 1000)::BIGINT) FILTER (score IS NOT NULL AND quality > 0), 0)::BIGINT AS w,
    (sum(round(score * 10)::BIGINT * round(weight * 100)::BIGINT * round(quality * 1000)::BIGINT) FILTER (score IS NOT NULL AND quality > 0))::BIGINT AS s FROM scored GROUP BY ALL
), pillars AS (
  SELECT d, pillar, CASE WHEN w > 0 AND w / total >= 0.35::DOUBLE THEN ((20 * s + w * 10) // (20 * w))::DOUBLE / 10 END AS score, ((2000 * w + total) // (2 * total))::DOUBLE / 1000 AS coverage FROM sums JOIN totals USING (pillar)
)"""

BARS = """ticks AS (
  SELECT p_brand AS symbol, l_shipdate::DATE AS d, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY p_brand, l_shipdate::DATE ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i,
    row_number() OVER (PARTITION BY p_brand, l_shipdate::DATE ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS j FROM lineitem JOIN part ON p_partkey = l_partkey
), bars AS (
  SELECT symbol, d, max(cents) FILTER (i = 1) AS open, max(cents) AS high, min(cents) AS low, max(cents) FILTER (j = 1) AS close, sum(q)::BIGINT AS volume FROM ticks GROUP BY ALL
)"""

CHAIN = """chain AS (
  SELECT p_brand AS ticker, (dayofyear(l_shipdate) % 70)::INTEGER AS dte, floor(p_retailprice) AS strike, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS cp, sum(l_quantity::BIGINT)::BIGINT AS oi,
    max(l_discount::DECIMAL(9, 2))::DOUBLE + 0.1::DOUBLE AS iv FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
), spots AS (
  SELECT p_brand AS ticker, floor(sum(round(p_retailprice * 100)::BIGINT)::DOUBLE / count(*)) / 100 AS spot FROM part GROUP BY ALL
), held AS (
  SELECT *, CASE WHEN dte < 1 THEN '0DTE' WHEN dte <= 7 THEN '1-7D' WHEN dte <= 30 THEN '8-30D' WHEN dte <= 60 THEN '31-60D' END AS bucket, greatest(dte, 0.25)::DOUBLE / 365 AS years
  FROM chain JOIN spots USING (ticker) WHERE dte <= 60 AND oi > 0 AND iv > 0
)"""


def _gamma(level: str) -> str:
    d = f"((ln({level} / strike) + (0.053::DOUBLE + iv * iv / 2) * years) / (iv * sqrt(years)))"
    return f"((CASE cp WHEN 'C' THEN 1 ELSE -1 END) * exp(-{d} * {d} / 2) / sqrt(2 * pi()) / ({level} * iv * sqrt(years)) * oi * 100 * {level} * {level} * 0.01::DOUBLE / 1000000)"


CURVE = CHAIN + f""", grid AS (SELECT i, h.*, spot * (0.8::DOUBLE + 0.4::DOUBLE * i / 160) AS level FROM held h, range(161) t(i)), valued AS (SELECT ticker, bucket, i::INTEGER AS i, level, {_gamma("level")} AS v FROM grid),
curve AS (SELECT ticker, bucket, i, level, sum(v) AS exposure FROM valued GROUP BY ALL UNION ALL SELECT ticker, 'ALL', i, level, sum(v) FROM valued GROUP BY ALL)"""


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x}) / sqrt(2)))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    erf = f"(1 - {poly} * exp(-{x} * {x} / 2))"
    return f"(CASE WHEN {x} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


MACRO = FACTS + ", wide AS (SELECT d, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in ("vix", "move", "vix_contango_pct", "pct_200ma", "credit_z", "trin")) + " FROM facts WHERE scope = 'MACRO' GROUP BY d)"
D1 = "(ln(spot / strike) + (0.053::DOUBLE + iv * iv / 2) * years) / (iv * sqrt(years))"



def _poc(bars: str) -> str:
    return f"""WITH {BARS}, given AS (SELECT * FROM {bars}), sp AS (SELECT symbol, min(close)::DOUBLE AS lo, max(close)::DOUBLE AS hi FROM given GROUP BY 1), e AS (SELECT symbol, lo, hi, (hi - lo) / 50 AS step, close, volume, d FROM given JOIN sp USING (symbol)),
    b AS (SELECT symbol, lo, step, CASE WHEN hi > lo THEN least(49, len([x FOR x IN range(51) IF lo + x * step <= close]) - 1) ELSE 0 END AS bin, sum(volume) AS v, min(d) AS met FROM e GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, met, bin) AS k FROM b) SELECT symbol, round(lo + (bin + 0.5::DOUBLE) * step, 4) AS poc, v::BIGINT AS bin_volume FROM r WHERE k = 1"""


ORACLE_SQL: dict[str, str] = {
    "zscore_252": f"WITH {STATS} SELECT scope, metric, d, round(z, 4) AS z FROM stats",
    "percentile_252": f"WITH {STATS} SELECT scope, metric, d, round(pct, 4) AS pct FROM stats",
    "window_changes": f"WITH {STATS} SELECT scope, metric, d, round(c1, 4) AS chg_1d, round(c5, 4) AS chg_5d, round(c21, 4) AS chg_21d, round(c63, 4) AS chg_63d FROM stats",
    "metric_snapshot": f"WITH {STATS} SELECT scope, metric, d, round(value, 4) AS value, n::INTEGER AS n, round(z, 4) AS z, round(pct, 4) AS pct, round(c1, 4) AS chg_1d, round(c5, 4) AS chg_5d, round(c21, 4) AS chg_21d, round(c63, 4) AS chg_63d, greatest(abs_sev, z_sev)::INTEGER AS severity FROM graded",
    "days_in_risk": f"""WITH {STATS}, marked AS (
      SELECT s.scope, s.metric, s.d, s.n, e.op, CASE e.op WHEN '<' THEN value < bound WHEN '>' THEN value > bound ELSE value >= bound END AS hit FROM stats s LEFT JOIN entry e USING (metric)
    ), islands AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY scope, metric ORDER BY d) AS island FROM marked)
    SELECT scope, metric, d, CASE WHEN op IS NOT NULL THEN (sum(hit::INT) OVER (PARTITION BY scope, metric, island ORDER BY d))::INTEGER END AS days_in_risk FROM islands""",
    "distance_to_threshold": f"WITH {STATS} SELECT s.scope, s.metric, s.d, round(CASE WHEN e.op IN ('>', '>=') THEN bound - value ELSE value - bound END, 4)::DOUBLE AS dist_to_thr FROM stats s LEFT JOIN entry e USING (metric)",
    "anomaly_single": f"WITH {STATS} SELECT d, scope, metric, round(value, 4) AS value, window_scope, severity, confidence::DOUBLE AS confidence, direction FROM events WHERE layer = 'single'",
    "anomaly_multiwindow": f"WITH {STATS} SELECT d, scope, metric, round(value, 4) AS value, window_scope, severity, confidence::DOUBLE AS confidence, direction FROM events WHERE layer = 'multiwindow'",
    "resonance": f"WITH {STATS} SELECT * FROM resonated",
    "alert_gate": f"WITH {STATS} SELECT * FROM alerts",
    "alert_fingerprint": f"WITH {STATS} SELECT d, count(*) AS alerts, md5(d::VARCHAR || '|' || string_agg(metric || ':' || scope || ':' || severity, '|' ORDER BY metric || ':' || scope || ':' || severity))[1:16] AS fingerprint FROM alerts GROUP BY d",
    "alert_cluster_names": f"WITH {STATS} SELECT d, count(*) AS n, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM events WHERE layer = 'single' AND severity >= 2 AND confidence >= 0.5 GROUP BY d HAVING count(*) >= 2",
    "asof_align": f"WITH {ALIGNED} SELECT * FROM aligned",
    "effective_obs": f"WITH {ALIGNED} SELECT scope, metric, d, count(DISTINCT source_date) OVER (PARTITION BY scope, metric ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_obs FROM aligned",
    "unified_outer_join": f"WITH {DAILY} SELECT d, o.n AS n, price, s.n AS n_post, ship_price FROM o FULL JOIN s USING (d)",
    "priority_merge": f"WITH {DAILY} SELECT d, coalesce(s.n, o.n) AS n, CASE WHEN s.n IS NOT NULL THEN 'first' ELSE 'second' END AS n_from FROM s FULL JOIN o USING (d)",
    "finalized_anti": f"WITH {DAILY} SELECT * FROM o WHERE d NOT IN (SELECT d FROM s WHERE n > 20)",
    "alerted_semi": f"WITH {DAILY} SELECT * FROM o WHERE d IN (SELECT d FROM s)",
    "environment_scores": f"WITH {ENVIRONMENT} SELECT * FROM scores",
    "environment_composite": f"""WITH {ENVIRONMENT} SELECT d, round(sum(score * coverage) FILTER (coverage >= 0.5) / sum(coverage) FILTER (coverage >= 0.5), 1) AS composite,
      round(coalesce(sum(coverage) FILTER ("index" IN ('idx_risk_pressure', 'idx_liquidity_stress', 'idx_breadth_decay')), 0) / 3, 4)::DOUBLE AS core_coverage, round(sum(coverage) / 5, 4)::DOUBLE AS overall_coverage FROM scores GROUP BY d""",
    "environment_state": f"""WITH {ENVIRONMENT}, w AS (
      SELECT d, max(score) FILTER ("index" = 'idx_risk_pressure') AS rp, max(score) FILTER ("index" = 'idx_liquidity_stress') AS ls, max(score) FILTER ("index" = 'idx_breadth_decay') AS bd, max(score) FILTER ("index" = 'idx_options_fragility') AS opf,
        coalesce(max(coverage) FILTER ("index" = 'idx_risk_pressure'), 0) AS rc, coalesce(max(coverage) FILTER ("index" = 'idx_liquidity_stress'), 0) AS lc, coalesce(max(coverage) FILTER ("index" = 'idx_breadth_decay'), 0) AS bc, coalesce(max(coverage) FILTER ("index" = 'idx_options_fragility'), 0) AS oc FROM scores GROUP BY d), fired AS (SELECT d, count(DISTINCT resonance_key) AS themes, bool_or(resonance_key = 'fake_selloff_reversal') AS fake FROM resonated GROUP BY d)
    SELECT d, CASE WHEN (rc + lc + bc) / 3 < 0.65 OR least(rc, lc, bc) < 0.5 THEN 'insufficient data' WHEN fake AND rp >= 85 THEN 'reversal watch' WHEN rp >= 90 AND bd >= 80 THEN 'panic watch' WHEN rp >= 75 OR ls >= 75 THEN 'fragile watch' WHEN themes >= 2 THEN 'resonance watch'
      WHEN rp <= 25 AND oc >= 0.5 AND opf >= 80 THEN 'low-vol crowding watch' ELSE 'normal watch' END AS state FROM w LEFT JOIN fired USING (d)""",
    "liquidity_components": f"WITH {LIQUIDITY} SELECT d, component, score, quality, observations, lag_days FROM scored",
    "liquidity_pillars": f"WITH {LIQUIDITY} SELECT * FROM pillars",
    "liquidity_state": f"""WITH {LIQUIDITY}, weights(pillar, pw) AS (VALUES {", ".join(str(p) for p in specs.PILLARS)}), guards AS (
      SELECT d, coalesce(bool_or((col = 'sofr_iorb_bps' AND value >= 5) OR (col = 'nfci' AND value >= 0.25) OR (col = 'move' AND value >= 130)), false) AS fg, coalesce(bool_or(col = 'hy_spread' AND value >= 5), false) AS cg FROM aligned JOIN mapped USING (scope, metric) GROUP BY d
    ), c AS (
      SELECT d, coalesce(sum(round(pw * 100)::BIGINT * round(coverage * 1000)::BIGINT) FILTER (score IS NOT NULL), 0)::BIGINT AS w, (sum(round(score * 10)::BIGINT * round(pw * 100)::BIGINT * round(coverage * 1000)::BIGINT) FILTER (score IS NOT NULL))::BIGINT AS s, max(score) FILTER (pillar = 'water_stock') AS ws, max(score) FILTER (pillar = 'flow_pulse') AS fp,
        max(score) FILTER (pillar = 'funding_health') AS fh, max(score) FILTER (pillar = 'credit_transmission') AS ct, max(score) FILTER (pillar = 'market_distribution') AS md FROM pillars JOIN weights USING (pillar) GROUP BY d
    ) SELECT d, CASE WHEN w / 625000 >= 0.5 THEN ((20 * s + w * 10) // (20 * w))::DOUBLE / 10 END AS composite, ((2000 * w + 625000) // 1250000)::DOUBLE / 1000 AS coverage, CASE
      WHEN w / 625000 < 0.5 OR ws IS NULL OR fp IS NULL THEN 'insufficient data' WHEN fh < 30 AND fg THEN 'funding stress' WHEN ct < 25 AND cg THEN 'credit contraction'
      ELSE (CASE WHEN ws >= 60 THEN CASE WHEN fp >= 60 THEN 'easing expansion' WHEN fp < 40 THEN 'high level, draining' ELSE 'high level, flat' END
        WHEN ws < 40 THEN CASE WHEN fp >= 60 THEN 'low-level repair' WHEN fp < 40 THEN 'systemic tightening' ELSE 'low-level watch' END
        ELSE CASE WHEN fp >= 60 THEN 'marginal refill' WHEN fp < 40 THEN 'mild tightening' ELSE 'balanced' END END) || CASE WHEN md < 45 THEN ', concentrated' ELSE '' END END AS state
    FROM c LEFT JOIN guards USING (d)""",
    "supports_drags": f"""WITH {LIQUIDITY}, e AS (SELECT * FROM scored WHERE quality >= 0.35 AND score IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, component) AS up, row_number() OVER (PARTITION BY d ORDER BY score, component) AS down FROM e)
    SELECT d, 'support' AS side, up::INTEGER AS place, component, score FROM r WHERE up <= 3 AND score >= 60 UNION ALL SELECT d, 'drag', down::INTEGER, component, score FROM r WHERE down <= 3 AND score <= 40""",
    "poc_profile": _poc("bars"),
    "poc_profile_prices": _poc("(SELECT symbol, d, close / 100::DOUBLE AS close, volume FROM bars)"),
    "obv_divergence": f"""WITH {BARS}, st AS (SELECT symbol, d, close, coalesce(sign(close - lag(close) OVER w)::BIGINT * volume, 0) AS step FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
    ob AS (SELECT *, (sum(step) OVER (PARTITION BY symbol ORDER BY d))::BIGINT AS obv, row_number() OVER (PARTITION BY symbol ORDER BY d) AS n FROM st),
    f AS (SELECT *, close - first_value(close) OVER w AS p, obv - first_value(obv) OVER w AS q FROM ob WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT symbol, d, obv, CASE WHEN n < 2 THEN 'insufficient' WHEN p > 0 AND q < 0 THEN 'bearish divergence' WHEN p < 0 AND q > 0 THEN 'bullish divergence' WHEN q > 0 THEN 'up together' ELSE 'down together' END AS status FROM f""",
    "vwap_session": f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM bars) SELECT symbol, round(sum(close * volume)::DOUBLE / sum(volume), 4) AS vwap, round((sum(close * volume) FILTER (k > 6))::DOUBLE / sum(volume) FILTER (k > 6), 4) AS vwap_before FROM r GROUP BY 1",
    "cmf21": f"WITH {BARS}, m AS (SELECT *, ((close - low) - (high - close))::DOUBLE / (CASE WHEN high = low THEN 0.01::DOUBLE ELSE high - low END) * volume AS flow FROM bars) SELECT symbol, d, round(sum(flow) OVER w / sum(volume) OVER w, 4) AS cmf FROM m WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)",
    "hv20": f"WITH {BARS}, m AS (SELECT *, ln(close::DOUBLE / lag(close) OVER (PARTITION BY symbol ORDER BY d)) AS r FROM bars) SELECT symbol, d, round(CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w * sqrt(252) * 100 END, 4) AS hv FROM m WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "hv20_vrp": f"""WITH {BARS}, {FACTS}, m AS (SELECT d, ln(close::DOUBLE / lag(close) OVER (ORDER BY d)) AS r FROM bars WHERE symbol = 'Brand#11'),
    h AS (SELECT d, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w * sqrt(252) * 100 END AS hv FROM m WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT d, round(value, 4) AS vix, round(hv, 4) AS hv, round(value - hv, 4) AS vrp FROM facts JOIN h USING (d) WHERE scope = 'MACRO' AND metric = 'vix'""",
    "ivr": f"WITH {BARS} SELECT symbol, round(CASE WHEN max(close) > min(close) THEN (arg_max(close, d) - min(close))::DOUBLE / (max(close) - min(close)) * 100 ELSE 0 END, 4) AS rank FROM bars GROUP BY 1",
    "leverage_drag": f"""WITH {BARS}, j AS (SELECT a.symbol AS base, c.symbol AS geared, a.d, a.close + 100000000 AS b, c.close + 100000000 AS g FROM bars a JOIN bars c ON a.d = c.d WHERE a.symbol = 'Brand#11' AND c.symbol <> a.symbol),
    r AS (SELECT base, geared, d, b::DOUBLE / lag(b) OVER w AS rb, g::DOUBLE / lag(g) OVER w AS rg FROM j WINDOW w AS (PARTITION BY base, geared ORDER BY d)), k AS (SELECT *, row_number() OVER (PARTITION BY base, geared ORDER BY d DESC) AS n, count(*) OVER (PARTITION BY base, geared) AS total FROM r WHERE rb IS NOT NULL),
    e AS (SELECT base, geared, x."window", (product(rb) - 1) * 100 AS br, (product(rg) - 1) * 100 AS gr, (product(1 + 3 * (rb - 1)) - 1) * 100 AS tr FROM k, (VALUES ('21', 21, 21), ('63', 63, 63), ('all', 1 << 30, 1)) x("window", len, least) WHERE n <= len AND total >= least GROUP BY ALL)
    SELECT base, geared, "window", round(br, 2) AS base_return, round(gr, 2) AS geared_return, round(tr, 2) AS theory_return, round(gr - tr, 2) AS drag FROM e""",
    "relative_strength": f"""WITH {BARS}, r AS (SELECT symbol, d, (close::DOUBLE / lag(close, 5) OVER w - 1) * 100 AS r5, (close::DOUBLE / lag(close, 21) OVER w - 1) * 100 AS r21, (close::DOUBLE / lag(close, 63) OVER w - 1) * 100 AS r63 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
    SELECT a.symbol, a.d, round(a.r5 - b.r5, 4) AS rs_5, round(a.r21 - b.r21, 4) AS rs_21, round(a.r63 - b.r63, 4) AS rs_63 FROM r a JOIN r b ON a.d = b.d AND b.symbol = 'Brand#11' WHERE a.symbol <> 'Brand#11'""",
    "returns_heatmap": f"WITH {BARS} SELECT symbol, d, round((close::DOUBLE / lag(close, 1) OVER w - 1) * 100, 4) AS r_1, round((close::DOUBLE / lag(close, 5) OVER w - 1) * 100, 4) AS r_5, round((close::DOUBLE / lag(close, 21) OVER w - 1) * 100, 4) AS r_21, round((close::DOUBLE / lag(close, 63) OVER w - 1) * 100, 4) AS r_63 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)",
    "group_spread": f"WITH {BARS}, r AS (SELECT symbol, d, (close::DOUBLE / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1) * 100 AS r FROM bars) SELECT d, round(coalesce(sum(r) FILTER (symbol IN ('Brand#12', 'Brand#13', 'Brand#21')), 0) / 3 - coalesce(max(r) FILTER (symbol = 'Brand#11'), 0), 4) AS spread FROM r GROUP BY d",
    "momentum": f"WITH {BARS}, m AS (SELECT symbol, d, (close::DOUBLE / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1) * 100 AS a, (close::DOUBLE / open - 1) * 100 AS b FROM bars) SELECT symbol, d, round(a, 4) AS close_to_close, round(b, 4) AS open_to_close, round(a - b, 4) AS gap FROM m",
    "prior_low": f"WITH {BARS}, m AS (SELECT symbol, d, close, min(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_low FROM bars) SELECT symbol, d, prior_low, close < prior_low AS broken FROM m",
}

_BREADTH = f"""{BARS}, m AS (SELECT d, volume, close - lag(close) OVER w AS mv, close > avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS above FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
b AS (SELECT d, count(*) FILTER (mv > 0) AS advances, count(*) FILTER (mv < 0) AS declines, coalesce(sum(volume) FILTER (mv > 0), 0)::BIGINT AS up_volume, coalesce(sum(volume) FILTER (mv < 0), 0)::BIGINT AS down_volume, round(count(*) FILTER (above)::DOUBLE / count(*) * 100, 4) AS above_20 FROM m GROUP BY d)"""
ORACLE_SQL |= {
    "breadth_trin": f"WITH {_BREADTH} SELECT *, round(coalesce((advances::DOUBLE / nullif(declines, 0)) / nullif(up_volume::DOUBLE / nullif(down_volume, 0), 0), 0), 4) AS trin FROM b",
    "breadth_thrust": f"WITH {_BREADTH} SELECT d, CASE WHEN above_20 >= 90 AND min(above_20) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) <= 10 THEN 'thrust' WHEN above_20 <= 10 THEN 'washout' ELSE 'none' END AS signal FROM b",
    "gamma_curve": f"WITH {CURVE} SELECT ticker, bucket, i, round(level, 6) AS level, round(exposure, 4) AS exposure FROM curve",
    "gamma_buckets": f"""WITH {CHAIN}, v AS (SELECT *, {_gamma("spot")} AS v FROM held) SELECT ticker, bucket, round(sum(v), 4) AS net_gamma_m, count(*) AS contract_count, count(DISTINCT dte) AS expiration_count, array_to_string(list_sort(list(DISTINCT dte)), ',') AS expirations FROM v GROUP BY ALL
    UNION ALL SELECT ticker, 'ALL', round(sum(v), 4), count(*), count(DISTINCT dte), array_to_string(list_sort(list(DISTINCT dte)), ',') FROM v GROUP BY ticker""",
    "gamma_flip": f"""WITH {CURVE}, n AS (SELECT *, lead(exposure) OVER w AS y1, lead(level) OVER w AS x1, max(abs(exposure)) OVER (PARTITION BY ticker, bucket) AS scale FROM curve WINDOW w AS (PARTITION BY ticker, bucket ORDER BY i)),
    z AS (SELECT ticker, bucket, round(CASE WHEN abs(exposure) <= greatest(1e-12, scale * 1e-9) THEN level WHEN exposure * y1 < 0 THEN level - exposure * (x1 - level) / (y1 - exposure) END, 4) AS zero FROM n WHERE scale >= 1e-12)
    SELECT ticker, bucket, round(arg_min(zero, [abs(zero - spot), zero]), 3) AS flip FROM z JOIN spots USING (ticker) WHERE zero IS NOT NULL GROUP BY ticker, bucket""",
    "gamma_walls": f"""WITH {CHAIN}, v AS (SELECT *, {_gamma("spot")} AS v FROM held), s AS (SELECT ticker, cp, strike, round(sum(abs(v)), 9) AS w FROM v WHERE bucket IN ('0DTE', '1-7D') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY ticker, cp ORDER BY w DESC, strike) AS k FROM s), t AS (SELECT ticker, max(strike) FILTER (cp = 'C') AS c, max(strike) FILTER (cp = 'P') AS p FROM r WHERE k = 1 GROUP BY ticker), a AS (SELECT ticker, sum(v) AS net FROM v GROUP BY ticker)
    SELECT ticker, c AS call_wall, p AS put_wall, CASE WHEN c = p THEN c END AS pin_strike, CASE WHEN c = p THEN CASE WHEN net >= 0 THEN 'PIN_CANDIDATE' ELSE 'BREAKOUT_PIVOT' END END AS pin_state FROM t LEFT JOIN a USING (ticker)""",
    "max_oi": f"WITH {CHAIN}, r AS (SELECT c.*, spot, row_number() OVER (PARTITION BY ticker ORDER BY oi DESC, dte, strike, cp) AS k FROM chain c JOIN spots USING (ticker) WHERE oi > 0) SELECT ticker, dte, strike, cp, oi, round((spot - strike) / spot * 100, 4) AS distance_pct FROM r WHERE k = 1",
    "pcr": f"WITH {CHAIN} SELECT ticker, round(coalesce(sum(oi) FILTER (cp = 'P'), 0)::DOUBLE / nullif(sum(oi) FILTER (cp = 'C'), 0), 4) AS oi_pcr FROM chain GROUP BY ticker",
    "expected_move": f"""WITH {CHAIN}, e AS (SELECT c.*, spot FROM chain c JOIN spots USING (ticker)), f AS (SELECT e.* FROM e JOIN (SELECT ticker, min(dte) AS dte FROM e GROUP BY 1) m USING (ticker, dte)),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY abs(strike - spot), strike) AS r FROM f)
    SELECT ticker, any_value(strike) AS atm_strike, round(CASE WHEN any_value(dte) > 0 THEN any_value(spot) * median(iv) * sqrt(any_value(dte) / 365.0::DOUBLE) END, 4) AS value, round(CASE WHEN any_value(dte) > 0 THEN median(iv) * sqrt(any_value(dte) / 365.0::DOUBLE) * 100 END, 4) AS pct, CASE WHEN any_value(dte) > 0 THEN 'ATM_IV_FALLBACK' ELSE 'MISSING' END AS source FROM k WHERE r = 1 GROUP BY ticker""",
    "vanna_charm": f"""WITH {CHAIN}, q AS (SELECT *, {D1} AS d1, iv * sqrt(years) AS root FROM held), p AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f, d1 - root AS d2 FROM q)
    SELECT ticker, round(sum(-f * d2 / iv * oi), 2) AS vanna, round(sum(-f * (0.053::DOUBLE / root - d2 / (2 * years)) * oi), 2) AS charm FROM p GROUP BY ticker""",
    "nearest_strikes": f"""WITH {CHAIN}, s AS (SELECT ticker, strike, any_value(spot) AS spot, row_number() OVER (PARTITION BY ticker ORDER BY strike) AS k FROM (SELECT DISTINCT ticker, strike FROM chain) JOIN spots USING (ticker) GROUP BY ticker, strike),
    c AS (SELECT ticker, arg_min(k, [abs(strike - spot), strike]) AS mid FROM s GROUP BY ticker) SELECT ticker, strike, (k - mid)::INTEGER AS place FROM s JOIN c USING (ticker) WHERE abs(k - mid) <= 15""",
    "expiration_sample": f"""WITH {CHAIN}, e AS (SELECT DISTINCT ticker, bucket, dte FROM held), r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker, bucket) AS n FROM e WINDOW w AS (PARTITION BY ticker, bucket ORDER BY dte))
    SELECT ticker, bucket, dte FROM r WHERE i = 0 OR (bucket = '8-30D' AND i = n - 1)""",
    "top5_unusual": f"""WITH {CHAIN}, t AS (SELECT ticker, dte, strike, cp, oi * 10 AS oi, oi * 10 * (strike::INT % 7) AS volume FROM chain), r AS (SELECT *, volume::DOUBLE / oi AS ratio FROM t WHERE oi > 100 AND volume > 500 AND volume >= 3 * oi),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ratio DESC, dte, strike, cp) AS place FROM r) SELECT ticker, dte, strike, cp, round(ratio, 4) AS ratio, place::INTEGER AS place FROM k WHERE place <= 5""",
    "bs_price": f"""WITH {CHAIN}, q AS (SELECT *, {D1} AS d1, strike * exp(-0.053::DOUBLE * years) AS pv FROM held), p AS (SELECT *, d1 - iv * sqrt(years) AS d2, -d1 AS m1, -(d1 - iv * sqrt(years)) AS m2 FROM q),
    v AS (SELECT ticker, cp, CASE cp WHEN 'C' THEN spot * {_cdf("d1")} - pv * {_cdf("d2")} ELSE pv * {_cdf("m2")} - spot * {_cdf("m1")} END AS v FROM p) SELECT ticker, cp, round(sum(v), 3) AS premium, round(max(v), 3) AS most FROM v GROUP BY ALL""",
    "delta_skew": f"""WITH {CHAIN}, q AS (SELECT *, {D1} AS d1 FROM held), g AS (SELECT *, round(abs(abs(CASE cp WHEN 'C' THEN {_cdf("d1")} ELSE {_cdf("d1")} - 1 END) - 0.25::DOUBLE), 6) AS gap FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, cp ORDER BY gap, dte, strike) AS k FROM g)
    SELECT ticker, round(max(iv) FILTER (cp = 'C'), 4) AS call_iv, round(max(iv) FILTER (cp = 'P'), 4) AS put_iv, round(max(iv) FILTER (cp = 'P') - max(iv) FILTER (cp = 'C'), 4) AS skew FROM r WHERE k = 1 GROUP BY ticker""",
    "macro_score": f"""WITH {MACRO} SELECT d, least(100, (CASE WHEN credit_z - 1 > 2 THEN 15 WHEN credit_z - 1 > 1 THEN 5 ELSE 0 END) + (CASE WHEN move - 95 > 15 THEN 15 WHEN move - 95 > 10 THEN 10 ELSE 0 END)
      + (CASE WHEN vix_contango_pct - 4 < 0 THEN CASE WHEN trin - 1 > 0.2 THEN 15 WHEN trin - 1 > 0 THEN 5 ELSE 0 END ELSE 0 END) + (CASE WHEN pct_200ma - 45 < -5 THEN 15 WHEN pct_200ma - 45 < -2 THEN 8 ELSE 0 END)
      + (CASE WHEN vix - 19 < 0 THEN 10 WHEN vix - 19 < 2 THEN 5 ELSE 0 END) + (CASE WHEN trin > 1 THEN 10 WHEN trin > 0.5 THEN 5 ELSE 0 END) + (CASE WHEN credit_z > 2 THEN 10 WHEN credit_z > 1 THEN 5 ELSE 0 END)
      + (CASE WHEN 2 - trin * 2 < -2 THEN 10 WHEN 2 - trin * 2 < -1 THEN 5 ELSE 0 END))::INTEGER AS macro_score FROM wide""",
    "micro_score": f"""WITH {MACRO}, b AS (SELECT *, vix_contango_pct - 4 < 0 AS falling, CASE WHEN vix >= 35 THEN 60 WHEN vix >= 25 THEN 40 + (vix - 25) / 10 * 20 WHEN vix >= 18 THEN 20 + (vix - 18) / 7 * 20 WHEN vix >= 12 THEN (vix - 12) / 6 * 20 ELSE 0 END AS base FROM wide)
    SELECT d, greatest(0, least(100, trunc(base + (CASE WHEN move >= 120 THEN 15 WHEN move >= 100 THEN 10 ELSE 0 END) + (CASE WHEN credit_z > 5 THEN 15 ELSE 0 END) + (CASE WHEN trin > 1.5 AND falling THEN 15 WHEN trin > 1.2 THEN 10 WHEN trin < 0.7 AND falling THEN -10 ELSE 0 END)
      + (CASE WHEN pct_200ma / 40 > 1 THEN 10 ELSE 0 END) + (CASE WHEN vix_contango_pct / 20 < -0.05 THEN 10 ELSE 0 END))))::INTEGER AS micro_score FROM b""",
    "regime_label": f"""WITH {MACRO}, r AS (SELECT d, vix_contango_pct AS y, move - 20 AS o, vix AS g, pct_200ma + 40 AS h, pct_200ma AS b FROM wide)
    SELECT d, CASE WHEN y > 4.3 AND o > 80 AND g > 20 THEN 'reflation' WHEN y < 3.8 AND h < 75 AND o < 70 THEN 'hard landing' WHEN y < 4.2 AND h > 77 AND o < 75 THEN 'goldilocks' WHEN y > 4.5 AND g < 18 AND o > 85 THEN 'stagflation' ELSE 'transition' END AS regime,
      CASE WHEN b > 60 THEN 'bull' WHEN b < 40 THEN 'bear' ELSE 'range' END AS skeleton FROM r""",
    "vol_probe": f"""WITH {MACRO}, r AS (SELECT d, vix_contango_pct AS c, trin AS g, credit_z - 3 AS k FROM wide)
    SELECT d, (CASE WHEN c < 0 THEN 2 WHEN c < 3 THEN 1 ELSE 0 END + CASE WHEN g > 1.5 THEN 1 ELSE 0 END)::INTEGER AS level,
      concat_ws('; ', CASE WHEN c < 0 THEN 'curve inverted' WHEN c < 3 THEN 'curve flat' END, CASE WHEN g > 1.5 THEN 'narrow breadth' END, CASE WHEN k < -2 THEN 'leverage drag' END) AS findings FROM r""",
    "third_friday": """WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), f AS (SELECT d, (date_trunc('month', d)::DATE + ((12 - isodow(date_trunc('month', d)))::INT % 7) + 14)::DATE AS a, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS m FROM o)
    SELECT d, CASE WHEN a >= d THEN a ELSE (m + ((12 - isodow(m))::INT % 7) + 14)::DATE END AS expiry FROM f""",
    "stream_tick_mean": "WITH e AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * k AS start, value FROM events, range(15) t(k)) SELECT start::TIMESTAMP AS start, round(avg(value), 9) AS mean_value, count(*) AS n FROM e GROUP BY ALL",
    "stream_vwap": "SELECT ts::DATE AS day, event_type, round(sum(value * (user_id % 100 + 1)) / sum(user_id % 100 + 1), 4) AS vwap FROM events GROUP BY ALL",
    "stream_alert_dedupe": "SELECT DISTINCT ts::DATE AS day, event_type FROM events",
}

_ROC = ", ".join(f"round(value / nullif(lag(value, {k}) OVER w, 0) * 100 - 100, 4) AS roc_{k}" for k in (20, 21, 62, 251))
ORACLE_SQL |= {
    "sma20": f"WITH {BARS} SELECT symbol, d, round(avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS sma FROM bars",
    "sign_flips": f"WITH {FACTS} SELECT scope, metric, d, coalesce(sign(value - 4) * sign(lag(value - 4) OVER w) < 0, false) AS day, coalesce(sign(value - 4) * sign(lag(value - 4, 5) OVER w) < 0, false) AS week FROM facts WINDOW w AS (PARTITION BY scope, metric ORDER BY d)",
    "extreme_probe": f"WITH {STATS} SELECT scope, metric, d, round(z, 4) AS z FROM stats WHERE n > 30 AND abs(z) > 2",
    "latest_values": f"WITH {FACTS} SELECT scope, metric, arg_max(value, d) AS value, max(d) AS d FROM facts GROUP BY ALL",
    "weighted_flow": f"WITH {BARS}, f AS (SELECT d, (volume - lag(volume) OVER (PARTITION BY symbol ORDER BY d)) * close AS x FROM bars) SELECT d, round(sum(x)::DOUBLE / 1000000, 6) AS flow FROM f GROUP BY d",
    "score_matrix": f"WITH {STATS} SELECT d, metric, count(*) AS scopes, max(greatest(abs_sev, z_sev))::INTEGER AS worst, round(avg(pct), 4) AS mean_pct FROM graded GROUP BY ALL",
    "alert_bodies": f"""WITH {STATS}, l AS (SELECT d, severity, '[' || severity || '] ' || concat_ws(' ', metric, scope, window_scope) AS line FROM alerts)
      SELECT d, count(*) || ' alerts, severity ' || max(severity) AS subject, string_agg(line, chr(10) ORDER BY severity DESC, line) AS body FROM l GROUP BY d""",
}
ORACLE_SQL |= {
    "weekday_lag": f"WITH {ALIGNED} SELECT scope, metric, x.d, (b.upto - a.upto)::INTEGER AS lag_days FROM aligned x LEFT JOIN counted a ON a.d = x.source_date - 1 LEFT JOIN counted b ON b.d = x.d - 1",
    "session_lag": f"""WITH {ALIGNED}, {SESSIONS}
    SELECT scope, metric, x.d, greatest(0, b.upto - a.upto - 1)::INTEGER AS lag_days FROM aligned x JOIN ordinals a ON a.d = x.source_date - 1 JOIN ordinals b ON b.d = x.d""",
    "five_day_change": f"""WITH {FACTS}, {SPINE}, cal AS (SELECT d, row_number() OVER (ORDER BY d) AS seq FROM weekdays), v AS (SELECT scope, metric, d, value FROM facts WHERE isodow(d) < 6),
    m AS (SELECT v.scope, v.metric, v.d, v.value, b.d AS past FROM v JOIN cal c ON c.d = v.d LEFT JOIN cal b ON b.seq = c.seq - 5)
    SELECT m.scope, m.metric, m.d, round(m.value - p.value, 4) AS change FROM m ASOF LEFT JOIN v p ON p.scope = m.scope AND p.metric = m.metric AND p.d <= m.past""",
    "rolling_z_or_zero": f"""WITH {FACTS}, r AS (SELECT scope, metric, d, value, count(*) OVER f AS n, count(*) OVER (PARTITION BY scope, metric) AS total, avg(value) OVER f AS mean, stddev_samp(value) OVER f AS dev FROM facts
      WINDOW f AS (PARTITION BY scope, metric ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT scope, metric, d, round(CASE WHEN n >= greatest(30, least(252, total) // 2) AND dev > 0 THEN (value - mean) / dev ELSE 0 END, 4) AS z FROM r""",
    "rate_of_change": f"WITH {FACTS} SELECT scope, metric, d, {_ROC} FROM facts WINDOW w AS (PARTITION BY scope, metric ORDER BY d)",
    "monthly_yoy": f"""WITH {FACTS}, m AS (SELECT scope, metric, date_trunc('month', d)::DATE AS d, sum(round(value * 10000)::BIGINT)::BIGINT AS value FROM facts GROUP BY ALL)
      SELECT scope, metric, d, round(value / nullif(lag(value, 12) OVER (PARTITION BY scope, metric ORDER BY d), 0) * 100 - 100, 4) AS yoy FROM m""",
}
_LIQUIDITY_STATE = ORACLE_SQL["liquidity_state"]
ORACLE_SQL["liquidity_trend"] = f"""WITH st AS ({_LIQUIDITY_STATE}), r AS (SELECT d, composite, state, composite - lag(composite, 5) OVER (ORDER BY d) AS change_5, row_number() OVER (ORDER BY d DESC) AS back FROM st)
  SELECT d, composite, state, round(change_5, 4) AS change_5 FROM r WHERE back <= 126"""

#: The date columns of the results, given as ISO text like those of the queries.
UNDATED = {
    "poc_profile", "poc_profile_prices", "vwap_session", "ivr", "leverage_drag", "gamma_curve", "gamma_buckets", "gamma_flip", "gamma_walls", "max_oi", "pcr", "expected_move", "vanna_charm",
    "nearest_strikes", "expiration_sample", "top5_unusual", "bs_price", "delta_skew", "stream_tick_mean",
}
DATED = {"asof_align": ["d", "source_date"], "third_friday": ["d", "expiry"], "stream_vwap": ["day"], "stream_alert_dedupe": ["day"]}


def text_dates(sql: str, dates: list[str]) -> str:
    sql = re.sub(r"(SELECT |, )round\(", r"\g<1>0 + round(", sql)  # DuckDB may round to -0.0, Spark to 0.0
    return f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in dates)}) FROM ({sql})" if dates else sql


ORACLE_SQL = {name: text_dates(sql, [] if name in UNDATED else DATED.get(name, ["d"])) for name, sql in ORACLE_SQL.items()}
