"""DuckDB SQL for the queries of ``session_queries``: holidays by another Easter formula, native snapshots as-of joined to every session."""

from __future__ import annotations

from .market_oracles import _BAD, ORACLE_SQL, RAW
from .oracles import BARS, ENVIRONMENT, FACTS, MACRO, SESSIONS, SPINE, STATS, text_dates
from .plans import specs

__all__ = ["ORACLE_SQL"]

#: The facts and the weekly and monthly series made of them.
MIXED = FACTS.replace("), facts AS (", "), plain AS (").rstrip().removesuffix(")") + """), facts AS (
  SELECT * FROM plain
  UNION ALL SELECT scope, 'nfci', max(d), arg_max(value, d) FROM plain WHERE metric = 'credit_z' GROUP BY scope, date_trunc('week', d)
  UNION ALL SELECT scope, 'dxy', max(d), arg_max(value, d) FROM plain WHERE metric = 'move' GROUP BY scope, date_trunc('month', d)
)"""

REPLAYED = STATS.replace(FACTS, MIXED) + f""", {SPINE}, {SESSIONS}, marked AS (
  SELECT s.scope, s.metric, s.d, e.op, e.bound, CASE e.op WHEN '<' THEN value < bound WHEN '>' THEN value > bound ELSE value >= bound END AS hit FROM stats s LEFT JOIN entry e USING (metric)
), islands AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY scope, metric ORDER BY d) AS island FROM marked
), risk AS (SELECT scope, metric, d, op, bound, CASE WHEN op IS NOT NULL THEN (sum(hit::INT) OVER (PARTITION BY scope, metric, island ORDER BY d))::INTEGER END AS days_in_risk FROM islands
), names AS (SELECT DISTINCT scope, metric FROM graded), shown AS (
  SELECT x.scope, x.metric, x.d AS report_date, g.d AS source_date, g.value, g.z, g.pct, g.n, greatest(g.abs_sev, g.z_sev)::INTEGER AS severity
  FROM (SELECT scope, metric, d FROM names, sessions) x ASOF JOIN graded g ON g.scope = x.scope AND g.metric = x.metric AND g.d <= x.d
), replayed AS (
  SELECT s.*, value - lag(value, 1) OVER w AS c1, value - lag(value, 5) OVER w AS c5, value - lag(value, 21) OVER w AS c21, value - lag(value, 63) OVER w AS c63, greatest(0, b.upto - a.upto - 1)::INTEGER AS lag_days
  FROM shown s JOIN ordinals a ON a.d = s.source_date - 1 JOIN ordinals b ON b.d = s.report_date WINDOW w AS (PARTITION BY scope, metric ORDER BY report_date)
)"""

_BACK = ", ".join(f"(SELECT x.d FROM sessions x WHERE x.seq = k.upto - {n})::VARCHAR AS back_{n}" for n in (1, 21))

SQL: dict[str, str] = {
    "exchange_calendar": f"WITH {SPINE}, {SESSIONS} SELECT d, seq::INTEGER AS seq, half_day FROM sessions",
    "session_neighbours": f"""WITH {SPINE}, {SESSIONS}, k AS (SELECT d, n, (SELECT count(*) FROM sessions s WHERE s.d <= h.d) AS upto FROM (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1) h)
      SELECT d, n, d IN (SELECT d FROM sessions) AS is_session, (SELECT max(d) FROM sessions s WHERE s.d < k.d)::VARCHAR AS previous, (SELECT min(d) FROM sessions s WHERE s.d > k.d)::VARCHAR AS next, {_BACK} FROM k""",
    "replayed_snapshots": f"""WITH {REPLAYED}
      SELECT r.scope, r.metric, report_date::VARCHAR AS report_date, round(value, 4) AS value, round(c1, 4) AS chg_1d, round(c5, 4) AS chg_5d, round(c21, 4) AS chg_21d, round(c63, 4) AS chg_63d, round(z, 3) AS zscore, round(pct, 1) AS percentile, severity,
        round(CASE WHEN k.op IN ('>', '>=') THEN bound - value ELSE value - bound END, 4)::DOUBLE AS dist_to_thr, k.days_in_risk, n::INTEGER AS sample_len, n::INTEGER AS effective_obs, source_date::VARCHAR AS source_date, source_date <> report_date AS is_filled, lag_days
      FROM replayed r JOIN risk k ON k.scope = r.scope AND k.metric = r.metric AND k.d = r.source_date""",
    "replayed_fill_rate": f"WITH {REPLAYED} SELECT scope, metric, count(*) AS sessions, count(*) FILTER (source_date <> report_date) AS filled, max(n)::INTEGER AS observations, max(lag_days) AS longest_lag FROM replayed GROUP BY ALL",
}
SQL["live_observations"] = """WITH o AS (SELECT o_orderdate::DATE AS d, count(*) AS n, round(max(o_totalprice))::DOUBLE AS most FROM orders GROUP BY 1)
  SELECT 'a' AS source, 'orders' AS field, d, n::DOUBLE AS value FROM o WHERE d >= DATE '1995-06-01' UNION ALL SELECT 'a', 'most', d, most FROM o WHERE d >= DATE '1995-06-01'
  UNION ALL SELECT 'b', 'orders', d, n / 2 FROM o WHERE d >= DATE '1995-06-01' AND dayofmonth(d) <> 5"""
SQL["live_health"] = "SELECT 'ships' AS source, 'ok' AS status, count(DISTINCT l_shipdate::DATE) AS rows, false AS told FROM lineitem UNION ALL SELECT 'gone', 'failed', 0, true"
SQL["event_matrix"] = f"""WITH {STATS}, told AS (
    SELECT d, scope, metric, '1D' AS win, 'single' AS layer, abs_sev AS sev, round(greatest(0.5, least(1.0, n / 252.0)), 3)::DOUBLE AS conf, '' AS theme, metric || ' beyond its bound: ' || printf('%.2f', value) AS text FROM graded WHERE abs_sev > 0
    UNION ALL SELECT d, scope, metric, '252D', 'single', z_sev, round(least(1.0, n / 252.0), 3)::DOUBLE, '', metric || ' off its 252-day baseline by ' || printf('%+.2f', z) || ' deviations (percentile ' || printf('%.0f', pct) || ')' FROM graded WHERE z_sev > 0
    UNION ALL SELECT d, scope, metric, '1D+5D+21D', 'multiwindow', 3, round(least(1.0, n / 252.0), 3)::DOUBLE, '', metric || ' confirmed over windows: ' || printf('%+.2f', c1) || ' in a day, ' || printf('%+.2f', c5) || ' in five, percentile ' || printf('%.0f', pct)
      FROM graded WHERE bad <> 0 AND c1 * bad > 0 AND c5 * bad > 0 AND ((bad > 0 AND pct >= 90) OR (bad < 0 AND pct <= 10))
    UNION ALL SELECT d, 'MACRO', 'RESONANCE', 'multi', 'resonance', least(3, base + hits - need), round(least(1.0, 0.5 + 0.12 * hits), 3)::DOUBLE, theme, theme || ': ' || hits || '/' || (SELECT count(*) FROM themes x WHERE x.theme = h.theme) || ' conditions [' || reasons || ']' FROM (
      SELECT d, theme, any_value(need) AS need, any_value(base) AS base, count(*) AS hits, string_agg(input, ', ' ORDER BY input) AS reasons FROM inputs JOIN themes USING (input) WHERE (op = '<' AND value < bound) OR (op = '>' AND value > bound) GROUP BY d, theme) h WHERE hits >= need
  ), lined AS (
    SELECT *, CASE WHEN sev >= 3 THEN '🔴' WHEN sev = 2 THEN '🟠' ELSE '🟡' END || ' [' || layer || '|' || win || '] ' || CASE WHEN scope = 'MACRO' THEN '' ELSE '[' || scope || '] ' END || text || ' (severity ' || sev || '/3, confidence ' || floor(conf * 100)::INT || '%)' AS line FROM told
  ), texts AS (SELECT d, count(*) AS events, string_agg(line, chr(10) ORDER BY sev DESC, conf DESC, layer, scope, metric, win, theme) AS text FROM lined GROUP BY d)
  SELECT d, coalesce(events, 0) AS events, coalesce(text, 'no notable anomaly') AS text FROM (SELECT DISTINCT d FROM facts) LEFT JOIN texts USING (d)"""
_PANELS = ", ".join(f"""max(score) FILTER ("index" = '{i}') AS {i}""" for i in sorted({i for i, *_ in specs.ENVIRONMENT}))
SQL["environment_panels"] = f"""WITH {ENVIRONMENT}, p AS (SELECT d, {_PANELS}, round(sum(score * coverage) FILTER (coverage >= {specs.MIN_INDEX_COVERAGE}) / sum(coverage) FILTER (coverage >= {specs.MIN_INDEX_COVERAGE}), 1) AS composite FROM scores GROUP BY d) SELECT * FROM p"""
SQL["document_fields"] = """SELECT event_type, key AS field, 'number' AS kind, count(*) AS n, min(v::DOUBLE) AS low, max(v::DOUBLE) AS high
  FROM (SELECT event_type, unnest(json_keys(props::JSON)) AS key, props FROM events), LATERAL (SELECT props::JSON ->> key AS v) GROUP BY ALL"""
SQL["document_metrics"] = f"""WITH {MACRO}, k AS (SELECT *, dayofmonth(d) AS day, dayofmonth(d) NOT IN (9, 10) AS has FROM wide)
  SELECT d, round(coalesce(CASE WHEN has AND day % 2 = 0 THEN move END, CASE WHEN day < 20 THEN move END), 4) AS move, round(trin, 4) AS own, round(CASE WHEN has THEN vix END, 4) AS vix, round(CASE WHEN has THEN credit_z END, 4) AS credit_z, NULL::DOUBLE AS trin, NULL::DOUBLE AS pct_200ma, NULL::DOUBLE AS gone,
    CASE WHEN has THEN d - 1 END::VARCHAR AS vix_source_date, CASE WHEN has AND day % 3 > 0 THEN d - 7 END::VARCHAR AS move_source_date, NULL::VARCHAR AS trin_source_date, CASE WHEN has THEN CASE WHEN day % 3 > 0 THEN d - 7 ELSE d - 1 END END::VARCHAR AS credit_z_source_date FROM k"""
SQL["ticker_appendix"] = f"""WITH {BARS}, r AS (SELECT symbol, d, close / 100.0::DOUBLE AS price, (high + low) / 200.0::DOUBLE AS poc, volume % 70 AS k, volume % 40 AS ivr, volume % 7 - 3 AS charm, CASE WHEN volume % 11 > 0 THEN open // 1000 * 10 END AS flip FROM bars)
  SELECT symbol AS ticker, d, '[' || symbol || ']: ' || concat_ws(' | ', 'reference $' || printf('%.2f', CASE WHEN k % 2 = 0 THEN price + 1 ELSE price END) || ' (' || CASE WHEN k % 4 = 0 THEN 'mid' ELSE 'price' END || ')', CASE WHEN k % 3 > 0 THEN 'previous close $' || printf('%.2f', price - 1) END,
    'cost core $' || printf('%.2f', poc), CASE WHEN k <> 0 THEN 'short volume ' || k || '%' END, CASE WHEN ivr <> 0 THEN 'volatility rank ' || ivr || '%' END, CASE WHEN flip <> 0 THEN 'gamma flip $' || printf('%.2f', flip::DOUBLE) END, CASE WHEN charm <> 0 THEN 'charm ' || charm || 'M' END) AS text FROM r"""
SQL["quality_ledger"] = f"""WITH {RAW}, c AS (SELECT count(*) AS n, count(*) FILTER (text IS NULL OR lower(trim(text)) IN {_BAD}) AS t, count(*) FILTER (size IS NULL OR lower(trim(size)) IN {_BAD}) AS s, count(*) FILTER (price IS NULL) AS p FROM raw)
  SELECT job, '2024-01-02' AS report_date, n * k AS rows, t * k AS no_text, s * k AS no_size, p * k AS no_price, CASE WHEN k = 0 THEN 'empty' WHEN job = 'raw' AND t + s + p > 0 THEN 'degraded' ELSE 'ok' END AS status, true AS recorded FROM c, (VALUES ('raw', 1), ('allowed', 1), ('none', 0)) j(job, k)"""
SQL["stream_intraday_scan"] = """WITH q AS (SELECT event_type AS market, ts, value, user_id % 100 + 1 AS v, event_id % 4 AS k, CASE event_id % 4 WHEN 0 THEN value * 20 - 800 WHEN 1 THEN value / 20 ELSE value END AS size FROM events
  ), view AS (SELECT event_type AS market, ts::DATE AS d, max(value) / 2 AS prev_close, (count(*) % 10) / 20 + 0.4::DOUBLE AS expected_move, max(value) / 3 AS flip FROM events GROUP BY ALL
  ), bars AS (SELECT market, time_bucket(INTERVAL 5 MINUTE, ts) AS s, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS ts, arg_max(value, ts) AS p, sum(v) AS v FROM q WHERE value <> 0 GROUP BY ALL
  ), prices AS (SELECT a.market, a.ts, (SELECT arg_max(b.p, b.s) FROM bars b WHERE b.market = a.market AND b.ts = a.ts) AS price, sum(b.p * b.v) / sum(b.v) AS vwap
    FROM (SELECT DISTINCT market, ts FROM bars) a JOIN bars b ON b.market = a.market AND b.ts <= a.ts AND b.s::DATE = (a.ts - INTERVAL 1 MINUTE)::DATE GROUP BY ALL
  ), minutes AS (SELECT market, k, time_bucket(INTERVAL 1 MINUTE, ts) AS s, arg_max(size, ts) AS size FROM q WHERE size <> 0 GROUP BY ALL
  ), readings AS (SELECT market, time_bucket(INTERVAL 15 MINUTE, s) + INTERVAL 15 MINUTE AS ts, avg(size) FILTER (k = 0) AS ctick, arg_max(size, s) FILTER (k = 1) AS trin, coalesce(arg_max(size, s) FILTER (k = 2), 0) AS up, coalesce(arg_max(size, s) FILTER (k = 3), 0) AS down FROM minutes GROUP BY ALL
  ), r AS (SELECT p.market, p.ts, price, prev_close, expected_move, coalesce(trin, 0) AS trin, CASE WHEN down > 0 THEN up / down WHEN up > 0 THEN 99.0 ELSE 1.0 END AS ratio, coalesce(ctick, 0) AS ctick, flip, vwap
    FROM prices p LEFT JOIN readings USING (market, ts) JOIN view ON view.market = p.market AND d = (p.ts - INTERVAL 1 MINUTE)::DATE)
  SELECT market, ts, round(price, 9) AS price, round(prev_close, 9) AS prev_close, round(expected_move, 9) AS expected_move, round(trin, 9) AS trin, round(ratio, 9)::DOUBLE AS ratio, round(ctick, 9) AS ctick, round(flip, 9) AS flip, round(vwap, 9) AS vwap,
    CASE WHEN price <= (CASE WHEN prev_close > 0 THEN prev_close * (1 - expected_move) ELSE price * 0.98 END) * 1.002 AND trin >= 1.5 THEN CASE WHEN ratio >= 2 AND ctick > 0 THEN 'capitulation bid' END
      WHEN flip > 0 AND price < flip AND price < vwap THEN CASE WHEN ratio <= 0.25 AND ctick < -300 THEN 'gamma slide' END
      WHEN ratio >= 4 AND price > vwap THEN 'up-volume surge' WHEN ratio <= 0.20 AND price < vwap THEN 'down-volume surge' END AS alert FROM r"""
_TICKS = "ticks AS (SELECT event_type, ts, event_id, round(value * 100)::BIGINT AS close, user_id % 100 + 1 AS volume FROM events)"
SQL["segmented_run_length"] = f"""WITH {_TICKS}, m AS (SELECT *, count(*) FILTER (close >= 4000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS misses FROM ticks)
  SELECT event_id, count(*) FILTER (close < 4000) OVER (PARTITION BY event_type, misses ORDER BY ts, event_id) AS run FROM m"""
SQL["segmented_obv"] = f"""WITH {_TICKS}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 0) * volume AS step FROM ticks)
  SELECT event_id, (sum(step) OVER (PARTITION BY event_type ORDER BY ts, event_id))::BIGINT AS obv FROM s"""
SQL["segmented_asof"] = f"""WITH {_TICKS}, o AS (SELECT event_type, ts, max(close) AS close FROM ticks WHERE close > 10000 GROUP BY ALL)
  SELECT t.event_id, o.close, epoch_us(t.ts) - epoch_us(o.ts) AS age FROM ticks t ASOF LEFT JOIN o ON o.event_type = t.event_type AND o.ts <= t.ts"""
SQL["unified_options"] = f"""WITH {BARS}, pre AS (SELECT symbol AS ticker, d, open / 100.0::DOUBLE AS pre_price, high / 100.0::DOUBLE AS call_wall, low / 100.0::DOUBLE AS put_wall FROM bars WHERE volume % 3 > 0
  ), post AS (SELECT symbol AS ticker, d, close / 100.0::DOUBLE AS close_price, (high + low) / 200.0::DOUBLE AS poc_price, volume % 40 AS ivr_pct FROM bars WHERE volume % 4 > 0)
  SELECT d, ticker, close_price, poc_price, ivr_pct, pre_price, call_wall, put_wall FROM pre FULL JOIN post USING (ticker, d)"""
SQL["stream_log_tail"] = ORACLE_SQL["todays_log"]
ORACLE_SQL |= {name: text_dates(sql, {"exchange_calendar": ["d"], "session_neighbours": ["d"], "live_observations": ["d"], "event_matrix": ["d"], "ticker_appendix": ["d"], "document_metrics": ["d"], "environment_panels": ["d"], "unified_options": ["d"]}.get(name, [])) for name, sql in SQL.items()}
