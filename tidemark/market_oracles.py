"""DuckDB SQL for the queries of ``market_queries``, written from the operators' definitions."""

from __future__ import annotations

from .oracles import ALIGNED, BARS, CHAIN, CURVE, D1, DAILY, ENVIRONMENT, FACTS, LIQUIDITY, MACRO, ORACLE_SQL, SPINE, STATS, text_dates
from .plans import specs

__all__ = ["ORACLE_SQL"]

TODAY = "DATE '1998-06-30'"
_BAD = "('', '-', '.', 'null', 'none', 'nan', 'n/a')"

QUOTES = """quotes AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice - 1 END AS bid, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice + p_partkey % 4 - 2 END AS ask, CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_retailprice END END AS "last",
    CASE WHEN p_partkey % 2 > 0 THEN p_retailprice - 3 END AS prev_close, CASE WHEN p_partkey % 4 = 1 THEN p_retailprice + 2 END AS market, CASE WHEN p_partkey % 9 = 1 THEN p_retailprice + 5 END AS "close", CASE WHEN p_partkey % 13 = 1 THEN p_retailprice + 7 END AS latest_bar, p_partkey % 6 AS code FROM part
)"""

RAW = """raw AS (
  SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '-' WHEN 1 THEN 'n/a' WHEN 2 THEN 'abc' WHEN 3 THEN 'NaN' WHEN 4 THEN format('{:,}', p_partkey * 1000) WHEN 5 THEN ' ' || p_partkey || '.5 ' ELSE p_partkey::VARCHAR END AS text,
    (p_partkey % 90) || '.5' || ['K', 'M', 'b', ' T', '', 'X'][p_partkey % 6 + 1] AS size, (p_partkey % 30) || ['y', 'mo', 'MO', 'd', ''][p_partkey % 5 + 1] AS period, p_retailprice AS price FROM part
)"""

_OFFICIAL = {
    "fed_assets_b": ("2-HIGH", "move"), "tga_b": ("3-MEDIUM", "vix"), "rrp_b": ("5-LOW", "trin"), "iorb": ("2-HIGH", "trin"), "sofr_rate": ("3-MEDIUM", "trin"), "sofr_p75": ("4-NOT SPECIFIED", "trin"),
    "sofr_p99": ("4-NOT SPECIFIED", "credit_z"), "tgcr_rate": ("MACRO", "trin"), "effr_rate": ("MACRO", "credit_z"),
}
_PICKED = ", ".join(f"max(value) FILTER (scope = '{s}' AND metric = '{m}') AS {c}, max(source_date) FILTER (scope = '{s}' AND metric = '{m}') AS {c}_source_date" for c, (s, m) in _OFFICIAL.items())
OFFICIAL = ALIGNED + f", wide AS (SELECT d, {_PICKED} FROM aligned GROUP BY d)"


def _spread(name: str, over: str, under: str) -> str:
    return f"round(({over} - {under}) * 100, 4) AS {name}"


_SPREADS = {"sofr_iorb_bps": ("sofr_rate", "iorb"), "tgcr_iorb_bps": ("tgcr_rate", "iorb"), "effr_iorb_bps": ("effr_rate", "iorb"), "sofr_75_iorb_bps": ("sofr_p75", "iorb"), "sofr_dispersion_bps": ("sofr_p99", "sofr_rate")}


def _oldest(name: str, *of: str) -> str:
    return f"least({', '.join(f'{c}_source_date' for c in of)}) AS {name}_source_date"


SNAP = BARS + """, snap AS (
  SELECT symbol, d, close, volume, close - lag(close) OVER w AS change, row_number() OVER w AS n, avg(close) OVER a AS s20, avg(close) OVER b AS s50, avg(close) OVER c AS s200, max(high) OVER y AS hi, min(low) OVER y AS lo FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY d), a AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
    c AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), y AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)
)"""

_THRUST = """m AS (SELECT d, close > avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS above FROM bars), sh AS (SELECT d, round(count(*) FILTER (above)::DOUBLE / count(*) * 100, 4) AS s FROM m GROUP BY d),
th AS (SELECT d, CASE WHEN s >= 90 AND min(s) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) <= 10 THEN 'thrust' WHEN s <= 10 THEN 'washout' ELSE 'none' END AS thrust FROM sh)"""

CONTEXT = LIQUIDITY + """, cx AS (
  SELECT d, max(value) FILTER (col = 'reserves_t') AS reserves_t, max(value) FILTER (col = 'tga_b') AS tga_b, max(value) FILTER (col = 'sofr_iorb_bps') AS sofr_iorb_bps, max(value) FILTER (col = 'nfci') AS nfci, max(value) FILTER (col = 'move') AS move,
    max(value) FILTER (col = 'hy_spread') AS hy_spread FROM aligned JOIN mapped USING (scope, metric) GROUP BY d
), pw AS (
  SELECT d, max(score) FILTER (pillar = 'market_distribution') AS md, max(score) FILTER (pillar = 'funding_health') AS fh, max(score) FILTER (pillar = 'credit_transmission') AS ct, max(coverage) FILTER (pillar = 'funding_health') AS fc FROM pillars GROUP BY d
), tg AS (SELECT d, value - lag(value, 5) OVER (ORDER BY d) AS tga_5d FROM aligned WHERE scope = '3-MEDIUM' AND metric = 'vix'
), noted AS (
  SELECT d, concat_ws('; ', CASE WHEN reserves_t < 2.85 THEN 'reserves in the sensitive range' END, CASE WHEN tga_5d >= 100 THEN 'treasury account up by 100 billion in five days' END, CASE WHEN md < 45 THEN 'concentrated distribution' END,
    CASE WHEN fc < 0.60 THEN 'funding coverage thin' END, CASE WHEN fh < 30 AND NOT coalesce(sofr_iorb_bps >= 5 OR nfci >= 0.25 OR move >= 130, false) THEN 'funding weak but within absolute bounds' END,
    CASE WHEN ct < 25 AND NOT coalesce(hy_spread >= 5, false) THEN 'credit weak but within absolute bounds' END) AS warnings FROM pw LEFT JOIN cx USING (d) LEFT JOIN tg USING (d)
)"""

STORED = FACTS + """, st AS (SELECT date_trunc('year', d)::DATE AS d, d AS own, scope, metric, value, dayofyear(date_trunc('year', d)::DATE) AS y, strftime(d, '%m%d') AS md, dayofyear(d) % 5 = 0 AS is_final FROM facts)"""
_TEN = "sum(round(({0}) * 10000)::BIGINT)::BIGINT"

SQL: dict[str, str] = {
    "reference_price": f"""WITH {QUOTES}, m AS (SELECT p_partkey, CASE WHEN bid > 0 AND ask >= bid THEN (bid + ask) / 2 END AS mid, CASE WHEN "last" > 0 THEN "last" END AS l, CASE WHEN prev_close > 0 THEN prev_close END AS c FROM quotes)
      SELECT p_partkey, round(coalesce(mid, l, c), 4) AS price, CASE WHEN mid IS NOT NULL THEN 'mid' WHEN l IS NOT NULL THEN 'last' WHEN c IS NOT NULL THEN 'prev_close' ELSE 'missing' END AS price_source FROM m""",
    "feed_labels": f"WITH {QUOTES} SELECT p_partkey, CASE code WHEN 1 THEN 'live' WHEN 2 THEN 'frozen' WHEN 3 THEN 'delayed' WHEN 4 THEN 'delayed frozen' ELSE 'unknown' END AS feed FROM quotes",
    "price_cascades": f"""WITH {QUOTES} SELECT p_partkey, round(coalesce(market, "close", "last"), 4) AS quote, CASE WHEN market IS NOT NULL THEN 'market' WHEN "close" IS NOT NULL THEN 'close' WHEN "last" IS NOT NULL THEN 'last' ELSE 'missing' END AS quote_from,
      round(coalesce(nullif("last", 0), "close", bid, ask, market, latest_bar), 4) AS "index", CASE WHEN nullif("last", 0) IS NOT NULL THEN 'last' WHEN "close" IS NOT NULL THEN 'close' WHEN bid IS NOT NULL THEN 'bid' WHEN ask IS NOT NULL THEN 'ask' WHEN market IS NOT NULL THEN 'market' WHEN latest_bar IS NOT NULL THEN 'latest_bar' ELSE 'missing' END AS index_from FROM quotes""",
    "clean_numbers": f"""WITH {RAW}, t AS (SELECT *, replace(trim(text), ',', '') AS c, upper(trim(size)) AS u, lower(period) AS q FROM raw)
      SELECT p_partkey, CASE WHEN lower(c) NOT IN {_BAD} THEN TRY_CAST(c AS DOUBLE) END AS value,
        round(CASE WHEN regexp_full_match(u, '[0-9.]+\\s*[KMBT]?') THEN TRY_CAST(regexp_extract(u, '^[0-9.]+') AS DOUBLE) * CASE regexp_extract(u, '[KMBT]$') WHEN 'K' THEN 0.001::DOUBLE WHEN 'M' THEN 1 WHEN 'B' THEN 1000 WHEN 'T' THEN 1000000 ELSE 0.000001::DOUBLE END END, 6) AS millions,
        CASE WHEN regexp_full_match(q, '\\d+(y|mo)') THEN regexp_extract(q, '\\d+')::INTEGER * CASE WHEN ends_with(q, 'y') THEN 365 ELSE 30 END END AS days, CASE WHEN p_partkey % 3 - 1 > 0 THEN p_partkey % 3 - 1 END AS positive FROM t""",
    "missing_fields": f"""WITH {RAW}, t AS (SELECT p_partkey, lower(trim(text)) IN {_BAD} AS a, lower(trim(size)) IN {_BAD} AS b, p_partkey % 4 = 0 AS c FROM raw)
      SELECT p_partkey, concat_ws(',', CASE WHEN a THEN 'text' END, CASE WHEN b THEN 'size' END, CASE WHEN c THEN 'price' END) AS missing, CASE a::INT + b::INT + c::INT WHEN 0 THEN 'ok' WHEN 3 THEN 'failed' ELSE 'partial' END AS status FROM t""",
    "trading_days": f"WITH {FACTS} SELECT scope, metric, d, round(value + CASE WHEN dayofmonth(d) IN (7, 9) THEN 1 ELSE 0 END, 4) AS value, CASE WHEN dayofmonth(d) IN (7, 9) THEN 2 ELSE 1 END AS sent FROM facts WHERE dayofmonth(d) NOT IN (13, 14) AND isodow(d) < 6",
    "history_normalised": """WITH r AS (SELECT o_orderdate::DATE AS d, o_orderkey AS ordinal, round(o_totalprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 4 <> 2) SELECT d, ordinal, cents FROM r WHERE k = 1""",
    "new_york_times": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (date_trunc('second', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' WHEN 1 THEN ((date_trunc('second', ts) - INTERVAL 2 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE date_trunc('second', ts) END AS local FROM events""",
    "session_bars": """WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)
      SELECT t::DATE::VARCHAR AS day, CASE WHEN strftime(t, '%H:%M') < '09:30' THEN 'PRE' WHEN strftime(t, '%H:%M') < '16:00' THEN 'RTH' ELSE 'POST' END AS session, count(*) AS n, max(event_id) AS "last" FROM l GROUP BY ALL""",
    "bars_before_open": """WITH l AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events) SELECT event_id, t::DATE::VARCHAR AS day FROM l WHERE strftime(t, '%H:%M') < '09:30'""",
    "nearest_contracts": f"""WITH c AS (SELECT DISTINCT p_brand AS root, ({TODAY} + p_size - 12)::DATE AS expiry FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY expiry)::INTEGER AS place FROM c WHERE expiry > {TODAY}) SELECT root, expiry::VARCHAR AS expiry, place FROM r WHERE place <= 2""",
    "front_contract": f"""WITH c AS (SELECT DISTINCT p_brand AS root, ({TODAY} + p_size - 12)::DATE AS expiry FROM part), a AS (SELECT * FROM c WHERE expiry >= {TODAY})
      SELECT root, coalesce(min(expiry) FILTER (expiry - {TODAY} > 5), min(expiry))::VARCHAR AS expiry FROM a GROUP BY root""",
    "implied_reference": f"""WITH {CHAIN}, b AS (SELECT p_brand AS root, l_shipdate::DATE AS d, l_orderkey % 80000 AS s, max(round(l_extendedprice * 100)::BIGINT) AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate::DATE <= {TODAY} GROUP BY ALL),
      e AS (SELECT root, d, arg_max(price, s) AS price FROM b GROUP BY ALL), w AS (SELECT root, arg_max(price, d) FILTER (d = {TODAY}) AS now, arg_max(price, d) FILTER (d < {TODAY}) AS before FROM e GROUP BY root)
      SELECT root, round(spot * (now::DOUBLE / before), 4) AS reference FROM w JOIN spots ON ticker = root""",
    "expiry_years": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP + INTERVAL 1 SECOND * (o_orderkey * 3571 % 86400) AS as_of, ((o_orderdate::DATE + (o_orderkey % 60 - 2)::INT)::TIMESTAMP + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York' AS close FROM orders),
      s AS (SELECT o_orderkey, epoch(close) - epoch(as_of) AS s FROM o) SELECT o_orderkey, CASE WHEN s > 0 THEN round(greatest(s, 60), 0) END AS seconds FROM s""",
    "expiry_days": """WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), f AS (SELECT d, (date_trunc('month', d)::DATE + ((12 - isodow(date_trunc('month', d)))::INT % 7) + 14)::DATE AS a, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS m FROM o)
      SELECT d, (CASE WHEN a >= d THEN a ELSE (m + ((12 - isodow(m))::INT % 7) + 14)::DATE END - d)::INTEGER AS days FROM f""",
    "date_formats": "SELECT DISTINCT o_orderdate::DATE AS d, strftime(o_orderdate::DATE, '%Y%m%d') AS compact, o_orderdate::DATE::VARCHAR AS again FROM orders",
    "curve_forms": f"WITH {MACRO} SELECT d, round((move / nullif(vix, 0) - 1) * 100, 4) AS futures, round((1 - vix / nullif(move, 0)) * 100, 4) AS ratio, round((move / nullif(vix, 0) - 1) * 100, 4) AS backfill FROM wide",
    "official_frame": f"""WITH {OFFICIAL} SELECT d, {", ".join(f"round({c}, 4) AS {c}, {c}_source_date::VARCHAR AS {c}_source_date" for c in _OFFICIAL)}, round(fed_assets_b - tga_b - rrp_b, 4) AS net_liq_b, {_oldest("net_liq_b", "fed_assets_b", "tga_b", "rrp_b")},
      {", ".join(f"{_spread(n, a, b)}, {_oldest(n, a, b)}" for n, (a, b) in _SPREADS.items())} FROM wide""",
    "net_liquidity": f"WITH {OFFICIAL} SELECT d, round(fed_assets_b - tga_b - rrp_b, 4) AS net_liq_b, least(fed_assets_b_source_date, tga_b_source_date, rrp_b_source_date) AS source_date FROM wide",
    "rate_spreads": f"WITH {OFFICIAL} SELECT d, {', '.join(_spread(n, a, b) for n, (a, b) in _SPREADS.items())} FROM wide",
    "g3_liquidity": f"WITH {MACRO} SELECT d, CASE WHEN vix > 0 THEN round(vix * 1000 / 1000 + move * 1000 * credit_z / 1000 + pct_200ma * 100000 / 10 / (trin * 10 + 0.7::DOUBLE), 2) END AS g3_liq FROM wide",
    "values_at": f"""WITH {FACTS}, a AS (SELECT scope, metric, arg_max(value, d) AS value, max(d) AS source_date FROM facts WHERE d <= {TODAY} GROUP BY ALL), b AS (SELECT scope, metric, arg_max(value, d) AS base, max(d) AS base_date FROM facts WHERE d <= DATE '1998-06-23' GROUP BY ALL)
      SELECT scope, metric, round(value, 4) AS value, source_date::VARCHAR AS source_date, round(base, 4) AS base, base_date::VARCHAR AS base_date FROM a LEFT JOIN b USING (scope, metric)""",
    "resampled_latest": f"""WITH {FACTS}, {SPINE}, e AS (SELECT max(d) AS d FROM weekdays), k AS (SELECT * FROM facts WHERE CASE metric WHEN 'vix' THEN dayofweek(d) = 5 WHEN 'move' THEN dayofmonth(d) = 1 ELSE true END)
      SELECT scope, metric, any_value(e.d) AS d, round(arg_max(value, k.d) FILTER (k.d <= e.d), 4) AS value FROM k, e GROUP BY scope, metric""",
    "strict_previous": f"WITH {FACTS} SELECT scope, metric, d, (lag(d) OVER w)::VARCHAR AS previous, round(value - lag(value) OVER w, 4) AS increment FROM facts WINDOW w AS (PARTITION BY scope, metric ORDER BY d)",
    "merged_prices": f"WITH {DAILY} SELECT d, coalesce(CASE WHEN s.n % 3 > 0 THEN ship_price END, o.price) AS price FROM o FULL JOIN s USING (d)",
    "priority_dated": f"""WITH {DAILY}, a AS (SELECT d, CASE WHEN n % 4 > 0 THEN n END AS n, d - 1 AS s FROM s), b AS (SELECT d, CASE WHEN n % 5 > 0 THEN n END AS n, d - 7 AS s FROM o)
      SELECT d, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NOT NULL THEN 'first' WHEN b.n IS NOT NULL THEN 'second' END AS n_from, CASE WHEN a.n IS NOT NULL THEN a.s WHEN b.n IS NOT NULL THEN b.s END AS n_source_date FROM a FULL JOIN b USING (d)""",
    "with_fallback": f"WITH {DAILY} SELECT d, n FROM s UNION ALL SELECT d, n FROM o WHERE d NOT IN (SELECT d FROM s)",
    "latest_rows": f"WITH {FACTS} SELECT scope, metric, max(d) AS d, round(arg_max(value, d), 4) AS value FROM facts WHERE d BETWEEN DATE '1996-01-01' AND {TODAY} GROUP BY ALL",
    "wide_to_long": f"WITH {FACTS} SELECT d, metric, round(value, 4) AS value FROM facts WHERE scope = 'MACRO'",
    "net_positions": f"""WITH r AS (SELECT p_size % 3 AS back, upper(p_type) AS t, p_size - p_partkey % 17 AS net FROM part), g AS (SELECT *, CASE WHEN contains(t, 'ECONOMY') AND contains(t, 'BRUSHED') AND NOT contains(t, 'COPPER') THEN 'household' WHEN contains(t, 'SMALL') AND NOT (contains(t, 'TIN') OR contains(t, 'STEEL')) THEN 'parts' WHEN contains(t, 'PROMO') THEN 'offers' WHEN contains(t, 'E') AND NOT contains(t, 'LARGE') THEN 'others' END AS "group" FROM r WHERE back = (SELECT min(back) FROM r))
      SELECT "group", sum(net)::BIGINT AS net FROM g WHERE "group" IS NOT NULL GROUP BY 1""",
    "largest_by_cap": "SELECT c_name AS name, c_acctbal AS market_cap FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_name LIMIT 500",
    "breadth_counts": f"""WITH {SNAP}, c AS (SELECT d, count(*) AS total, count(*) FILTER (change > 0 AND volume > 0) AS advances, count(*) FILTER (change < 0 AND volume > 0) AS declines, coalesce(sum(volume) FILTER (change > 0), 0)::BIGINT AS up, coalesce(sum(volume) FILTER (change < 0), 0)::BIGINT AS down,
        count(*) FILTER (n >= 20 AND close > s20) AS a20, count(*) FILTER (n >= 50 AND close > s50) AS a50, count(*) FILTER (n >= 200 AND close > s200) AS a200, count(*) FILTER (close >= hi * 0.99::DOUBLE) AS nh, count(*) FILTER (close <= lo * 1.01::DOUBLE) AS nl FROM snap GROUP BY d)
      SELECT d, total, advances, declines, CASE WHEN declines > 0 AND down > 0 AND up > 0 THEN round((advances::DOUBLE / declines) / (up::DOUBLE / down), 2) ELSE 0 END AS trin, round(a20::DOUBLE / total * 100, 1) AS pct_20ma, round(a50::DOUBLE / total * 100, 1) AS pct_50ma, round(a200::DOUBLE / total * 100, 1) AS pct_200ma, nh, nl, nh - nl AS net_nh_nl FROM c""",
    "heatmap_latest": f"""WITH {BARS}, r AS (SELECT symbol, d, row_number() OVER w AS n, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS back, {", ".join(f"round((close::DOUBLE / lag(close, {k}) OVER w - 1) * 100, 4) AS r_{k}" for k in (1, 5, 21, 63))} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
      SELECT symbol, d, r_1, r_5, r_21, r_63 FROM r WHERE back = 1 AND n > 64""",
    "trailing_tick_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM events",
    "volume_ratio": f"""WITH {BARS}, m AS (SELECT d, volume, close - lag(close) OVER (PARTITION BY symbol ORDER BY d) AS mv FROM bars), s AS (SELECT d, coalesce(sum(volume) FILTER (mv > 0), 0)::DOUBLE AS up, coalesce(sum(volume) FILTER (mv < 0), 0)::DOUBLE AS down FROM m GROUP BY d)
      SELECT d, round(CASE WHEN down > 0 THEN up / down WHEN up > 0 THEN 99 ELSE 1 END, 4) AS ratio FROM s""",
    "volume_pcr": f"""WITH {CHAIN}, v AS (SELECT *, oi * (strike::BIGINT % 7) AS volume FROM chain WHERE dte >= 0), f AS (SELECT v.* FROM v JOIN (SELECT ticker, min(dte) AS dte FROM v GROUP BY 1) USING (ticker, dte)), s AS (SELECT ticker, coalesce(sum(volume) FILTER (cp = 'C'), 0)::DOUBLE AS c, coalesce(sum(volume) FILTER (cp = 'P'), 0)::DOUBLE AS p FROM f GROUP BY ticker)
      SELECT ticker, CASE WHEN c > 0 THEN round(p / c, 2) END AS volume_pcr FROM s""",
    "chain_assembled": f"""WITH {CHAIN}, e AS (SELECT DISTINCT ticker, bucket, dte FROM held), r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker, bucket) AS n FROM e WINDOW w AS (PARTITION BY ticker, bucket ORDER BY dte)), x AS (SELECT DISTINCT ticker, dte FROM r WHERE i = 0 OR (bucket = '8-30D' AND i = n - 1)),
      s AS (SELECT ticker, strike, spot, row_number() OVER (PARTITION BY ticker ORDER BY strike) AS k FROM (SELECT DISTINCT ticker, strike FROM chain) JOIN spots USING (ticker) WHERE strike BETWEEN spot * 0.8::DOUBLE AND spot * 1.2::DOUBLE), m AS (SELECT ticker, arg_min(k, [abs(strike - spot), strike]) AS mid FROM s GROUP BY ticker)
      SELECT ticker, dte, strike, cp FROM x JOIN s USING (ticker) JOIN m USING (ticker), (VALUES ('C'), ('P')) y(cp) WHERE abs(k - mid) <= 15""",
    "middle_strikes": f"""WITH {CHAIN}, s AS (SELECT ticker, strike, CASE WHEN regexp_matches(ticker, '[13579]$') THEN spot * 3 ELSE spot END AS spot FROM (SELECT DISTINCT ticker, strike FROM chain) JOIN spots USING (ticker)),
      r AS (SELECT *, strike BETWEEN spot * 0.98::DOUBLE AND spot * 1.02::DOUBLE AS near, row_number() OVER (PARTITION BY ticker ORDER BY strike) - 1 AS i, count(*) OVER (PARTITION BY ticker) // 2 AS mid FROM s), a AS (SELECT *, bool_or(near) OVER (PARTITION BY ticker) AS found FROM r)
      SELECT ticker, strike FROM a WHERE CASE WHEN found THEN near ELSE i >= mid - 20 AND i < mid + 20 END""",
    "option_vega": f"""WITH {CHAIN}, q AS (SELECT *, {D1} AS d1 FROM held), v AS (SELECT ticker, bucket, spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(years) AS v FROM q) SELECT ticker, bucket, round(sum(v), 4) AS vega, round(max(v), 4) AS most FROM v GROUP BY ALL""",
    "expected_straddle": f"""WITH {CHAIN}, e AS (SELECT c.*, spot, CASE WHEN oi % 5 > 0 THEN oi / 8 END AS mid FROM chain c JOIN spots USING (ticker) WHERE dte BETWEEN 1 AND 60), f AS (SELECT e.* FROM e JOIN (SELECT ticker, min(dte) AS dte FROM e GROUP BY 1) m USING (ticker, dte)),
      k AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY abs(strike - spot), strike) AS r FROM f), v AS (SELECT ticker, any_value(strike) AS strike, any_value(spot) AS spot, any_value(dte) AS dte, max(mid) FILTER (cp = 'C') + max(mid) FILTER (cp = 'P') AS straddle, median(iv) AS iv FROM k WHERE r = 1 GROUP BY ticker),
      x AS (SELECT *, coalesce(straddle, spot * iv * sqrt(dte / 365.0::DOUBLE)) AS value FROM v)
      SELECT ticker, strike AS atm_strike, round(value, 4) AS value, round(value / spot * 100, 4) AS pct, CASE WHEN straddle IS NOT NULL THEN 'ATM_STRADDLE_MID' ELSE 'ATM_IV_FALLBACK' END AS source FROM x""",
    "all_zero_points": f"""WITH {CURVE}, n AS (SELECT *, lead(exposure) OVER w AS y1, lead(level) OVER w AS x1, max(abs(exposure)) OVER (PARTITION BY ticker, bucket) AS scale FROM curve WINDOW w AS (PARTITION BY ticker, bucket ORDER BY i)),
      z AS (SELECT DISTINCT ticker, bucket, round(CASE WHEN abs(exposure) <= greatest(1e-12, scale * 1e-9) THEN level WHEN exposure * y1 < 0 THEN level - exposure * (x1 - level) / (y1 - exposure) END, 4) AS zero FROM n WHERE scale >= 1e-12)
      SELECT ticker, bucket, count(*) AS zeroes, round(min(zero), 3) AS lowest, round(max(zero), 3) AS highest FROM z WHERE zero IS NOT NULL GROUP BY ALL""",
    "flip_continuity": f"""WITH {BARS}, f AS (SELECT symbol AS ticker, d, CASE WHEN volume % 11 > 0 THEN close / 1000 END AS flip, close / 900 AS spot, CASE WHEN volume % 13 = 0 THEN 'B' ELSE 'A' END AS m, CASE WHEN volume % 3 = 0 THEN 'x' ELSE 'y' END AS e FROM bars),
      p AS (SELECT *, lag(flip) OVER w AS pf, lag(m) OVER w AS pm, lag(e) OVER w AS pe FROM f WINDOW w AS (PARTITION BY ticker ORDER BY d))
      SELECT ticker, d, CASE WHEN flip IS NULL THEN 'NO_CROSSING' WHEN pf IS NULL THEN 'BASELINE_RESET' WHEN m IS DISTINCT FROM pm THEN 'METHOD_CHANGED' WHEN abs(flip - pf) >= greatest(10, spot * 0.05::DOUBLE) THEN 'JUMP_REVIEW' WHEN e IS DISTINCT FROM pe THEN 'ROLL_CHANGED' ELSE 'OK' END AS status FROM p""",
    "micro_probe": f"""WITH {BARS}, st AS (SELECT symbol, d, close, open, high, low, volume, coalesce(sign(close - lag(close) OVER w)::BIGINT * volume, 0) AS step FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)), ob AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY d) AS obv, row_number() OVER (PARTITION BY symbol ORDER BY d) AS n FROM st),
      f AS (SELECT *, close - first_value(close) OVER v AS p, obv - first_value(obv) OVER v AS q, lag(CASE WHEN volume % 11 > 0 THEN open // 1000 END, 5) OVER w AS week, CASE WHEN volume % 11 > 0 THEN open // 1000 END AS level, (volume % 7 - 3) * lag(volume % 7 - 3) OVER w < 0 AS flipped FROM ob WINDOW w AS (PARTITION BY symbol ORDER BY d), v AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
      g AS (SELECT *, close / 100.0::DOUBLE AS price, (high + low) / 200.0::DOUBLE AS poc FROM f)
      SELECT symbol AS ticker, d, CASE WHEN n < 2 THEN '' ELSE concat_ws('; ', CASE WHEN price > poc * 1.02::DOUBLE THEN 'above cost core' END, CASE WHEN price < poc * 0.98::DOUBLE THEN 'below cost core' END, CASE WHEN n >= 2 AND ((p > 0 AND q < 0) OR (p < 0 AND q > 0)) THEN 'volume divergence' END, CASE WHEN volume % 70 > 50 THEN 'dark pool short high' END,
        CASE WHEN volume % 70 < 40 THEN 'dark pool short low' END, CASE WHEN level > week THEN 'flip up in a week' WHEN level < week THEN 'flip down in a week' END, CASE WHEN volume % 3 > 0 AND volume % 5 = 0 THEN 'pin candidate' WHEN volume % 3 > 0 AND volume % 5 = 1 THEN 'breakout pivot' END, CASE WHEN flipped THEN 'charm flipped' END, CASE WHEN volume % 40 < 10 THEN 'volatility cheap' END) END AS findings FROM g""",
    "intraday_alert": f"""WITH {BARS}, r AS (SELECT symbol, d, close AS p, open * (1 - (volume % 10) / 100) AS bound, (volume % 4) * 0.8::DOUBLE AS trin, (volume % 9) / 2 - 0.1::DOUBLE AS ratio, volume % 1000 - 500 AS ctick, high * 0.9::DOUBLE AS flip, (high + low) / 2 AS vwap FROM bars)
      SELECT symbol, d, CASE WHEN p <= bound * 1.002::DOUBLE AND trin >= 1.5 THEN CASE WHEN ratio >= 2 AND ctick > 0 THEN 'capitulation bid' END WHEN flip > 0 AND p < flip AND p < vwap THEN CASE WHEN ratio <= 0.25 AND ctick < -300 THEN 'gamma slide' END
        WHEN ratio >= 4 AND p > vwap THEN 'up-volume surge' WHEN ratio <= 0.20 AND p < vwap THEN 'down-volume surge' END AS alert FROM r""",
    "macro_probe": f"""WITH {BARS}, {MACRO}, {_THRUST} SELECT d, (CASE WHEN thrust = 'washout' THEN 2 ELSE 0 END + CASE WHEN vix_contango_pct < 0 THEN 2 ELSE 0 END + CASE WHEN credit_z > 2 THEN 1 ELSE 0 END + CASE WHEN trin > 2 THEN 1 ELSE 0 END)::INTEGER AS level,
      concat_ws('; ', CASE thrust WHEN 'thrust' THEN 'bottom confirmed by breadth' WHEN 'washout' THEN 'panic in breadth' END, CASE WHEN vix < 60 THEN 'off-exchange divergence' END, CASE WHEN vix_contango_pct < 0 THEN 'volatility curve inverted' END, CASE WHEN credit_z > 2 THEN 'volatility premium extreme' END,
        CASE WHEN trin > 2 THEN 'credit against bonds turns averse' END) AS findings FROM wide JOIN th USING (d)""",
    "momentum_scan": f"WITH {STATS} SELECT scope, metric, d, round(z, 4) AS z, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS move FROM stats WHERE n > 30 AND abs(z) > 2",
    "todays_log": """WITH l AS (SELECT event_type AS file, event_id AS n, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 11 = 0 THEN strftime(ts, '%Y-%m-%d') || ' scan' WHEN event_id % 7 = 1 THEN '[' || strftime(ts, '%Y-%m-%d') || ' 10:00:00] tick' WHEN event_id % 13 = 2 THEN '[' || strftime(ts, '%Y-%m-%d') || '] heartbeat'
        WHEN event_id % 5 = 2 THEN '  heartbeat ok' WHEN event_id % 17 = 3 THEN '  ' ELSE 'detail ' || event_id END AS line FROM events), q AS (SELECT * FROM l WHERE NOT contains(line, 'heartbeat') AND NOT contains(line, 'debug')),
      g AS (SELECT *, last_value(CASE WHEN line[1] = '[' AND line[2:3] = '20' AND line[6] = '-' AND len(line) >= 11 THEN contains(line, (SELECT max(day) FROM l)) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n) AS open FROM q)
      SELECT file, n, line FROM g WHERE coalesce(open, true) AND trim(line) <> ''""",
    "event_order": f"WITH {STATS} SELECT d, row_number() OVER (PARTITION BY d ORDER BY severity DESC, confidence DESC, layer, scope, metric, window_scope)::INTEGER AS place, metric, scope, window_scope, severity FROM events",
    "environment_lines": f"""WITH {ENVIRONMENT} SELECT d, string_agg("index" || ' ' || coalesce(printf('%.1f', score), 'n/a') || ' (' || round_even(coverage * 100, 0)::INT || '%)', '; ' ORDER BY "index") AS summary FROM scores GROUP BY d""",
    "liquidity_context": f"WITH {CONTEXT} SELECT d, round(reserves_t, 4) AS reserves_t, round(tga_b, 4) AS tga_b, round(sofr_iorb_bps, 4) AS sofr_iorb_bps, round(nfci, 4) AS nfci, round(move, 4) AS move, round(hy_spread, 4) AS hy_spread FROM cx",
    "liquidity_warnings": f"WITH {CONTEXT} SELECT d, warnings FROM noted",
    "liquidity_quadrant": f"""WITH {LIQUIDITY}, q AS (SELECT d, max(score) FILTER (pillar = 'water_stock') AS water_stock, max(score) FILTER (pillar = 'flow_pulse') AS flow_pulse FROM pillars GROUP BY d)
      SELECT d, water_stock, flow_pulse, CASE WHEN water_stock IS NOT NULL AND flow_pulse IS NOT NULL THEN (CASE WHEN water_stock >= 50 THEN 'high' ELSE 'low' END) || ' ' || (CASE WHEN flow_pulse >= 50 THEN 'inflow' ELSE 'outflow' END) END AS cell FROM q""",
    "raw_appendix": f"""WITH {STATS} SELECT d, 'metrics' AS section, scope || '/' || metric AS name, format('{{:,.4f}}', value) AS text FROM stats UNION ALL SELECT d, 'events', scope || '/' || metric || '/' || window_scope || '/' || resonance_key, layer || ' ' || severity FROM events""",
    "degraded_days": f"WITH {FACTS}, {SPINE} SELECT d, 'no usable metric: upstream data missing' AS notice FROM weekdays WHERE d NOT IN (SELECT d FROM facts WHERE scope = 'MACRO')",
    "metadata_stamp": f"WITH {DAILY} SELECT d, CASE WHEN n % 2 = 0 THEN 'given' ELSE d::VARCHAR END AS source_date, true AS ingested FROM o",
    "short_volume_files": f"WITH {BARS} SELECT symbol, d, round((volume % 37)::DOUBLE / volume * 100, 4) AS dpsv_pct FROM bars",
    "observations_json": f"WITH {FACTS} SELECT 'vix' AS \"column\", d, round(value, 4) AS value, d::VARCHAR AS source_date FROM facts WHERE scope = 'MACRO' AND metric = 'vix' AND dayofmonth(d) <> 5",
    "treasury_json": f"WITH {FACTS} SELECT d, round(round(value, 4) / 1000, 4) AS tga_b FROM facts WHERE scope = 'MACRO' AND metric = 'vix' AND dayofmonth(d) < 28",
    "rates_json": f"WITH {MACRO} SELECT d, round(trin, 4) AS rate, round(trin + 0.5::DOUBLE, 4) AS p75, CASE WHEN dayofmonth(d) > 3 THEN round(trin + 1, 4) END AS p99, round(vix, 4) AS volume_b FROM wide",
    "dix_csv": f"WITH {MACRO} SELECT d, CASE WHEN dayofmonth(d) <> 9 THEN round(trin / 8 * 100, 4) END AS dix_pct, round(round(vix * 1000000000) / 1000000000, 4) AS gex_billions FROM wide",
    "json_fields": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "upserted": f"""WITH {STORED}, w AS (SELECT d, scope, 'PRE' AS session, value + CASE WHEN scope = 'MACRO' THEN 0 ELSE 1 END AS value FROM st UNION ALL SELECT d, scope, 'POST', value + 2 FROM st WHERE scope = 'MACRO')
      SELECT d, scope, session, count(*) AS n, {_TEN.format("value")} AS total FROM w GROUP BY ALL""",
    "finalised": f"WITH {STORED} SELECT d, is_final, count(*) AS n, {_TEN.format('value + CASE WHEN is_final THEN 0 ELSE 5 END')} AS total FROM st GROUP BY ALL",
    "synced_days": f"WITH {STORED}, k AS (SELECT d, value + CASE WHEN d = DATE '1997-01-01' THEN 7 ELSE 0 END AS value FROM st WHERE d <> DATE '1997-01-01' OR is_final) SELECT d, count(*) AS n, {_TEN.format('value')} AS total FROM k GROUP BY ALL",
    "appended_log": f"WITH {DAILY} SELECT d, 2::BIGINT AS rows, (2 * n)::BIGINT AS n FROM o",
    "replaced_dates": f"WITH {DAILY} SELECT d, n FROM s WHERE n > 5 UNION ALL SELECT d, n FROM o WHERE d NOT IN (SELECT d FROM s WHERE n > 5)",
    "rolling_cache": f"WITH {DAILY}, b AS (SELECT d, coalesce(s.n, o.n) AS n FROM o FULL JOIN s USING (d)) SELECT d, n FROM b ORDER BY d DESC LIMIT 500",
    "stale_events": f"WITH {STATS} SELECT e.d, e.scope, e.metric, e.window_scope, e.layer FROM events e ANTI JOIN alerts a USING (d, scope, metric, window_scope, layer)",
    "day_scan": f"WITH {FACTS} SELECT scope, metric, round(value, 4) AS value, 'PRE' AS session, '1997-03-01' AS report_date FROM facts WHERE date_trunc('month', d) = DATE '1997-03-01' AND dayofmonth(d) < 15 AND scope <> 'MACRO'",
    "stream_finalised": "SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY ALL",
}

_NAMES = [p for p, _ in specs.PILLARS]
_DRAGS = """e AS (SELECT * FROM scored WHERE quality >= 0.35 AND score IS NOT NULL), rk AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, component) AS up, row_number() OVER (PARTITION BY d ORDER BY score, component) AS down FROM e),
  sd AS (SELECT d, 'support' AS side, up AS place, component, score FROM rk WHERE up <= 3 AND score >= 60 UNION ALL SELECT d, 'drag', down, component, score FROM rk WHERE down <= 3 AND score <= 40)"""
SQL["liquidity_summary"] = f"""WITH ls AS ({ORACLE_SQL["liquidity_state"]}), {CONTEXT}, {_DRAGS}
  SELECT d, 0 AS place, 'state: ' || state AS line FROM ls UNION ALL SELECT d, 1, 'composite: ' || coalesce(printf('%.1f', composite), 'insufficient data') FROM ls UNION ALL SELECT d, 2, 'coverage: ' || round_even(coverage * 100, 0)::INT || '%' FROM ls
  UNION ALL SELECT d::VARCHAR, list_position({_NAMES!r}, pillar)::INT + 2, pillar || ': ' || coalesce(printf('%.1f', score), 'insufficient data') FROM pillars
  UNION ALL SELECT d::VARCHAR, CASE side WHEN 'support' THEN 9 ELSE 10 END, side || 's: ' || string_agg(component || ' ' || round_even(score, 0)::INT, '; ' ORDER BY place) FROM sd GROUP BY d, side
  UNION ALL SELECT d::VARCHAR, 11, 'notes: ' || warnings FROM noted WHERE warnings <> ''"""
SQL["overview_rows"] = f"""WITH a AS ({ORACLE_SQL["macro_score"]}), b AS ({ORACLE_SQL["micro_score"]}), c AS ({ORACLE_SQL["regime_label"]}), e AS ({ORACLE_SQL["environment_composite"]}), l AS ({ORACLE_SQL["liquidity_state"]})
  SELECT d, macro_score, micro_score, regime, skeleton, e.composite AS composite, l.composite AS waterline, l.state AS liquidity_state FROM a FULL JOIN b USING (d) FULL JOIN c USING (d) FULL JOIN e USING (d) FULL JOIN l USING (d)"""

#: Newton's steps in SQL, as many as the operator takes.
_N = "exp(-a * a / 2) / sqrt(2 * pi())"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x}) / sqrt(2)))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    return f"(CASE WHEN {x} >= 0 THEN (1 + (1 - {poly} * exp(-{x} * {x} / 2))) / 2 ELSE (1 - (1 - {poly} * exp(-{x} * {x} / 2))) / 2 END)"


def _value(a: str, b: str) -> str:
    return f"CASE cp WHEN 'C' THEN spot * {_cdf(a)} - pv * {_cdf(b)} ELSE pv * (1 - {_cdf(b)}) - spot * (1 - {_cdf(a)}) END"


SQL["implied_vol"] = f"""WITH RECURSIVE {CHAIN}, q AS (SELECT *, {D1} AS a, strike * exp(-0.053::DOUBLE * years) AS pv FROM held), g AS (SELECT *, a - iv * sqrt(years) AS b, -a AS ma, -(a - iv * sqrt(years)) AS mb FROM q),
  given AS (SELECT ticker, dte, strike, cp, iv, spot, years, pv, CASE cp WHEN 'C' THEN spot * {_cdf("a")} - pv * {_cdf("b")} ELSE pv * {_cdf("mb")} - spot * {_cdf("ma")} END AS premium FROM g),
  valid AS (SELECT *, premium > 0 AND premium >= CASE cp WHEN 'C' THEN spot - strike ELSE strike - spot END AS ok FROM given),
  it AS (
    SELECT *, 0 AS step, 0.5::DOUBLE AS sigma, false AS done FROM valid WHERE ok
    UNION ALL
    SELECT * EXCLUDE (step, sigma, done, a, b, gap, vega), step + 1, CASE WHEN abs(gap) < 1e-5 OR vega < 1e-10 THEN sigma ELSE least(4.0::DOUBLE, greatest(0.005::DOUBLE, sigma - gap / vega)) END, abs(gap) < 1e-5 FROM (
      SELECT *, {_value("a", "b")} - premium AS gap, spot * {_N} * sqrt(years) AS vega FROM (
        SELECT *, a - sigma * sqrt(years) AS b FROM (SELECT *, (ln(spot / strike) + (0.053::DOUBLE + sigma * sigma / 2) * years) / (sigma * sqrt(years)) AS a FROM it WHERE NOT done AND step < 60)))
  ), solved AS (SELECT ticker, dte, strike, cp, arg_max(sigma, step) AS sigma, bool_or(done) AS done FROM it GROUP BY ALL)
  SELECT v.ticker, v.dte, v.strike, v.cp, round(iv, 3) AS iv, CASE WHEN ok AND done THEN round(sigma, 3) END AS implied FROM valid v LEFT JOIN solved s USING (ticker, dte, strike, cp)"""

#: The date columns of the results; the others have none, or give them as text already.
_DATED = {
    n: ["d"]
    for n in (
        "trading_days", "history_normalised", "expiry_days", "date_formats", "curve_forms", "official_frame", "net_liquidity", "rate_spreads", "g3_liquidity", "resampled_latest", "strict_previous", "merged_prices", "with_fallback", "latest_rows",
        "wide_to_long", "breadth_counts", "heatmap_latest", "volume_ratio", "flip_continuity", "micro_probe", "intraday_alert", "macro_probe", "momentum_scan", "event_order", "environment_lines", "liquidity_context", "liquidity_warnings",
        "liquidity_quadrant", "raw_appendix", "degraded_days", "metadata_stamp", "short_volume_files", "observations_json", "treasury_json", "rates_json", "dix_csv", "upserted", "finalised", "synced_days", "appended_log", "replaced_dates",
        "rolling_cache", "stale_events", "stream_finalised",
    )
} | {"net_liquidity": ["d", "source_date"], "priority_dated": ["d", "n_source_date"], "official_frame": ["d", "net_liq_b_source_date", *(f"{n}_source_date" for n in _SPREADS)]}

ORACLE_SQL |= {name: text_dates(sql, _DATED.get(name, [])) for name, sql in SQL.items()}
