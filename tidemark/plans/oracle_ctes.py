"""Derived inputs of ``tidemark.sources.derive`` and shared intermediate tables as SQL text."""

CTES: dict[str, str] = {}

CTES["bars"] = """
SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
       arg_max(px, k) AS "close", sum(l_quantity * 1000 + l_extendedprice / 10) AS volume
FROM (SELECT *, 100 + l_extendedprice / 20011.7 AS px,
             (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS k FROM lineitem)
GROUP BY 1, 2"""

CTES["macro"] = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS10' WHEN '2-HIGH' THEN 'DFF' WHEN '3-MEDIUM' THEN 'VIXCLS'
            ELSE o_orderpriority END AS series_id,
       o_orderdate AS "timestamp", arg_max(o_totalprice, o_orderkey) / 15000 AS value
FROM orders GROUP BY 1, 2"""

CTES["docs"] = """
SELECT event_id AS document_id, 'S' || user_id AS symbol, ts - INTERVAL 25 YEARS AS published_at,
       greatest(-1.0, least(1.0, (value - 50) / 49.7)) AS sentiment_score
FROM events"""

CTES["rets"] = """
SELECT * FROM (SELECT symbol AS run, ts, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)
WHERE ret IS NOT NULL"""

CTES["calendar_days"] = """
SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) t(d)"""

CTES["px_ret"] = """
SELECT *, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret_1d,
       "close" - lag("close") OVER (PARTITION BY symbol ORDER BY ts) AS diff FROM bars"""


def gated(agg: str, x: str, n: int, lo: str | None = None, hi: str = "CURRENT ROW", part: str = "symbol") -> str:
    """A full-window aggregate: NULL unless all n values are there."""
    frame = f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN {lo or f'{n - 1} PRECEDING'} AND {hi})"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


CTES["px_feat"] = f"""
SELECT symbol, ts, ret_1d,
  "close" / lag("close", 5) OVER w - 1 AS ret_5d, "close" / lag("close", 21) OVER w - 1 AS ret_21d,
  {gated('stddev_samp', 'ret_1d', 21)} AS vol_21d, {gated('stddev_samp', 'ret_1d', 63)} AS vol_63d,
  sign({gated('sum', 'ret_1d', 21)}) AS mom_21d,
  100 - 100 / (1 + {gated('avg', 'CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END', 14)} / nullif({gated('avg', 'CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END', 14)}, 0)) AS rsi_14,
  ln(1 + volume) AS log_volume,
  "close" / lag("close", 252) OVER w - 1 AS ret_252d, "close" / lag("close", 126) OVER w - 1 AS ret_126d,
  "close" / {gated('avg', '"close"', 200)} AS ma200_ratio, "close" / {gated('avg', '"close"', 50)} AS ma50_ratio,
  volume / nullif({gated('avg', 'volume', 63)}, 0) AS volume_ratio
FROM px_ret WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""

# Observations moved on by one business day, then the last one known on each calendar day.
CTES["macro_lagged"] = """
SELECT series_id, greatest(avail, DATE '1995-01-01') AS day, arg_max(value, "timestamp") AS value FROM (
  SELECT series_id, value, "timestamp",
    CAST(CASE WHEN isodow("timestamp") >= 5 THEN CAST("timestamp" AS DATE) + CAST(8 - isodow("timestamp") + CASE WHEN isodow("timestamp") > 5 THEN 1 ELSE 0 END AS INTEGER)
         ELSE CAST("timestamp" AS DATE) + 1 END AS DATE) AS avail
  FROM macro) GROUP BY 1, 2"""

CTES["macro_wide"] = """
SELECT day,
  last_value(dgs10 IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DGS10,
  last_value(dff IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DFF,
  last_value(vix IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VIXCLS
FROM calendar_days LEFT JOIN (
  SELECT day, max(CASE WHEN series_id = 'DGS10' THEN value END) AS dgs10, max(CASE WHEN series_id = 'DFF' THEN value END) AS dff,
         max(CASE WHEN series_id = 'VIXCLS' THEN value END) AS vix
  FROM macro_lagged GROUP BY day) USING (day)"""

CTES["doc_feat"] = """
SELECT b.symbol, b.ts, coalesce(avg(d.sentiment_score), 0.0) AS sentiment_score, count(d.document_id) AS doc_count,
       count(d.document_id) > 0 AS has_coverage
FROM bars b LEFT JOIN docs d ON d.symbol = b.symbol AND d.published_at < b.ts AND d.published_at >= b.ts - INTERVAL 30 DAYS
GROUP BY 1, 2"""

# All 27 registered columns.
_RANK = """CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY f.ts) >= 5 THEN
  (rank() OVER (PARTITION BY f.ts, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY f.ts, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY f.ts) END AS xs_rank_{c}"""
CTES["full_feat"] = f"""
SELECT f.*, DGS10, DFF, VIXCLS, DGS10 - DFF AS yield_curve,
  CASE WHEN VIXCLS <= 15 THEN 0.0 WHEN VIXCLS >= 25 THEN 2.0 WHEN VIXCLS IS NOT NULL THEN 1.0 END::DOUBLE AS vix_regime,
  CAST(DGS10 - DFF < 0 AS DOUBLE) AS curve_inverted, vol_21d / nullif(vol_63d, 0) AS vol_regime_ratio, CAST(ma200_ratio > 1 AS DOUBLE) AS trend_regime,
  d.sentiment_score, d.doc_count, d.has_coverage, {', '.join(_RANK.format(c=c) for c in ('ret_21d', 'ret_252d', 'vol_21d'))}
FROM px_feat f LEFT JOIN macro_wide m ON m.day = CAST(f.ts AS DATE) LEFT JOIN doc_feat d ON d.symbol = f.symbol AND d.ts = f.ts"""

CTES["eras"] = """
SELECT * FROM (VALUES ('qe_bull', DATE '1996-07-01', DATE '1998-06-30'), ('covid', DATE '1998-07-01', DATE '1999-12-31'),
                      ('rate_cycle', DATE '2000-01-01', DATE '2099-12-31')) t(name, lo, hi)"""

CTES["rets_era"] = """
SELECT r.*, coalesce(e.name, 'pre_qe') AS regime FROM rets r LEFT JOIN eras e ON CAST(r.ts AS DATE) BETWEEN e.lo AND e.hi"""

CTES["positions"] = """
SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM bars)"""

# Three forecast schemes of the next bar's return, tall.
CTES["scheme_pred"] = """
SELECT scheme, symbol, ts, y AS y_true, CASE scheme WHEN 'long' THEN 0.001 WHEN 'mom' THEN ret_1d ELSE -0.5 * ret_1d END AS y_pred
FROM (SELECT symbol, ts, ret_1d, lead(ret_1d) OVER (PARTITION BY symbol ORDER BY ts) AS y FROM px_ret),
     (SELECT unnest(['long', 'mom', 'rev']) AS scheme) WHERE ret_1d IS NOT NULL AND y IS NOT NULL"""

CTES["scheme_daily"] = """
SELECT scheme, ts, avg(y_true - y_pred) AS err, avg(sign(y_pred) * y_true) AS ret, coalesce(any_value(e.name), 'pre_qe') AS regime
FROM scheme_pred p LEFT JOIN eras e ON CAST(p.ts AS DATE) BETWEEN e.lo AND e.hi GROUP BY 1, 2"""


def uniform_sql(*parts: str) -> str:
    return "(CAST('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


def norm_cdf_sql(z: str) -> str:
    """Standard normal CDF by Simpson's rule on 4000 intervals."""
    x = f"greatest(-12.0, least(12.0, {z}))"
    return (f"(0.5 + ({x}) / 12000.0 * list_sum(list_transform(range(0, 4001), lambda i: "
            f"(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(({x}) * i / 4000.0, 2)))) / sqrt(2 * pi()))")


def t_cdf_sql(t: str, df: str) -> str:
    """Student t CDF by Simpson's rule."""
    x = f"greatest(-40.0, least(40.0, {t}))"
    return (f"(0.5 + ({x}) / 24000.0 * list_sum(list_transform(range(0, 8001), lambda i: "
            f"(CASE WHEN i = 0 OR i = 8000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(({x}) * i / 8000.0, 2) / ({df}), -(({df}) + 1) / 2.0)))"
            f" * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi() * ({df})))")
