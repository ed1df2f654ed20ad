"""SQL builders shared by the check queries (replay by recursion, metric aggregates)."""
from __future__ import annotations

from tidemark.plans.registry import r6


def replay_ctes(src: str, capital: float = 100000.0) -> str:
    """CTEs ``nb``, ``st``, ``eq``, ``tr`` replaying ``src(g, ts, open, volume, signal, fee, slip, cap)``."""
    return f"""
src AS ({src}),
nb AS (SELECT g, ts, open, volume, fee, slip, cap, CAST(lag(signal) OVER w AS INTEGER) AS want,
         row_number() OVER w AS n, count(*) OVER (PARTITION BY g) AS cnt
       FROM src WINDOW w AS (PARTITION BY g ORDER BY ts)),
st AS (
  SELECT g, ts, n, cnt, open, fee, slip, CAST({capital} AS DOUBLE) AS cash, CAST(0 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS entry,
         CAST(NULL AS DOUBLE) AS t_entry, CAST(NULL AS DOUBLE) AS t_exit, CAST(NULL AS BIGINT) AS t_pos FROM nb WHERE n = 1
  UNION ALL
  SELECT g, ts, n, cnt, open, fee, slip, cash1 - (target * sh * fill + sh * fee),
         CAST(CASE WHEN moves THEN sh * target ELSE pos END AS BIGINT),
         CASE WHEN sh > 0 THEN fill WHEN moves THEN 0 ELSE entry END,
         CASE WHEN closes THEN entry END, CASE WHEN closes THEN exit_fill END, CASE WHEN closes THEN pos END
  FROM (SELECT *, CASE WHEN moves AND target <> 0 THEN greatest(0, least(
               CASE WHEN fill > 0 THEN CAST(trunc(cash1 / fill) AS BIGINT) ELSE 0 END, CAST(trunc(volume * cap) AS BIGINT))) ELSE 0 END AS sh
        FROM (SELECT *, CASE WHEN closes THEN cash + (pos * exit_fill - abs(pos) * fee) ELSE cash END AS cash1
              FROM (SELECT *, target <> sign(pos) AS moves, target <> sign(pos) AND pos <> 0 AS closes,
                           open * (1 - slip * sign(pos)) AS exit_fill, open * (1 + slip * target) AS fill
                    FROM (SELECT b.*, p.cash, p.pos, p.entry, coalesce(b.want, sign(p.pos)) AS target
                          FROM st p JOIN nb b ON b.g = p.g AND b.n = p.n + 1))))),
eq AS (SELECT g, ts, n, CASE WHEN n = cnt AND pos <> 0 THEN cash + (pos * (open * (1 - slip * sign(pos))) - abs(pos) * fee)
                          ELSE cash + pos * open END AS equity FROM st),
tr AS (SELECT g, ts, t_entry AS entry_price, t_exit AS exit_price, abs(t_pos) AS shares, fee, sign(t_pos) AS side FROM st WHERE t_pos IS NOT NULL
       UNION ALL
       SELECT g, ts, entry, open * (1 - slip * sign(pos)), abs(pos), fee, sign(pos) FROM st WHERE n = cnt AND pos <> 0),
pnl AS (SELECT *, shares * (exit_price - entry_price) * side AS gross_pnl, shares * fee * 2 AS commission FROM tr),
eq_ret AS (SELECT * FROM (SELECT g, ts, equity / lag(equity) OVER (PARTITION BY g ORDER BY ts) - 1 AS ret FROM eq) WHERE ret IS NOT NULL)"""


METRIC_NAMES = ("total_return", "annualized_return", "sharpe", "sortino", "max_drawdown", "calmar")
DIGITS = {"total_return": 4, "annualized_return": 4, "calmar": 3, "sharpe": 6, "sortino": 6, "max_drawdown": 6}


def metrics_sql(rel: str, keys: str) -> str:
    """Metric rows of relation ``rel(keys, ts, ret)``."""
    return f"""
SELECT {keys}, n_bars, {", ".join(r6(m, m, DIGITS[m]) for m in METRIC_NAMES)} FROM (
  SELECT *, CASE WHEN max_drawdown < 0 THEN annualized_return / abs(nullif(max_drawdown, 0)) END AS calmar FROM (
    SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, 252.0 / n_bars) - 1 ELSE -1 END AS annualized_return FROM (
      SELECT {keys}, count(ret) AS n_bars, product(1 + ret) - 1 AS total_return,
        CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) ELSE 0 END AS sharpe,
        CASE WHEN avg(CASE WHEN ret < 0 THEN ret * ret END) > 0
             THEN avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252) ELSE 0 END AS sortino,
        min(dd) AS max_drawdown
      FROM (SELECT *, (e - peak) / peak AS dd FROM (
              SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY ts) AS peak FROM (
                SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY ts) AS e FROM {rel})))
      GROUP BY {keys})))"""


def fold_ctes(panel: str, train: int = 504, test: int = 63, step: int = 63, gap: int = 4, rows: bool = True) -> str:
    """CTEs ``pan``, ``cal``, ``folds`` and, with ``rows``, ``fr`` (panel rows with fold and role)."""
    out = f"""
pan AS ({panel}),
cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n_days FROM (SELECT DISTINCT ts FROM pan)),
folds AS (SELECT k AS fold, {train} + k * {step} AS s FROM (SELECT max(n_days) AS n FROM cal), generate_series(0, 100000) t(k)
          WHERE {train} + k * {step} + {test} <= n)"""
    if rows:
        out += f""",
fr AS (SELECT p.*, c.pos, f.fold, CASE WHEN c.pos >= f.s THEN 'test' ELSE 'train' END AS role
       FROM pan p JOIN cal c USING (ts) JOIN folds f ON c.pos BETWEEN f.s AND f.s + {test} - 1 OR c.pos BETWEEN f.s - {train} AND f.s - 1 - {gap})"""
    return out
