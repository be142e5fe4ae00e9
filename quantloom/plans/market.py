"""Queries on prices and returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import prices as P
from ..operators import returns as R
from .frames import frame, oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registry(queries: dict, oracles: dict[str, str]):
    def query(name: str, frames: str, sql: str | None):
        """Registers a function of frames (in that order) as a query, with its SQL."""

        def add(f):
            queries[name] = lambda spark, sf_dir: f(*(frame(spark, sf_dir, x) for x in frames.split()))
            if sql:
                oracles[name] = oracle(frames, sql)
            return f

        return add

    return query


query = registry(QUERIES, ORACLE)


def rounded(df, digits: int = 6, **others):
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, others.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns))


def window_values() -> str:
    rows = []
    for i, code, kind, period, sessions, days, months, years, ann in C.WINDOWS:
        back = months if months else 12 * years if years else None
        rows.append(f"({i}, '{code}', '{kind}', {repr(period) if period else 'NULL'}, {sessions or 'NULL'}, {days or 'NULL'}, {back or 'NULL'}, {ann})")
    return "w(window_id, code, kind, period, sessions, days, months, annualized) AS (VALUES " + ", ".join(rows) + ")"


_START = "CASE w.period WHEN 'day' THEN {d} WHEN 'week' THEN CAST(date_trunc('week', {d}) AS DATE) WHEN 'month' THEN CAST(date_trunc('month', {d}) AS DATE) WHEN 'quarter' THEN CAST(date_trunc('quarter', {d}) AS DATE) ELSE CAST(date_trunc('year', {d}) AS DATE) END"
#: every session and window with its endpoints, by as-of joins
ENDPOINTS = f"""
, {window_values()},
cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS i FROM calendar),
e0 AS (SELECT cal.session_date AS as_of_date, cal.i, w.*, CASE WHEN kind = 'period' THEN {_START.format(d='cal.session_date')} - 1 ELSE cal.session_date END AS end_target FROM cal CROSS JOIN w),
e1 AS (SELECT w.*, c.session_date AS end_date FROM e0 w ASOF LEFT JOIN cal c ON w.end_target >= c.session_date),
e2 AS (SELECT w.*, CAST(CASE WHEN kind = 'calendar' THEN {_START.format(d='as_of_date')} - 1 WHEN kind = 'trailing' AND days IS NOT NULL THEN as_of_date - CAST(days AS INTEGER)
    WHEN kind = 'trailing' THEN as_of_date - to_months(CAST(months AS INTEGER)) WHEN kind = 'period' THEN {_START.format(d='end_date')} - 1 END AS DATE) AS target FROM e1 w),
e3 AS (SELECT w.*, c.session_date AS snapped FROM e2 w ASOF LEFT JOIN cal c ON w.target >= c.session_date),
ends AS (SELECT w.as_of_date, w.window_id, w.code, w.kind, w.annualized, w.end_date,
    CASE WHEN w.kind = 'session' THEN s.session_date WHEN w.kind = 'inception' THEN NULL ELSE w.snapped END AS base_date
  FROM e3 w LEFT JOIN cal s ON s.i = w.i - w.sessions)"""

ADJUSTED = """
, factor AS (SELECT p.entity, p.session_date, coalesce(product(CAST(s.ratio AS DOUBLE)), 1) AS factor
  FROM prices p LEFT JOIN splits s ON s.entity = p.entity AND s.ex_date > p.session_date GROUP BY p.entity, p.session_date),
adjusted AS (SELECT p.*, f.factor, p.close / f.factor AS adj_close FROM prices p JOIN factor f USING (entity, session_date))"""
TRI = """
, paid AS (SELECT d.entity, p.session_date, sum(d.amount) AS dividend FROM dividends d ASOF JOIN prices p ON d.entity = p.entity AND d.ex_date <= p.session_date GROUP BY d.entity, p.session_date),
total AS (SELECT a.*, CASE WHEN count(d.dividend) OVER s = 0 THEN a.adj_close ELSE a.adj_close * exp(sum(coalesce(ln(1 + d.dividend / a.adj_close), 0)) OVER s) END AS tri
  FROM adjusted a LEFT JOIN paid d USING (entity, session_date) WINDOW s AS (PARTITION BY entity ORDER BY session_date))"""


def _series(prices, splits, dividends):
    return P.total_return_index(P.split_adjusted(prices, splits), dividends)


@query("bars_refused", "prices", "SELECT entity, session_date, CASE WHEN volume > 900 THEN 'outside high and low' ELSE 'negative volume' END AS reason FROM prices WHERE volume > 900 OR volume < 3")
def bars_refused(prices):
    # faults put in by rule: a close above high where much was sold, a negative volume where little was
    bars = prices.withColumn("close", F.when(F.col("volume") > 900, F.col("high") * 2).otherwise(F.col("close")))
    bars = bars.withColumn("volume", F.when(F.col("volume") < 3, -F.col("volume")).otherwise(F.col("volume")))
    return P.refused_bars(bars).select("entity", "session_date", "reason")


@query("price_gaps", "prices calendar", "SELECT f.entity, c.session_date FROM (SELECT entity, min(session_date) AS d FROM prices GROUP BY entity) f JOIN calendar c ON c.session_date >= f.d ANTI JOIN prices p ON p.entity = f.entity AND p.session_date = c.session_date")
def price_gaps(prices, calendar):
    return P.gaps(prices, calendar)


@query("split_adjusted", "prices splits", ADJUSTED + " SELECT entity, session_date, round(factor, 6) AS factor, round(adj_close, 6) AS adj_close FROM adjusted")
def split_adjusted(prices, splits):
    out = P.split_adjusted(prices, splits)
    return rounded(out.select("entity", "session_date", F.col("factor").cast("double").alias("factor"), "adj_close"))


@query("total_return_index", "prices splits dividends", ADJUSTED + TRI + " SELECT entity, session_date, round(tri, 6) AS tri FROM total")
def total_return_index(prices, splits, dividends):
    return rounded(_series(prices, splits, dividends).select("entity", "session_date", "tri"))


@query("daily_returns", "prices", "SELECT * FROM (SELECT entity, session_date, round(close / lag(close) OVER (PARTITION BY entity ORDER BY session_date) - 1, 8) AS ret FROM prices) x WHERE ret IS NOT NULL")
def daily_returns(prices):
    return rounded(P.daily_returns(prices), 8)


@query(
    "price_anomalies",
    "prices splits calendar",
    ADJUSTED
    + """, m AS (SELECT entity, session_date, adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY session_date) - 1 AS pct_move,
      NOT EXISTS (SELECT 1 FROM calendar c WHERE c.session_date = a.session_date AND day(c.session_date) <> 13) AS off_calendar FROM adjusted a)
    SELECT entity, session_date, CASE WHEN abs(pct_move) > 0.1 THEN 'price jump' ELSE 'non-trading day' END AS flag, round(pct_move, 6) AS pct_move, off_calendar
    FROM m WHERE abs(pct_move) > 0.1 OR off_calendar""",
)
def price_anomalies(prices, splits, calendar):
    return rounded(P.anomalies(prices, splits, calendar.where(F.day("session_date") != 13), 0.1))


MATRIX = """, first AS (SELECT entity, min(session_date) AS first_bar FROM prices GROUP BY entity),
m AS (SELECT t.entity, e.window_id, e.code, t.session_date AS as_of_date, CASE WHEN e.kind = 'inception' THEN f.first_bar ELSE e.base_date END AS base_date, e.end_date, e.annualized
  FROM total t JOIN ends e ON e.as_of_date = t.session_date JOIN first f USING (entity)),
v AS (SELECT m.*, b.adj_close AS bp, b.tri AS bt, x.adj_close AS ep, x.tri AS et, datediff('day', m.base_date, m.end_date) / 365.25 AS years
  FROM m LEFT JOIN total b ON b.entity = m.entity AND b.session_date = m.base_date LEFT JOIN total x ON x.entity = m.entity AND x.session_date = m.end_date),
mat AS (SELECT *, CASE WHEN NOT annualized THEN ep / bp - 1 WHEN years > 0 THEN pow(ep / bp, 1 / years) - 1 END AS pr, CASE WHEN NOT annualized THEN et / bt - 1 WHEN years > 0 THEN pow(et / bt, 1 / years) - 1 END AS tr FROM v)"""


@query("return_matrix", "prices calendar splits dividends", ADJUSTED + TRI + ENDPOINTS + MATRIX + " SELECT entity, CAST(window_id AS BIGINT) AS window_id, as_of_date, base_date, round(CASE WHEN pr IS NOT NULL THEN least(pr, 100) END, 6) AS pr, round(CASE WHEN tr IS NOT NULL THEN least(tr, 100) END, 6) AS tr FROM mat")
def return_matrix(prices, calendar, splits, dividends):
    out = R.return_matrix(_series(prices, splits, dividends), calendar, C.windows(prices.sparkSession))
    # the yearly rate of a few days' move has no digits to compare
    top = lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(100.0))).alias(c)
    return rounded(out.select("entity", "window_id", "as_of_date", "base_date", top("pr"), top("tr")))


@query(
    "return_matrix_gated",
    "prices calendar splits dividends flags",
    ADJUSTED + TRI + ENDPOINTS + MATRIX
    + """, g AS (SELECT mat.*, (a.entity IS NOT NULL OR b.entity IS NOT NULL OR x.entity IS NOT NULL) AS gated,
        EXISTS (SELECT 1 FROM dividends d JOIN flags y ON y.entity = d.entity AND y.session_date = d.ex_date WHERE d.entity = mat.entity AND d.ex_date > mat.base_date AND d.ex_date <= mat.end_date) AS tr_gated
      FROM mat LEFT JOIN flags a ON a.entity = mat.entity AND a.session_date = mat.as_of_date LEFT JOIN flags b ON b.entity = mat.entity AND b.session_date = mat.base_date
        LEFT JOIN flags x ON x.entity = mat.entity AND x.session_date = mat.end_date WHERE code IN ('1D', 'WTD', '1M', '3M', 'SI', 'PQ'))
    SELECT entity, code, as_of_date, gated, round(CASE WHEN NOT gated THEN pr END, 6) AS pr, round(CASE WHEN NOT gated AND NOT tr_gated THEN tr END, 6) AS tr FROM g""",
)
def return_matrix_gated(prices, calendar, splits, dividends, flags):
    wins = C.windows(prices.sparkSession, ["1D", "WTD", "1M", "3M", "SI", "PQ"])
    out = R.return_matrix(_series(prices, splits, dividends), calendar, wins, flags, dividends)
    return rounded(out.select("entity", "code", "as_of_date", "gated", "pr", "tr"))


@query(
    "risk_metrics",
    "prices calendar splits flags",
    ADJUSTED + ENDPOINTS
    + """, r AS (SELECT a.entity, a.session_date, CASE WHEN f.entity IS NULL AND lag(f.entity) OVER s IS NULL THEN adj_close / lag(adj_close) OVER s - 1 END AS r, f.entity IS NOT NULL AS flagged
        FROM adjusted a LEFT JOIN flags f ON f.entity = a.entity AND f.session_date = a.session_date WINDOW s AS (PARTITION BY a.entity ORDER BY a.session_date)),
    q AS (SELECT r.entity, e.window_id, e.code, r.session_date AS as_of_date, r.flagged, e.base_date, e.end_date FROM r JOIN ends e ON e.as_of_date = r.session_date
        WHERE e.code IN ('1M', '3M', '1Y') AND e.base_date IS NOT NULL),
    g AS (SELECT q.entity, q.code, q.as_of_date, q.flagged, count(x.r) AS n, stddev_samp(x.r) AS sd, avg(x.r) AS m FROM q LEFT JOIN r x ON x.entity = q.entity AND x.session_date > q.base_date AND x.session_date <= q.end_date GROUP BY ALL)
    SELECT entity, code, as_of_date, n AS n_obs, round(CASE WHEN NOT flagged AND sd > 1e-9 THEN sd * sqrt(252) END, 6) AS vol, round(CASE WHEN NOT flagged AND sd > 1e-9 THEN m / sd * sqrt(252) END, 4) AS sharpe FROM g""",
)
def risk_metrics(prices, calendar, splits, flags):
    wins = C.windows(prices.sparkSession, ["1M", "3M", "1Y"])
    out = R.risk_metrics(P.split_adjusted(prices, splits), calendar, wins, flags).join(F.broadcast(wins.select("window_id", "code")), "window_id")
    return rounded(out.select("entity", "code", "as_of_date", "n_obs", "vol", "sharpe"), sharpe=4)


@query(
    "extremes_52w",
    "prices splits flags",
    ADJUSTED
    + """, x AS (SELECT entity, session_date, adj_close, max(adj_close) OVER s AS h, min(adj_close) OVER s AS l FROM adjusted
        WINDOW s AS (PARTITION BY entity ORDER BY session_date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW)),
    y AS (SELECT x.*, (SELECT max(a.session_date) FROM adjusted a WHERE a.entity = x.entity AND a.adj_close = x.h AND a.session_date BETWEEN x.session_date - 365 AND x.session_date) AS hd,
        (SELECT max(a.session_date) FROM adjusted a WHERE a.entity = x.entity AND a.adj_close = x.l AND a.session_date BETWEEN x.session_date - 365 AND x.session_date) AS ld FROM x),
    g AS (SELECT y.*, EXISTS (SELECT 1 FROM flags f WHERE f.entity = y.entity AND f.session_date IN (y.session_date, y.hd, y.ld)) AS gated FROM y)
    SELECT entity, session_date AS as_of_date, gated, CASE WHEN NOT gated THEN hd END AS high_date, CASE WHEN NOT gated THEN ld END AS low_date,
      round(CASE WHEN NOT gated THEN h END, 6) AS high_52w, round(CASE WHEN NOT gated THEN adj_close / h - 1 END, 6) AS pct_off_high, round(CASE WHEN NOT gated THEN adj_close / l - 1 END, 6) AS pct_off_low FROM g""",
)
def extremes_52w(prices, splits, flags):
    out = R.extremes(P.split_adjusted(prices, splits), flags=flags)
    return rounded(out.select("entity", "as_of_date", "gated", "high_date", "low_date", "high_52w", "pct_off_high", "pct_off_low"))


@query(
    "forward_returns",
    "prices splits flags",
    ADJUSTED
    + """, h(horizon, d, m) AS (VALUES ('1W', 7, 0), ('1M', 0, 1), ('3M', 0, 3), ('6M', 0, 6), ('9M', 0, 9), ('1Y', 0, 12)),
    q AS (SELECT a.entity, a.session_date, a.adj_close, h.horizon, CAST(CASE WHEN d > 0 THEN a.session_date + d ELSE a.session_date + to_months(m) END AS DATE) AS due FROM adjusted a CROSS JOIN h),
    x AS (SELECT q.*, b.session_date AS fwd_date, b.adj_close AS fwd FROM q ASOF JOIN adjusted b ON b.entity = q.entity AND b.session_date >= q.due)
    SELECT x.entity, x.session_date AS as_of_date, x.horizon, x.fwd_date, round(CASE WHEN f.entity IS NULL AND g.entity IS NULL THEN fwd / adj_close - 1 END, 6) AS fwd_ret
    FROM x LEFT JOIN flags f ON f.entity = x.entity AND f.session_date = x.session_date LEFT JOIN flags g ON g.entity = x.entity AND g.session_date = x.fwd_date WHERE x.fwd_date <= x.due + 14""",
)
def forward_returns(prices, splits, flags):
    return rounded(R.forward_returns(P.split_adjusted(prices, splits), flags))


@query(
    "index_returns",
    "index_levels",
    """, w(code, m, y) AS (VALUES ('1M', 1, false), ('1Y', 12, false), ('2Y_ANN', 24, true)),
    q AS (SELECT i.region, i.session_date, i.level, w.*, CAST(i.session_date - to_months(m) AS DATE) AS target FROM index_levels i CROSS JOIN w),
    x AS (SELECT q.*, b.session_date AS base_date, b.level AS base FROM q ASOF JOIN index_levels b ON b.region = q.region AND q.target >= b.session_date)
    SELECT region, code, session_date AS as_of_date, round(CASE WHEN y THEN pow(level / base, 365.25 / datediff('day', base_date, session_date)) - 1 ELSE level / base - 1 END, 6) AS pr FROM x""",
)
def index_returns(levels):
    wins = C.windows(levels.sparkSession, ["1M", "1Y", "2Y_ANN"])
    return rounded(R.own_dates_matrix(levels, wins, "region", "level").where("pr is not null").select("region", "code", "as_of_date", "pr"))


@query(
    "alpha",
    "prices index_levels",
    """, a AS (SELECT p.entity, p.session_date AS as_of_date, p.close / b.close - 1 AS pr FROM (SELECT *, CAST(session_date - INTERVAL 3 MONTHS AS DATE) AS target FROM prices) p ASOF JOIN prices b ON b.entity = p.entity AND p.target >= b.session_date),
    i AS (SELECT p.session_date AS as_of_date, p.level / b.level - 1 AS pr FROM (SELECT *, CAST(session_date - INTERVAL 3 MONTHS AS DATE) AS target FROM index_levels WHERE region = 1) p ASOF JOIN index_levels b ON b.region = p.region AND p.target >= b.session_date)
    SELECT a.entity, a.as_of_date, round(a.pr - i.pr, 6) AS alpha FROM a JOIN i USING (as_of_date)""",
)
def alpha(prices, levels):
    wins = C.windows(prices.sparkSession, ["3M"])
    assets = R.own_dates_matrix(prices, wins, "entity", "close").where("pr is not null")
    index = R.own_dates_matrix(levels.where("region = 1"), wins, "region", "level").where("pr is not null")
    return rounded(R.alpha(assets, index).select("entity", "as_of_date", "alpha"))


@query(
    "plausibility_band",
    "closes",
    """, s AS (SELECT entity, session_date, close, row_number() OVER (PARTITION BY entity ORDER BY session_date) AS i FROM closes),
    fold AS (SELECT *, close AS prev, true AS accepted FROM s WHERE i = 1
      UNION ALL SELECT s.*, CASE WHEN abs(s.close - f.prev) <= 0.15 * abs(f.prev) THEN s.close ELSE f.prev END, abs(s.close - f.prev) <= 0.15 * abs(f.prev) FROM fold f JOIN s ON s.entity = f.entity AND s.i = f.i + 1)
    SELECT entity, session_date, round(close, 6) AS close, accepted FROM fold""",
)
def plausibility_band(closes):
    return rounded(P.plausible(closes.select("entity", "session_date", "close"), "entity", "session_date", "close", 0.15))


@query(
    "change_points",
    "label",
    "SELECT entity, quarter_start, label FROM (SELECT *, lag(label) OVER (PARTITION BY entity ORDER BY quarter_start) AS prev FROM label) x WHERE prev IS DISTINCT FROM label",
)
def change_points(label):
    return P.change_points(label, "entity", "quarter_start", "label")


@query("refetch_divergence", "prices", "SELECT entity, session_date, round(abs(close * 1.02 - close) / close, 8) AS diff FROM prices WHERE day(session_date) = 5")
def refetch_divergence(prices):
    again = prices.withColumn("close", F.when(F.day("session_date") == 5, F.col("close") * 1.02).otherwise(F.col("close") * 1.001))
    return rounded(P.divergence(prices, again, 0.01).select("entity", "session_date", "diff"), 8)


@query("rebalance_dates", "prices", "SELECT min(session_date) AS session_date FROM prices GROUP BY date_trunc('quarter', session_date)")
def rebalance_dates(prices):
    return C.period_firsts(prices, "quarter")
