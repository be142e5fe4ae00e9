"""Queries on curves, boards and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as BD
from ..operators import portfolio as PF
from ..operators import quality as V
from ..operators import rates as X
from . import market
from .market import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)


def _curves(points):
    nominal = X.as_arrays(points, ["as_of_date"], "nominal")
    real = X.as_arrays(points, ["as_of_date"], "real_rate").withColumnRenamed("curve", "real_curve")
    return nominal.join(real, "as_of_date")


def _at(value: str, tenor: float | str) -> str:
    """A group's value at a tenor, between the points on either side."""
    low, high = f"FILTER (c.tenor <= {tenor})", f"FILTER (c.tenor >= {tenor})"
    lo, vlo, hi, vhi = f"max(c.tenor) {low}", f"max_by({value}, c.tenor) {low}", f"min(c.tenor) {high}", f"min_by({value}, c.tenor) {high}"
    return f"(CASE WHEN {lo} = {hi} THEN {vlo} ELSE {vlo} + ({vhi} - {vlo}) * ({tenor} - {lo}) / ({hi} - {lo}) END)"


@query("curve_interpolation", "curve_point", f"SELECT as_of_date, round({_at('nominal', 2.25)}, 8) AS v2, round({_at('nominal', 6.5)}, 8) AS v6, CAST(NULL AS DOUBLE) AS outside FROM curve_point c GROUP BY as_of_date")
def curve_interpolation(points):
    at = lambda t: X.at_tenor(F.col("curve"), F.lit(t))
    return rounded(_curves(points).select("as_of_date", at(2.25).alias("v2"), at(6.5).alias("v6"), at(7.5).alias("outside")), 8)


@query(
    "curve_spreads",
    "curve_point",
    f"SELECT as_of_date, round(({_at('nominal', 7)} - {_at('nominal', 2)}) * 100, 6) AS spread, round((2 * {_at('nominal', 4)} - {_at('nominal', 2)} - {_at('nominal', 7)}) * 100, 6) AS fly, round({_at('nominal', 5)} - {_at('real_rate', 5)}, 8) AS breakeven, round(({_at('nominal', 7)} - {_at('nominal', 4)}) * 100, 6) AS roll, round(({_at('nominal', 7)} - 3) * 300 + ({_at('nominal', 7)} - {_at('nominal', 4)}) * 100, 6) AS carry FROM curve_point c GROUP BY as_of_date",
)
def curve_spreads(points):
    c = F.col("curve")
    return rounded(_curves(points).select("as_of_date", X.spread_bp(c, 2, 7).alias("spread"), X.butterfly_bp(c, 2, 4, 7).alias("fly"), X.breakeven(c, F.col("real_curve"), 5).alias("breakeven"), X.roll_down_bp(c, 7, 3).alias("roll"), X.carry_and_roll_bp(c, 7, 3, F.lit(3.0)).alias("carry")), 6, breakeven=8)


@query(
    "curve_richness",
    "curve_point",
    f""", s AS (SELECT as_of_date, ({_at('nominal', 7)} - {_at('nominal', 2)}) * 100 AS v FROM curve_point c GROUP BY as_of_date), n AS (SELECT max_by(v, as_of_date) AS current FROM s)
    SELECT '2s7s' AS spread, round(max(current), 6) AS current, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(100 * avg(CASE WHEN v <= current THEN 1.0 ELSE 0 END), 4) AS percentile, count(v) AS n, round((max(current) - avg(v)) / stddev_pop(v), 6) AS zscore FROM s, n""",
)
def curve_richness(points):
    rows = _curves(points).select(F.lit("2s7s").alias("spread"), "as_of_date", X.spread_bp(F.col("curve"), 2, 7).alias("v")).where("v is not null")
    return rounded(X.richness(rows, ["spread"], "v"), 6, percentile=4)


_FLOWS = "(VALUES ('a', 1.0, 5.0), ('a', 2.0, 5.0), ('a', 3.0, 105.0), ('b', 7.0, 100.0), ('c', 9.0, 1.0)) AS f(leg, tenor, amount)"


@query(
    "curve_present_values",
    "curve_point",
    f", x AS (SELECT c.as_of_date, f.leg, f.tenor AS t, any_value(f.amount) AS amount, {_at('nominal', 'f.tenor')} AS z FROM curve_point c CROSS JOIN {_FLOWS} GROUP BY c.as_of_date, f.leg, f.tenor) "
    "SELECT as_of_date, leg, round(CASE WHEN count(*) = count(z) THEN sum(amount * exp(-z / 100 * t)) END, 6) AS pv, round(CASE WHEN count(*) = count(z) THEN sum(amount * exp(-(z - 0.01) / 100 * t)) - sum(amount * exp(-z / 100 * t)) END, 6) AS dv01 FROM x GROUP BY as_of_date, leg",
)
def curve_present_values(points):
    flows = points.sparkSession.sql("select leg, cast(tenor as double) as tenor, cast(amount as double) as amount from " + _FLOWS)
    return rounded(X.dv01(flows, X.as_arrays(points, ["as_of_date"], "nominal"), ["as_of_date"]).select("as_of_date", "leg", "pv", "dv01"))


@query("curve_as_of", "curve_point", "SELECT as_of_date, tenor, round(nominal, 8) AS value FROM curve_point WHERE as_of_date = (SELECT max(as_of_date) FROM curve_point WHERE as_of_date <= DATE '1999-07-20')")
def curve_as_of(points):
    rows = points.select(F.lit("x").alias("country"), "as_of_date", "tenor", F.col("nominal").alias("value"))
    return rounded(X.curve_as_of(rows, ["country"], "1999-07-20").drop("country"), 8)


@query(
    "curve_forward_gaps",
    "curve_point",
    """, a AS (SELECT *, CASE WHEN lag(tenor) OVER w IS NULL THEN nominal * tenor ELSE (nominal + lag(nominal) OVER w) / 2 * (tenor - lag(tenor) OVER w) END AS a FROM curve_point WINDOW w AS (PARTITION BY as_of_date ORDER BY tenor)),
    m AS (SELECT *, sum(a) OVER (PARTITION BY as_of_date ORDER BY tenor) / tenor AS mean FROM a) SELECT as_of_date, tenor, round(mean, 6) AS mean, round(abs(mean - real_rate), 6) AS gap FROM m WHERE abs(mean - real_rate) > 1""",
)
def curve_forward_gaps(points):
    return rounded(X.forward_spot_gaps(points.withColumnRenamed("real_rate", "value"), points.withColumnRenamed("nominal", "value"), 1.0).select("as_of_date", "tenor", "mean", "gap"))


@query(
    "series_cadence",
    "observation",
    """, g AS (SELECT series_id, obs_date, datediff('day', lag(obs_date) OVER (PARTITION BY series_id ORDER BY obs_date), obs_date) AS gap FROM observation WHERE year(obs_date) < 2001 OR series_id < '3'),
    r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) <= 10)
    SELECT series_id, max(obs_date) AS last, quantile_cont(gap, 0.5) AS median_gap, datediff('day', max(obs_date), DATE '2001-08-05') AS days_behind, datediff('day', max(obs_date), DATE '2001-08-05') > greatest(5, 2 * quantile_cont(gap, 0.5)) AS stale FROM r GROUP BY series_id""",
)
def series_cadence(observation):
    rows = observation.where((F.year("obs_date") < 2001) | (F.col("series_id") < "3"))
    return rounded(X.stale_by_cadence(rows, "series_id", "2001-08-05"))


def _board(spans: str, target: str, value: str, series: str, key: str) -> str:
    return f""", l AS (SELECT {key}, max(d) AS last_date, max_by(v, d) AS last_value FROM {series} GROUP BY {key}), s(code) AS (VALUES {spans}),
    t AS (SELECT l.*, code, CAST({target} AS DATE) AS target FROM l CROSS JOIN s), b AS (SELECT t.*, x.v AS base FROM t ASOF LEFT JOIN {series} x ON x.{key} = t.{key} AND t.target >= x.d)
    SELECT {key}, code, last_date, {value} FROM b"""


_IDX = ", lv AS (SELECT region, session_date AS d, level AS v FROM index_levels)"
_OBS = ", ob AS (SELECT series_id, obs_date AS d, value AS v FROM observation)"


@query("index_board", "index_levels", _IDX + _board("('5D'),('1M'),('3M'),('6M'),('1Y'),('2Y'),('3Y'),('5Y'),('10Y'),('MTD'),('QTD'),('YTD')", "CASE code WHEN 'MTD' THEN date_trunc('month', last_date) WHEN 'QTD' THEN date_trunc('quarter', last_date) WHEN 'YTD' THEN date_trunc('year', last_date) ELSE last_date - CASE code WHEN '5D' THEN 7 WHEN '1M' THEN 30 WHEN '3M' THEN 91 WHEN '6M' THEN 182 WHEN '1Y' THEN 365 WHEN '2Y' THEN 730 WHEN '3Y' THEN 1095 WHEN '5Y' THEN 1825 ELSE 3650 END END", "round(last_value / base - 1, 6) AS ret", "lv", "region"))
def index_board(levels):
    return rounded(BD.index_board(levels.withColumnRenamed("session_date", "obs_date"), "region"))


@query("commodity_board", "index_levels", _IDX + _board("('1W'),('1M'),('YTD'),('1Y')", "CASE code WHEN '1W' THEN last_date - 7 WHEN '1M' THEN last_date - 30 WHEN 'YTD' THEN CAST(date_trunc('year', last_date) AS DATE) - 1 ELSE last_date - INTERVAL 12 MONTHS END", "round((last_value / base - 1) * 100, 6) AS pct", "lv", "region"))
def commodity_board(levels):
    return rounded(BD.commodity_board(levels.withColumnRenamed("session_date", "obs_date"), "region"))


@query("macro_deltas", "observation", _OBS + _board("('1M'),('3M'),('12M'),('YTD')", "CASE code WHEN '1M' THEN last_date - INTERVAL 1 MONTH WHEN '3M' THEN last_date - INTERVAL 3 MONTHS WHEN '12M' THEN last_date - INTERVAL 12 MONTHS ELSE CAST(date_trunc('year', last_date) AS DATE) - 1 END", "round(last_value - base, 2) AS delta", "ob", "series_id"))
def macro_deltas(observation):
    return rounded(BD.macro_deltas(observation, "series_id"), 2)


@query("two_latest", "observation", "SELECT series_id, max(obs_date) FILTER (n = 1) AS last_date, round(max(value) FILTER (n = 1), 2) AS last_value, round(max(value) FILTER (n = 2), 2) AS previous, round(max(value) FILTER (n = 1) / max(value) FILTER (n = 2) - 1, 6) AS change FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS n FROM observation) x WHERE n <= 2 GROUP BY series_id")
def two_latest(observation):
    return rounded(BD.two_latest(observation, "series_id", "value"), 2, change=6)


@query("sparkline", "observation", "SELECT series_id, count(*) AS n, round(sum(value * k), 2) AS weighted FROM (SELECT *, 49 - row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS k FROM observation) x WHERE k >= 1 GROUP BY series_id")
def sparkline(observation):
    rows = BD.sparkline(observation, "series_id", "value")
    weighted = F.aggregate(F.transform("points", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("series_id", F.size("points").cast("long").alias("n"), weighted.alias("weighted")), 2)


@query("attention_rates", "attention", "SELECT entity, round(sum(value) FILTER (obs_date > DATE '2024-01-28' - 7 AND obs_date <= DATE '2024-01-28') / 7, 6) AS avg7, round(sum(value) FILTER (obs_date > DATE '2024-01-28' - 30 AND obs_date <= DATE '2024-01-28') / 30, 6) AS avg30, round((sum(value) FILTER (obs_date > DATE '2024-01-28' - 7 AND obs_date <= DATE '2024-01-28') / 7) / (sum(value) FILTER (obs_date > DATE '2024-01-28' - 30 AND obs_date <= DATE '2024-01-28') / 30), 6) AS spike FROM attention GROUP BY entity")
def attention_rates(attention):
    return rounded(BD.attention_rates(attention, "entity", "2024-01-28"))


_CAPS = ", cap AS (SELECT entity, c.close * f.shares AS market_cap_usd FROM (SELECT entity, max_by(close, session_date) AS close FROM closes GROUP BY entity) c JOIN (SELECT entity, max_by(shares, as_of_date) AS shares FROM fundamentals GROUP BY entity) f USING (entity))"


@query(
    "heat_map",
    "closes fundamentals currency_of",
    _CAPS
    + """, r AS (SELECT entity, close / lag(close) OVER (PARTITION BY entity ORDER BY session_date) - 1 AS pr, session_date FROM closes), l AS (SELECT entity, max_by(pr, session_date) AS pr FROM r GROUP BY entity),
    k AS (SELECT *, lpad(CAST(entity // 2 AS VARCHAR), 6, '0') AS issuer FROM cap)
    SELECT issuer, entity, ccy AS sector, round(market_cap_usd, 2) AS market_cap_usd, round(pr, 6) AS pr FROM k JOIN l USING (entity) JOIN currency_of USING (entity) QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY market_cap_usd DESC, entity) = 1""",
)
def heat_map(closes, fundamentals, currency_of):
    from ..operators.prices import daily_returns

    last = closes.groupBy("entity").agg(F.max_by("close", "session_date").alias("close"))
    shares = fundamentals.groupBy("entity").agg(F.max_by("shares", "as_of_date").alias("shares"))
    caps = last.join(shares, "entity").select("entity", (F.col("close") * F.col("shares")).alias("market_cap_usd"))
    pr = daily_returns(closes).groupBy("entity").agg(F.max_by("ret", "session_date").alias("pr"))
    names = currency_of.select("entity", F.concat(F.lit("XX"), F.lpad(F.floor(F.col("entity") / 2).cast("string"), 6, "0"), F.lit("0001")).alias("isin"), F.lit(None).cast("string").alias("figi"))
    return rounded(BD.heat_map(caps, pr, currency_of.withColumnRenamed("ccy", "sector"), names), 2, pr=6)


@query(
    "universe_coverage",
    "closes fundamentals currency_of",
    "SELECT ccy AS universe_id, count(*) AS members, count(p.entity) AS prices, count(f.entity) AS fundamentals FROM currency_of m LEFT JOIN (SELECT DISTINCT entity FROM closes WHERE session_date BETWEEN DATE '2000-02-10' - 2 AND DATE '2000-02-10') p USING (entity) LEFT JOIN (SELECT DISTINCT entity FROM fundamentals WHERE as_of_date BETWEEN DATE '2000-02-10' - 180 AND DATE '2000-02-10') f USING (entity) GROUP BY ccy",
)
def universe_coverage(closes, fundamentals, currency_of):
    layers = {"prices": (closes, "session_date", 2), "fundamentals": (fundamentals, "as_of_date", 180)}
    return rounded(BD.coverage(currency_of.withColumnRenamed("ccy", "universe_id"), layers, "2000-02-10"))


@query("broad_date", "closes", "SELECT max(session_date) AS session_date FROM (SELECT session_date, count(*) AS n FROM closes GROUP BY session_date) d WHERE n >= 0.9 * (SELECT max(n) FROM (SELECT count(*) AS n FROM closes GROUP BY session_date))")
def broad_date(closes):
    return PF.broad_date(closes, "session_date")


@query("freshness", "closes", "SELECT entity, max(session_date) AS last, datediff('day', max(session_date), DATE '2001-10-25') AS days_behind, CASE WHEN datediff('day', max(session_date), DATE '2001-10-25') > 4 THEN 'stale' WHEN datediff('day', max(session_date), DATE '2001-10-25') > 1 THEN 'late' ELSE 'ok' END AS status, count(*) AS n FROM closes GROUP BY entity")
def freshness(closes):
    return rounded(V.freshness(closes, ["entity"], "session_date", "2001-10-25"))


@query("partial_days", "observation", "SELECT entity, last, CASE WHEN n < 0.9 * m THEN prev ELSE last END AS shown, coalesce(n < 0.9 * m, false) AS partial FROM (SELECT entity, max(d) FILTER (k = 1) AS last, max(d) FILTER (k = 2) AS prev, max(n) FILTER (k = 1) AS n, max(n) FILTER (k = 2) AS m FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS k FROM (SELECT series_id AS entity, date_trunc('month', obs_date)::DATE AS d, count(*) AS n FROM observation GROUP BY ALL) a) b WHERE k <= 2 GROUP BY entity) c")
def partial_days(observation):
    rows = observation.select(F.col("series_id").alias("entity"), F.trunc("obs_date", "month").alias("d"))
    return V.partial_days(rows, ["entity"], "d")


@query("orphans", "attention closes", "SELECT DISTINCT entity, 'fail' AS severity FROM (SELECT entity + 10 AS entity FROM attention) a WHERE entity NOT IN (SELECT entity FROM closes)")
def orphans(attention, closes):
    return V.orphans(attention.select((F.col("entity") + 10).alias("entity")), closes.select(F.col("entity").cast("long").alias("entity")).distinct(), ["entity"])


@query("completeness", "currency_of closes fundamentals", "SELECT entity, 'prices' AS layer, 'fail' AS severity FROM currency_of WHERE entity NOT IN (SELECT entity FROM closes WHERE session_date = DATE '1999-03-05') UNION ALL SELECT entity, 'fundamentals', 'warn' FROM currency_of WHERE entity NOT IN (SELECT entity FROM fundamentals WHERE shares > 60000)")
def completeness(currency_of, closes, fundamentals):
    return V.completeness(currency_of, {"prices": (closes.where("session_date = '1999-03-05'"), "fail"), "fundamentals": (fundamentals.where("shares > 60000"), "warn")})


@query("ticker_collisions", "label", "SELECT label AS ticker, mic, n, 'fail' AS severity FROM (SELECT label, CAST(entity % 3 AS VARCHAR) AS mic, count(DISTINCT entity) AS n FROM label WHERE quarter_start = DATE '2000-01-01' GROUP BY ALL) x WHERE n > 1")
def ticker_collisions(label):
    rows = label.where("quarter_start = '2000-01-01'").select(F.col("label").alias("ticker"), (F.col("entity") % 3).cast("string").alias("mic"), F.col("entity").alias("figi"), F.lit(None).cast("date").alias("valid_to"))
    return rounded(V.ticker_collisions(rows))


@query("readiness", "currency_of closes", "SELECT ccy AS universe_id, count(*) AS members, count(r.entity) AS ready, round(count(r.entity) / count(*), 6) AS share, CASE WHEN count(r.entity) / count(*) < 0.75 THEN 'fail' ELSE 'pass' END AS severity FROM currency_of LEFT JOIN (SELECT DISTINCT entity FROM closes WHERE session_date = DATE '1999-03-05') r USING (entity) GROUP BY ccy")
def readiness(currency_of, closes):
    rows = closes.where("session_date = '1999-03-05'").select("entity", F.col("close").alias("pr"))
    return rounded(V.readiness(currency_of.withColumnRenamed("ccy", "universe_id"), rows, 0.75))


@query("index_reconcile", "index_levels", "SELECT region, session_date, round(abs(1 / (1 + (region - 2) / 10000.0 * (1 + day(session_date) % 3)) - 1) * 1e4, 4) AS bps, CASE WHEN abs(region - 2) * (1 + day(session_date) % 3) >= 5 THEN 'fail' WHEN abs(region - 2) * (1 + day(session_date) % 3) >= 2 THEN 'warn' ELSE 'pass' END AS severity FROM index_levels")
def index_reconcile(levels):
    official = levels.withColumn("level", F.col("level") * (1 + (F.col("region") - 2) / 10000.0 * (1 + F.day("session_date") % 3)))
    return rounded(V.level_differences(levels, official, 1.5, 4.5).select("region", "session_date", "bps", "severity"), 4)


@query("action_agreement", "dividends", "SELECT entity, ex_date, 'dividend' AS action_type, CASE WHEN entity % 8 = 0 AND month(ex_date) > 6 THEN 'only ours' WHEN entity % 4 = 2 THEN 'differ' ELSE 'agree' END AS verdict FROM dividends")
def action_agreement(dividends):
    ours = dividends.select("entity", "ex_date", F.lit("dividend").alias("action_type"), F.col("amount").alias("value"))
    theirs = ours.where("not (entity % 8 = 0 and month(ex_date) > 6)").withColumn("value", F.col("value") * F.when(F.col("entity") % 4 == 2, 1.02).otherwise(1.001))
    return V.action_agreement(ours, theirs)
