"""Queries on foreign exchange, and on returns and capitalisations in dollars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import calendar as C
from ..operators import fx as X
from ..operators import returns as R
from . import market
from .market import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)
SOURCES = ("first", "second")

#: the best rate of each day, and a resolution of asks by it
BEST = ", best AS (SELECT ccy, as_of_date AS observed, rate FROM fx_rate QUALIFY row_number() OVER (PARTITION BY ccy, as_of_date ORDER BY source) = 1)"


def _resolved(asks: str, out: str = "resolved") -> str:
    return f""", {out} AS (SELECT x.* EXCLUDE (observed, rate), CASE WHEN x.ccy = 'USD' THEN x.as_of_date ELSE observed END AS observed,
      CASE WHEN x.ccy = 'USD' THEN 1.0 WHEN datediff('day', observed, x.as_of_date) <= 7 THEN rate END AS rate,
      CASE WHEN x.ccy = 'USD' THEN 'ok' WHEN observed IS NULL THEN 'no_data' WHEN datediff('day', observed, x.as_of_date) > 7 THEN 'stale' ELSE 'ok' END AS status
      FROM (SELECT a.*, b.observed, b.rate FROM {asks} a ASOF LEFT JOIN best b ON b.ccy = a.ccy AND a.as_of_date >= b.observed) x)"""


@query("fx_resolve", "calendar currency_of fx_rate", BEST + ", asks AS (SELECT DISTINCT ccy, session_date AS as_of_date FROM calendar CROSS JOIN currency_of)" + _resolved("asks") + " SELECT ccy, as_of_date, status, round(rate, 8) AS rate, datediff('day', observed, as_of_date) AS days_stale FROM resolved")
def fx_resolve(calendar, currency_of, rates):
    asks = currency_of.select("ccy").distinct().crossJoin(F.broadcast(calendar.withColumnRenamed("session_date", "as_of_date")))
    return rounded(X.resolve(asks, rates, SOURCES).select("ccy", "as_of_date", "status", "rate", "days_stale"), 8)


@query(
    "fx_convert",
    "closes currency_of fx_rate",
    BEST
    + """, asks AS (SELECT c.entity, c.session_date AS as_of_date, c.close AS amount, a.ccy AS from_ccy, b.ccy AS to_ccy FROM closes c JOIN currency_of a USING (entity) JOIN currency_of b ON b.entity = (c.entity + 7) % 25),
    f AS (SELECT *, from_ccy AS ccy FROM asks)"""
    + _resolved("f", "f2")
    + ", t AS (SELECT * EXCLUDE (ccy, observed, rate, status), to_ccy AS ccy, observed AS from_observed, rate AS from_rate FROM f2)"
    + _resolved("t", "t2")
    + """ SELECT entity, as_of_date, round(CASE WHEN from_ccy = to_ccy THEN amount WHEN from_ccy = 'USD' OR to_ccy = 'USD' OR abs(datediff('day', from_observed, observed)) <= 3 THEN amount * rate / from_rate END, 6) AS converted FROM t2""",
)
def fx_convert(closes, currency_of, rates):
    to = currency_of.select(((F.col("entity") + 18) % 25).alias("entity"), F.col("ccy").alias("to_ccy"))
    asks = closes.select("entity", F.col("session_date").alias("as_of_date"), F.col("close").alias("amount"))
    asks = asks.join(currency_of.withColumnRenamed("ccy", "from_ccy"), "entity").join(to, "entity")
    return rounded(X.convert(asks, rates, SOURCES).select("entity", "as_of_date", "converted"))


@query(
    "fx_daily",
    "fx_rate",
    BEST
    + """, d AS (SELECT ccy, CAST(unnest(generate_series(min(observed), max(observed), INTERVAL 1 DAY)) AS DATE) AS day FROM best GROUP BY ccy)
    SELECT d.ccy, d.day, round(b.rate, 8) AS rate, b.observed < d.day AS is_filled FROM d ASOF JOIN best b ON b.ccy = d.ccy AND d.day >= b.observed
    WHERE isodow(d.day) < 6 AND datediff('day', b.observed, d.day) <= 7""",
)
def fx_daily(rates):
    best = rates.groupBy("ccy", "as_of_date").agg(F.min_by("rate", "source").alias("rate"))
    return rounded(X.daily_filled(best), 8)


@query("fx_divergence", "fx_rate", "SELECT a.ccy, a.as_of_date, round(abs(b.rate / a.rate - 1), 6) AS diff FROM fx_rate a JOIN fx_rate b ON a.ccy = b.ccy AND a.as_of_date = b.as_of_date AND a.source < b.source WHERE abs(b.rate / a.rate - 1) > 0.25")
def fx_divergence(rates):
    return rounded(X.source_divergence(rates, 0.25).select("ccy", "as_of_date", "diff"))


@query(
    "fx_matrix",
    "fx_rate",
    BEST
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY ccy ORDER BY observed DESC) AS n FROM best WHERE observed <= DATE '2000-05-20'),
    c AS (SELECT ccy, max(rate) FILTER (n = 1) AS now, max(rate) FILTER (n = 2) AS before, max(observed) AS seen FROM r WHERE n <= 2 GROUP BY ccy UNION ALL SELECT 'USD', 1, 1, DATE '2000-05-20')
    SELECT a.ccy AS base, b.ccy AS quote, round(b.now / a.now, 6) AS rate, round(b.now / a.now / (b.before / a.before) - 1, 6) AS change,
      datediff('day', least(a.seen, b.seen), DATE '2000-05-20') AS days_stale, CASE WHEN a.ccy = 'USD' THEN true WHEN b.ccy = 'USD' THEN false ELSE a.ccy < b.ccy END AS conventional
    FROM c a JOIN c b ON a.ccy <> b.ccy""",
)
def fx_matrix(rates):
    return rounded(X.cross_matrix(rates, "2000-05-20", SOURCES))


@query("fx_both_directions", "fx_rate", BEST + " SELECT 'USD' AS base, ccy AS quote, observed AS as_of_date, round(rate, 8) AS rate FROM best UNION ALL SELECT ccy, 'USD', observed, round(1 / rate, 8) FROM best")
def fx_both_directions(rates):
    return rounded(X.both_directions(rates.groupBy("ccy", "as_of_date").agg(F.min_by("rate", "source").alias("rate"))), 8)


@query("fx_rebased", "fx_rate", BEST + " SELECT a.ccy, a.observed AS as_of_date, round(a.rate / p.rate, 8) AS rate FROM best a JOIN best p USING (observed) WHERE p.ccy = 'ASIA' AND a.ccy <> 'ASIA' UNION ALL SELECT 'BASE', observed, round(1 / rate, 8) FROM best WHERE ccy = 'ASIA'")
def fx_rebased(rates):
    return rounded(X.rebased(rates.groupBy("ccy", "as_of_date").agg(F.min_by("rate", "source").alias("rate")), "ASIA", "BASE"), 8)


@query(
    "returns_in_dollars",
    "closes currency_of fx_rate",
    BEST
    + """, m AS (SELECT p.entity, p.session_date AS as_of_date, b.session_date AS base_date, p.close / b.close - 1 AS pr, y.ccy FROM (SELECT *, CAST(session_date - INTERVAL 1 YEAR AS DATE) AS target FROM closes) p
        ASOF JOIN closes b ON b.entity = p.entity AND p.target >= b.session_date JOIN currency_of y ON y.entity = p.entity),
    f AS (SELECT entity, ccy, as_of_date AS shown, base_date, pr, base_date AS as_of_date FROM m)"""
    + _resolved("f", "f2")
    + ", t AS (SELECT entity, ccy, shown, pr, base_date, rate AS base_rate, shown AS as_of_date FROM f2)"
    + _resolved("t", "t2")
    + " SELECT entity, shown AS as_of_date, round((1 + pr) * base_rate / rate - 1, 6) AS pr_usd FROM t2",
)
def returns_in_dollars(closes, currency_of, rates):
    wins = C.windows(closes.sparkSession, ["1Y"])
    series = closes.select("entity", "session_date", F.col("close").alias("adj_close"), F.col("close").alias("tri"))
    own = R.own_dates_matrix(series, wins, "entity", "adj_close").where("pr is not null")
    base = A.asof_backward(own.withColumn("target", F.add_months("as_of_date", -12)), closes.select("entity", "session_date"), ["entity"], "target", "session_date", []).withColumnRenamed("matched_date", "base_date")
    asks = base.select("entity", "as_of_date", "base_date", "pr").join(currency_of, "entity").withColumnRenamed("as_of_date", "end_date")
    for side in ("base", "end"):
        asks = X.resolve(asks.withColumnRenamed(f"{side}_date", "as_of_date"), rates, SOURCES).withColumnsRenamed({"as_of_date": f"{side}_date", "rate": f"{side}_rate"}).drop("observed", "days_stale", "status", "is_filled")
    # rates are units for a dollar: dollars for a unit are their inverses
    value = R.restated(F.col("pr"), 1 / F.col("base_rate"), 1 / F.col("end_rate"), F.lit(False), F.lit(365.0))
    return rounded(asks.select("entity", F.col("end_date").alias("as_of_date"), value.alias("pr_usd")))


@query(
    "market_caps",
    "closes fundamentals currency_of fx_rate calendar",
    BEST
    + """, a0 AS (SELECT y.entity, y.ccy, max(session_date) AS as_of_date FROM calendar CROSS JOIN currency_of y GROUP BY y.entity, y.ccy, date_trunc('month', session_date)),
    a1 AS (SELECT a.*, CASE WHEN datediff('day', c.session_date, a.as_of_date) <= 30 THEN c.close END AS close FROM a0 a ASOF LEFT JOIN closes c ON c.entity = a.entity AND a.as_of_date >= c.session_date),
    a2 AS (SELECT a.*, f.shares FROM a1 a ASOF LEFT JOIN fundamentals f ON f.entity = a.entity AND a.as_of_date >= f.as_of_date)"""
    + _resolved("a2")
    + " SELECT entity, as_of_date, status, round(close * shares, 2) AS market_cap_lcy, round(close * shares / rate, 2) AS market_cap_usd FROM resolved",
)
def market_caps(closes, fundamentals, currency_of, rates, calendar):
    ends = calendar.groupBy(F.trunc("session_date", "month").alias("m")).agg(F.max("session_date").alias("as_of_date")).drop("m")
    asks = currency_of.select("entity").crossJoin(F.broadcast(ends))
    out = X.market_caps(asks, closes, fundamentals, rates, currency_of, SOURCES)
    return rounded(out.select("entity", "as_of_date", "status", "market_cap_lcy", "market_cap_usd"), 2)
