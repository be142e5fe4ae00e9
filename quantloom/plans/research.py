"""Queries on factors, backtests and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import calendar as C
from ..operators import factors as Q
from ..operators import portfolio as PF
from ..operators import prices as P
from ..operators import returns as R
from ..operators import stats as ST
from . import market
from .market import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)
AS_OF = "1999-06-15"

DAILY = ", dr AS (SELECT * FROM (SELECT entity, session_date, close / lag(close) OVER (PARTITION BY entity ORDER BY session_date) - 1 AS ret FROM closes) x WHERE ret IS NOT NULL)"


def _own(code: str, months: int, name: str) -> str:
    return f""", {name} AS (SELECT p.entity, p.session_date AS as_of_date, p.close / b.close - 1 AS pr FROM (SELECT *, CAST(session_date - INTERVAL {months} MONTHS AS DATE) AS target FROM closes) p
      ASOF JOIN closes b ON b.entity = p.entity AND p.target >= b.session_date)"""


def _returns(closes, codes):
    return R.own_dates_matrix(closes, C.windows(closes.sparkSession, codes), "entity", "close").where("pr is not null")


MOM = _own("1Y", 12, "y") + _own("1M", 1, "m1") + f", raw AS (SELECT y.entity, (1 + y.pr) / (1 + m1.pr) - 1 AS raw FROM y JOIN m1 USING (entity, as_of_date) WHERE as_of_date = DATE '{AS_OF}')"


def _momentum(closes):
    return Q.momentum(AS_OF, _returns(closes, ["1Y", "1M"]))


@query("factor_momentum", "closes", MOM + " SELECT entity, round(raw, 6) AS raw FROM raw")
def factor_momentum(closes):
    return rounded(_momentum(closes))


@query("factor_volatility", "closes", DAILY + f" SELECT entity, round(stddev_samp(ret) * sqrt(252), 6) AS raw FROM dr WHERE session_date > DATE '{AS_OF}' - 365 AND session_date <= DATE '{AS_OF}' GROUP BY entity HAVING count(*) >= 60")
def factor_volatility(closes):
    return rounded(Q.volatility(AS_OF, P.daily_returns(closes)))


@query("factor_attention", "attention", "SELECT entity, round(avg(value) FILTER (obs_date > DATE '2024-01-25' - 7) / avg(value), 6) AS raw FROM attention WHERE obs_date > DATE '2024-01-25' - 30 AND obs_date <= DATE '2024-01-25' GROUP BY entity HAVING count(*) FILTER (obs_date > DATE '2024-01-25' - 7) >= 5 AND count(*) >= 15")
def factor_attention(attention):
    return rounded(Q.attention("2024-01-25", attention))


@query(
    "factor_sensitivity",
    "closes observation",
    DAILY
    + f""", o AS (SELECT obs_date, value / lag(value) OVER (ORDER BY obs_date) - 1 AS x FROM observation WHERE series_id = '5-LOW' AND obs_date > DATE '{AS_OF}' - 372 AND obs_date <= DATE '{AS_OF}')
    SELECT entity, round(abs(covar_samp(ret, x) / var_samp(x)), 8) AS raw FROM dr JOIN o ON o.obs_date = dr.session_date WHERE x IS NOT NULL AND obs_date > DATE '{AS_OF}' - 365 GROUP BY entity HAVING count(*) >= 60 AND var_samp(x) > 0""",
)
def factor_sensitivity(closes, observation):
    return rounded(Q.sensitivity(AS_OF, P.daily_returns(closes), observation.where("series_id = '5-LOW'")), 8)


SCORED = """, p AS (SELECT *, row_number() OVER (ORDER BY raw) - 1 AS i, count(*) OVER () AS n FROM raw),
b AS (SELECT max(raw) FILTER (i = CAST(floor(0.01 * n) AS BIGINT)) AS lo, max(raw) FILTER (i = least(n - 1, CAST(floor(0.99 * n) AS BIGINT))) AS hi FROM p),
wz AS (SELECT entity, CASE WHEN n < 5 THEN raw ELSE least(greatest(raw, lo), hi) END AS raw FROM p, b)"""


@query("factor_scores", "closes", MOM + SCORED + " SELECT entity, round(raw, 6) AS raw, round((raw - avg(raw) OVER ()) / nullif(stddev_pop(raw) OVER (), 0), 6) AS zscore, row_number() OVER (ORDER BY raw DESC, entity) AS rank, round((count(*) OVER () - row_number() OVER (ORDER BY raw DESC, entity)) / count(*) OVER (), 6) AS pctile FROM wz")
def factor_scores(closes):
    return rounded(Q.scores(_momentum(closes), "high"))


@query("factor_top", "closes", MOM + " SELECT entity, round(raw, 6) AS raw FROM raw ORDER BY raw DESC, entity LIMIT 5")
def factor_top(closes):
    return rounded(Q.top(Q.scores(_momentum(closes), "high"), 5).select("entity", "raw"))


SELECTED = (
    DAILY
    + _own("6M", 6, "h")
    + """, reb AS (SELECT min(session_date) AS rebalance_date FROM closes GROUP BY date_trunc('quarter', session_date)),
val AS (SELECT reb.rebalance_date, h.entity, h.pr AS value, count(*) OVER (PARTITION BY reb.rebalance_date) AS n FROM reb JOIN h ON h.as_of_date = reb.rebalance_date),
pick AS (SELECT rebalance_date, entity, value FROM val WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY rebalance_date ORDER BY value DESC, entity) <= 5),
held AS (SELECT rebalance_date, entity, 1.0 / count(*) OVER (PARTITION BY rebalance_date) AS weight FROM pick),
span AS (SELECT rebalance_date, lead(rebalance_date) OVER (ORDER BY rebalance_date) AS until FROM (SELECT DISTINCT rebalance_date FROM held)),
day AS (SELECT dr.session_date, s.rebalance_date, sum(weight * ret) / sum(abs(weight)) AS ret, sum(abs(weight)) AS gross FROM dr JOIN span s ON dr.session_date > s.rebalance_date AND dr.session_date <= coalesce(s.until, DATE '9999-12-31')
  JOIN held ON held.rebalance_date = s.rebalance_date AND held.entity = dr.entity GROUP BY ALL),
old AS (SELECT s.until AS rebalance_date, held.entity, held.weight FROM held JOIN span s USING (rebalance_date) WHERE s.until IS NOT NULL),
turn AS (SELECT rebalance_date, sum(abs(coalesce(held.weight, 0) - coalesce(old.weight, 0))) / 2 AS turnover FROM held FULL JOIN old USING (rebalance_date, entity) GROUP BY rebalance_date)"""
)


def _held(closes):
    dates = C.period_firsts(closes, "quarter").withColumnRenamed("session_date", "rebalance_date")
    value = _returns(closes, ["6M"]).select(F.col("as_of_date").alias("rebalance_date"), "entity", F.col("pr").alias("value")).join(F.broadcast(dates), "rebalance_date")
    roster = dates.crossJoin(F.broadcast(closes.select("entity").distinct()))
    return B.weights(B.selected(B.covered(value, roster, least=10, share=0.0), top_n=5))


@query("backtest_weights", "closes", SELECTED + " SELECT rebalance_date, entity, round(weight, 6) AS weight FROM held")
def backtest_weights(closes):
    return rounded(_held(closes))


@query("backtest_daily", "closes", SELECTED + " SELECT session_date, rebalance_date, round(ret, 8) AS ret, round(gross, 6) AS gross FROM day")
def backtest_daily(closes):
    return rounded(B.holding_returns(_held(closes), P.daily_returns(closes)), 8, gross=6)


@query("backtest_turnover", "closes", SELECTED + " SELECT rebalance_date, round(turnover, 6) AS turnover FROM turn")
def backtest_turnover(closes):
    return rounded(B.turnover(_held(closes)))


@query(
    "backtest_net",
    "closes",
    SELECTED
    + """, c AS (SELECT session_date, sum(turnover * 20 / 1e4) AS cost FROM (SELECT turnover, (SELECT min(session_date) FROM day d WHERE d.session_date >= turn.rebalance_date) AS session_date FROM turn) x GROUP BY session_date)
    SELECT day.session_date, round(ret, 8) AS ret, round(ret - coalesce(cost, 0), 8) AS net FROM day LEFT JOIN c USING (session_date)""",
)
def backtest_net(closes):
    held = _held(closes)
    return rounded(B.net_returns(B.holding_returns(held, P.daily_returns(closes)), held, 20), 8)


@query(
    "backtest_statistics",
    "closes",
    SELECTED
    + """, cv AS (SELECT session_date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY session_date)) AS curve FROM day), dd AS (SELECT curve / max(curve) OVER (ORDER BY session_date) - 1 AS drawdown FROM cv)
    SELECT count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1, 6) AS ann_return, round(stddev_pop(ret) * sqrt(252), 6) AS ann_vol,
      round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) AS sharpe, round(avg(ret) / stddev_pop(ret) * sqrt(count(*)), 6) AS t_stat, round((SELECT min(drawdown) FROM dd), 6) AS max_drawdown, abs(avg(ret) / stddev_pop(ret) * sqrt(count(*))) >= 3 AS passes FROM day""",
)
def backtest_statistics(closes):
    return rounded(B.statistics(B.holding_returns(_held(closes), P.daily_returns(closes))))


@query("backtest_moments", "closes", SELECTED + " SELECT count(*) AS n, round(avg(ret), 8) AS mean, round(stddev_pop(ret), 8) AS sd, round(sum(pow(ret - (SELECT avg(ret) FROM day), 3)) / count(*) / pow(stddev_pop(ret), 3), 4) AS skew, round(sum(pow(ret - (SELECT avg(ret) FROM day), 4)) / count(*) / pow(stddev_pop(ret), 4), 3) AS kurt FROM day")
def backtest_moments(closes):
    return rounded(ST.moments(B.holding_returns(_held(closes), P.daily_returns(closes))), 8, skew=4, kurt=3)


def _trials(closes):
    daily = P.daily_returns(closes)
    return daily.groupBy((F.col("entity") % 6).cast("int").alias("trial"), "session_date").agg(F.avg("ret").alias("ret"))


TRIALS = DAILY + ", tr AS (SELECT entity % 6 AS trial, session_date, avg(ret) AS ret FROM dr GROUP BY ALL)"


def _sharpe(n: str, s: str, q: str) -> str:
    return f"(CASE WHEN {q} / greatest({n}, 1) - pow({s} / greatest({n}, 1), 2) > 1e-24 THEN {s} / greatest({n}, 1) / sqrt({q} / greatest({n}, 1) - pow({s} / greatest({n}, 1), 2)) ELSE 0 END)"


@query(
    "overfit_pbo",
    "closes",
    TRIALS
    + f""", b AS (SELECT session_date, ntile(10) OVER (ORDER BY session_date) - 1 AS block FROM (SELECT DISTINCT session_date FROM tr)),
    c AS (SELECT trial, block, count(ret) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM tr JOIN b USING (session_date) GROUP BY ALL),
    h AS (SELECT row_number() OVER (ORDER BY list_filter(range(10), lambda i: (m >> i) & 1 = 1)) - 1 AS split, m FROM range(1024) r(m) WHERE bit_count(m) = 5),
    x AS (SELECT split, trial, sum(n) FILTER ((m >> block) & 1 = 1) AS ni, sum(s) FILTER ((m >> block) & 1 = 1) AS si, sum(q) FILTER ((m >> block) & 1 = 1) AS qi, sum(n) FILTER ((m >> block) & 1 = 0) AS no, sum(s) FILTER ((m >> block) & 1 = 0) AS so, sum(q) FILTER ((m >> block) & 1 = 0) AS qo FROM h, c GROUP BY split, trial),
    y AS (SELECT split, trial, {_sharpe('ni', 'si', 'qi')} AS inside, {_sharpe('no', 'so', 'qo')} AS outside, count(*) OVER (PARTITION BY split) AS k FROM x),
    z AS (SELECT split, min_by(trial, (-inside, trial)) AS best, any_value(k) AS k FROM y GROUP BY split),
    w AS (SELECT z.split, z.best, (count(*) FILTER (y.outside < o.outside) + (1 + count(*) FILTER (y.outside = o.outside)) / 2.0) / (any_value(z.k) + 1) AS w FROM z JOIN y o ON o.split = z.split AND o.trial = z.best JOIN y ON y.split = z.split GROUP BY z.split, z.best)
    SELECT split, CAST(best AS BIGINT) AS best, round(ln(w / (1 - w)), 6) AS logit FROM w""",
)
def overfit_pbo(closes):
    return rounded(ST.pbo(_trials(closes), 10))


#: the share of the normal law below x, by Simpson's rule from the mean
_NORMAL = "0.5 + (x / 2000) / 3 / sqrt(2 * pi()) * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x * i / 2000, 2) / 2))"


#: what the best of so many trials without skill is expected to reach, in standard deviations
_EXPECTED = " ".join(f"WHEN {n} THEN {ST.expected_max_sharpe(1.0, n)!r}" for n in range(2, 7))


@query(
    "overfit_deflated",
    "closes",
    TRIALS
    + f""", m AS (SELECT trial, count(ret) AS n, avg(ret) AS mean, stddev_pop(ret) AS sd FROM tr GROUP BY trial), k AS (SELECT trial, n, mean / sd AS sr, avg(pow((ret - mean) / sd, 3)) AS skew, avg(pow((ret - mean) / sd, 4)) AS kurt FROM m JOIN tr USING (trial) GROUP BY trial, n, mean, sd),
    t AS (SELECT k.*, (SELECT sqrt(var_samp(sr)) * CASE count(*) {_EXPECTED} END FROM k) AS bar FROM k ORDER BY sr DESC, trial LIMIT 1),
    z AS (SELECT trial, sr, (sr - bar) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS x FROM t)
    SELECT CAST(trial AS BIGINT) AS best, round(sr, 6) AS sharpe, round({_NORMAL}, 6) AS dsr FROM z, range(2001) r(i) GROUP BY trial, sr, x""",
)
def overfit_deflated(closes):
    found = ST.deflated_sharpe(_trials(closes))
    return rounded(closes.sparkSession.createDataFrame([(found["best"], found["sharpe"], found["dsr"])], "best int, sharpe double, dsr double"))


STICKY = (
    _own("6M", 6, "h")
    + """, reb AS (SELECT min(session_date) AS rebalance_date FROM closes GROUP BY date_trunc('quarter', session_date)),
    v AS (SELECT rebalance_date, list(entity ORDER BY pr DESC, entity) AS l FROM h JOIN reb ON h.as_of_date = reb.rebalance_date GROUP BY rebalance_date),
    d AS (SELECT *, row_number() OVER (ORDER BY rebalance_date) AS i FROM v),
    fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS longs, CAST([] AS BIGINT[]) AS shorts
      UNION ALL SELECT i, longs, list_concat(stay2, list_filter(o, lambda e: NOT list_contains(stay2, e))[1:4 - len(stay2)]) FROM (
        SELECT i, longs, o, list_filter(o[1:6], lambda e: list_contains(shorts, e))[1:4] AS stay2 FROM (
          SELECT i, longs, shorts, list_filter(list_reverse(l), lambda e: NOT list_contains(longs, e)) AS o FROM (
            SELECT i, l, shorts, list_concat(stay, list_filter(l, lambda e: NOT list_contains(stay, e))[1:4 - len(stay)]) AS longs FROM (
              SELECT d.i, d.l, fold.shorts, list_filter(d.l[1:6], lambda e: list_contains(fold.longs, e))[1:4] AS stay FROM fold JOIN d ON d.i = fold.i + 1))))),
    legs AS (SELECT i, unnest(longs) AS entity, 0.5 / len(longs) AS weight FROM fold UNION ALL SELECT i, unnest(shorts), -0.5 / len(shorts) FROM fold)"""
)


@query("sticky_legs", "closes", STICKY + " SELECT d.rebalance_date, CAST(entity AS BIGINT) AS entity, round(weight, 6) AS weight FROM legs JOIN d USING (i)")
def sticky_legs(closes):
    dates = C.period_firsts(closes, "quarter").withColumnRenamed("session_date", "rebalance_date")
    value = _returns(closes, ["6M"]).select(F.col("as_of_date").alias("rebalance_date"), "entity", F.col("pr").alias("value")).join(F.broadcast(dates), "rebalance_date")
    return rounded(B.weights(B.sticky_legs(value, 4, 4), "neutral"))


PORTFOLIO = (
    DAILY
    + """, st AS (SELECT portfolio_id, as_of_date, lead(as_of_date) OVER (PARTITION BY portfolio_id ORDER BY as_of_date) AS until FROM (SELECT DISTINCT portfolio_id, as_of_date FROM portfolio_weight)),
pd AS (SELECT st.portfolio_id, dr.session_date, sum(w.weight * dr.ret) / sum(abs(w.weight)) AS ret, sum(abs(w.weight)) / any_value(g.g) AS coverage FROM st JOIN dr ON dr.session_date > st.as_of_date AND (st.until IS NULL OR dr.session_date <= st.until)
  JOIN portfolio_weight w ON w.portfolio_id = st.portfolio_id AND w.as_of_date = st.as_of_date AND w.entity = dr.entity
  JOIN (SELECT portfolio_id, as_of_date, sum(abs(weight)) AS g FROM portfolio_weight GROUP BY ALL) g ON g.portfolio_id = st.portfolio_id AND g.as_of_date = st.as_of_date GROUP BY st.portfolio_id, dr.session_date, st.as_of_date),
series AS (SELECT * FROM pd WHERE coverage >= 0.4137)"""
)
BENCH = ", bench AS (SELECT session_date, level / lag(level) OVER (ORDER BY session_date) - 1 AS b FROM index_levels WHERE region = 2)"


def _series(closes, weights):
    return PF.daily_series(weights, P.daily_returns(closes), 0.4137)


@query("portfolio_series", "closes portfolio_weight", PORTFOLIO + " SELECT portfolio_id, session_date, round(ret, 8) AS ret, round(coverage, 6) AS coverage FROM series")
def portfolio_series(closes, weights):
    return rounded(_series(closes, weights), 8, coverage=6)


@query(
    "portfolio_performance",
    "closes portfolio_weight index_levels",
    PORTFOLIO + BENCH
    + """, j AS (SELECT s.*, b, ret - b AS x FROM series s JOIN bench USING (session_date) WHERE b IS NOT NULL AND session_date > DATE '1998-01-01')
    SELECT portfolio_id, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS twr, round(CASE WHEN count(*) >= 20 THEN pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1 END, 6) AS ann_return, round(CASE WHEN count(*) >= 20 THEN stddev_samp(ret) * sqrt(252) END, 6) AS ann_vol, round(CASE WHEN count(*) >= 20 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END, 5) AS sharpe,
      round(CASE WHEN count(*) >= 20 THEN covar_samp(ret, b) / var_samp(b) END, 5) AS beta, round(CASE WHEN count(*) >= 20 THEN (avg(ret) - covar_samp(ret, b) / var_samp(b) * avg(b)) * 252 END, 6) AS alpha, round(CASE WHEN count(*) >= 20 THEN corr(ret, b) END, 6) AS corr, round(CASE WHEN count(*) >= 20 THEN stddev_samp(x) * sqrt(252) END, 6) AS tracking_error, round(CASE WHEN count(*) >= 20 THEN avg(x) / stddev_samp(x) * sqrt(252) END, 5) AS information_ratio,
      round(CASE WHEN count(*) >= 20 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) END, 6) AS hit, round(CASE WHEN count(*) >= 20 THEN avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END) END, 6) AS batting, round(CASE WHEN count(*) >= 20 THEN avg(ret) FILTER (ret > 0) / -avg(ret) FILTER (ret < 0) END, 5) AS slugging FROM j GROUP BY portfolio_id""",
)
def portfolio_performance(closes, weights, levels):
    bench = P.daily_returns(levels.where("region = 2").select(F.col("region").alias("entity"), "session_date", F.col("level").alias("close")))
    return rounded(PF.performance(_series(closes, weights), bench, "1998-01-01"), 6, sharpe=5, beta=5, information_ratio=5, slugging=5)


@query(
    "portfolio_pnl",
    "closes portfolio_weight",
    PORTFOLIO
    + """, z AS (SELECT *, max(session_date) OVER (PARTITION BY portfolio_id) AS last FROM series WHERE session_date <= DATE '2000-08-20' AND session_date >= DATE '2000-01-01')
    SELECT portfolio_id, round((exp(coalesce(sum(ln(1 + ret)) FILTER (session_date = last), 0)) - 1) * 1e6, 2) AS day, round((exp(sum(ln(1 + ret)) FILTER (session_date >= date_trunc('month', last))) - 1) * 1e6, 2) AS mtd, round((exp(sum(ln(1 + ret))) - 1) * 1e6, 2) AS ytd FROM z GROUP BY portfolio_id""",
)
def portfolio_pnl(closes, weights):
    return rounded(PF.profit_and_loss(_series(closes, weights), "2000-08-20", 1e6), 2)


ATTRIBUTED = (
    _own("3M", 3, "r3")
    + """, n AS (SELECT as_of_date, count(*) AS n FROM r3 GROUP BY as_of_date), broad AS (SELECT max(as_of_date) AS d FROM n WHERE n.n >= 0.9 * (SELECT max(n) FROM n)),
lastv AS (SELECT w.* FROM portfolio_weight w WHERE as_of_date = (SELECT max(as_of_date) FROM portfolio_weight x WHERE x.portfolio_id = w.portfolio_id)),
parts AS (SELECT portfolio_id, lastv.entity, weight, pr, weight * pr AS contribution FROM lastv LEFT JOIN (SELECT entity, pr FROM r3, broad WHERE as_of_date = d) q USING (entity))"""
)


@query("attribution", "closes portfolio_weight", ATTRIBUTED + " SELECT portfolio_id, entity, round(weight, 6) AS weight, round(pr, 6) AS pr, round(contribution, 8) AS contribution FROM parts")
def attribution(closes, weights):
    return rounded(PF.attribution(weights, _returns(closes, ["3M"])), 6, contribution=8)


@query("attribution_by_sector", "closes portfolio_weight currency_of", ATTRIBUTED + " SELECT portfolio_id, ccy AS sector, round(sum(abs(weight)), 6) AS gross, round(sum(CASE WHEN pr IS NOT NULL THEN abs(weight) * pr END) / sum(CASE WHEN pr IS NOT NULL THEN abs(weight) END), 6) AS ret FROM parts JOIN currency_of USING (entity) GROUP BY ROLLUP (portfolio_id, ccy)")
def attribution_by_sector(closes, weights, currency_of):
    parts = PF.attribution(weights, _returns(closes, ["3M"]))
    return rounded(PF.sector_rollup(parts, currency_of.withColumnRenamed("ccy", "sector")))


@query("attribution_nested", "closes portfolio_weight currency_of", ATTRIBUTED + " SELECT portfolio_id, ccy AS sector, CAST(entity % 3 AS BIGINT) AS industry, round(sum(abs(weight)), 6) AS gross, round(sum(CASE WHEN pr IS NOT NULL THEN abs(weight) * pr END) / sum(CASE WHEN pr IS NOT NULL THEN abs(weight) END), 6) AS ret FROM parts JOIN currency_of USING (entity) GROUP BY ROLLUP (portfolio_id, ccy, entity % 3)")
def attribution_nested(closes, weights, currency_of):
    parts = PF.attribution(weights, _returns(closes, ["3M"]))
    return rounded(PF.sector_rollup(parts, currency_of.select("entity", F.col("ccy").alias("sector"), (F.col("entity") % 3).cast("long").alias("industry")), ("sector", "industry")))


@query("exposures", "portfolio_weight", "SELECT portfolio_id, as_of_date, round(sum(weight), 6) AS net, round(sum(abs(weight)), 6) AS gross, round(sum(greatest(weight, 0)), 6) AS long, round(sum(least(weight, 0)), 6) AS short, count(*) AS n FROM portfolio_weight GROUP BY ALL")
def exposures(weights):
    return rounded(PF.exposures(weights))


@query(
    "portfolio_live",
    "closes portfolio_weight",
    """, c AS (SELECT entity, max_by(close, session_date) AS close FROM closes GROUP BY entity), q AS (SELECT entity, close * (1 + entity / 1000.0) AS price, CAST(DATE '2001-12-01' - CAST(entity % 4 AS INTEGER) AS DATE) AS quoted_on FROM c WHERE entity % 6 <> 0),
    v AS (SELECT w.* FROM portfolio_weight w WHERE as_of_date = (SELECT max(as_of_date) FROM portfolio_weight x WHERE x.portfolio_id = w.portfolio_id))
    SELECT portfolio_id, round(sum(weight * (price / close - 1)) / sum(abs(weight)) FILTER (price IS NOT NULL), 6) AS ret, round(sum(abs(weight)) FILTER (price IS NOT NULL) / sum(abs(weight)), 6) AS coverage, min(quoted_on) AS oldest, CASE WHEN count(price) = 0 THEN 'none' WHEN max(datediff('day', quoted_on, DATE '2001-12-01')) <= 1 THEN 'live' WHEN max(datediff('day', quoted_on, DATE '2001-12-01')) <= 4 THEN 'delayed' ELSE 'stale' END AS worst
    FROM v LEFT JOIN c USING (entity) LEFT JOIN q USING (entity) GROUP BY portfolio_id""",
)
def portfolio_live(closes, weights):
    quotes = closes.groupBy("entity").agg(F.max_by("close", "session_date").alias("c")).where("entity % 6 <> 0")
    quotes = quotes.select("entity", (F.col("c") * (1 + F.col("entity") / 1000.0)).alias("price"), F.date_sub(F.lit("2001-12-01").cast("date"), (F.col("entity") % 4).cast("int")).alias("quoted_on"))
    return rounded(PF.live(weights, quotes, closes, "2001-12-01"))
