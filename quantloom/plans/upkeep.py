"""Queries on upkeep: vectors, identities, reviews, checks, vendor texts, live boards, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import boards as BD
from ..operators import calendar as C
from ..operators import factors as Q
from ..operators import fx as X
from ..operators import identity as I
from ..operators import merge as M
from ..operators import prices as P
from ..operators import quality as V
from ..operators import returns as R
from ..operators import scd as S
from ..operators import universe as U
from ..sources import parsers as T
from . import market
from .currencies import BEST, SOURCES
from .market import ADJUSTED, ENDPOINTS, rounded
from .membership import INTERVALS, SCD, _events
from .research import AS_OF, DAILY, _held, _own, _returns, SELECTED
from .records import CAPS, _caps

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)


@query("replace_vector", "portfolio_weight", ", l AS (SELECT portfolio_id, max(as_of_date) AS as_of_date FROM portfolio_weight GROUP BY portfolio_id) SELECT portfolio_id, as_of_date, entity, round(weight, 6) AS weight FROM portfolio_weight ANTI JOIN l USING (portfolio_id, as_of_date) UNION ALL SELECT portfolio_id, as_of_date, entity, round(weight * 2, 6) FROM portfolio_weight JOIN l USING (portfolio_id, as_of_date) WHERE entity % 2 = 0")
def replace_vector(weights):
    last = weights.groupBy("portfolio_id").agg(F.max("as_of_date").alias("as_of_date"))
    fresh = weights.where("entity % 2 = 0").join(last, ["portfolio_id", "as_of_date"]).withColumn("weight", F.col("weight") * 2).select(*weights.columns)
    return rounded(M.replace_vector(weights, fresh, ["portfolio_id", "as_of_date"]))


@query("append_events", "membership_event", ", k AS (SELECT raw_identifier, effective_date, change, universe_id, min(event_id) AS e FROM membership_event WHERE event_id % 3 = 0 GROUP BY ALL), n AS (SELECT k.* FROM k ANTI JOIN (SELECT * FROM membership_event WHERE event_id % 3 <> 0) m USING (raw_identifier, effective_date, change, universe_id)) SELECT raw_identifier, effective_date, change, universe_id, row_number() OVER (ORDER BY raw_identifier, effective_date, change, universe_id) + (SELECT max(event_id) FROM membership_event WHERE event_id % 3 <> 0) AS event_id FROM n")
def append_events(events):
    key = ["raw_identifier", "effective_date", "change", "universe_id"]
    out = M.append_events(events.where("event_id % 3 <> 0").select("event_id", *key), events.where("event_id % 3 = 0").select("event_id", *key), key)
    return rounded(out)


@query("projection_differences", "closes", "SELECT entity, session_date, CASE WHEN (entity + day(session_date)) % 7 = 0 THEN 'recomputed only' ELSE 'stored only' END AS side FROM closes WHERE ((entity + day(session_date)) % 7 = 0) <> (entity % 5 = 1)")
def projection_differences(closes):
    keys = closes.select("entity", "session_date")
    return V.projection_differences(keys.where((F.col("entity") + F.day("session_date")) % 7 != 0), keys.where("entity % 5 <> 1"))


@query("off_calendar", "closes calendar", "SELECT entity, session_date, 'warn' AS severity FROM closes WHERE day(session_date) = 13")
def off_calendar(closes, calendar):
    return V.off_calendar(closes, calendar.where(F.day("session_date") != 13))


_SYMBOLS = ", o AS (SELECT entity, ccy, 'T' || CAST(entity AS VARCHAR) AS ticker FROM currency_of)"


@query(
    "symbology_transitions",
    "currency_of",
    _SYMBOLS
    + """ SELECT CAST(entity AS VARCHAR) AS figi, CASE entity % 5 WHEN 0 THEN 'T' || CAST((entity + 5) % 25 AS VARCHAR) WHEN 1 THEN ticker ELSE 'N' || CAST(entity AS VARCHAR) END AS ticker,
      CASE WHEN entity % 5 = 0 AND EXISTS (SELECT 1 FROM currency_of x WHERE x.entity = (o.entity + 5) % 25 AND x.ccy = o.ccy AND x.entity <> o.entity) THEN 'collision'
        WHEN entity % 5 = 1 THEN 'unchanged' WHEN entity % 5 = 2 THEN 'refused_later' WHEN entity % 5 = 3 THEN 'update' ELSE 'close_insert' END AS action FROM o""",
)
def symbology_transitions(currency_of):
    figi, k = F.col("entity").cast("string"), F.col("entity") % 5
    since = F.lit("2000-01-10").cast("date")
    held = currency_of.select(figi.alias("figi"), F.concat(F.lit("T"), figi).alias("ticker"), F.col("ccy").alias("mic"), since.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    ticker = F.when(k == 0, F.concat(F.lit("T"), ((F.col("entity") + 5) % 25).cast("string"))).when(k == 1, F.concat(F.lit("T"), figi)).otherwise(F.concat(F.lit("N"), figi))
    new = currency_of.select(figi.alias("figi"), ticker.alias("ticker"), F.col("ccy").alias("mic"), F.date_add(since, F.when(k == 2, -1).when(k == 3, 0).otherwise(1)).alias("valid_from"))
    return S.symbology_transition(held, new).select("figi", "ticker", "action")


@query("best_opinion", "label", SCD + ", o AS (SELECT entity, label, 'b' AS source FROM h WHERE valid_to IS NULL UNION ALL SELECT entity, upper(label) || '!', CASE WHEN entity % 2 = 0 THEN 'a' ELSE 'c' END FROM h WHERE valid_to IS NULL) SELECT entity, label AS value, source FROM o QUALIFY row_number() OVER (PARTITION BY entity ORDER BY source, label) = 1")
def best_opinion(label):
    rows = S.from_history(label, "entity", "quarter_start", "label").withColumnRenamed("label", "value")
    other = rows.select("entity", F.concat(F.upper("value"), F.lit("!")).alias("value"), "valid_from", "valid_to", F.when(F.col("entity") % 2 == 0, "a").otherwise("c").alias("source"))
    return S.best_opinion(rows.withColumn("source", F.lit("b")).unionByName(other), "entity", lambda s: F.ascii(s)).select("entity", "value", "source")


@query("name_history", "label", ", q AS (SELECT entity, quarter_start, 'Name ' || CAST(year(quarter_start) // 2 AS VARCHAR) AS name FROM label), c AS (SELECT *, lag(name) OVER (PARTITION BY entity ORDER BY quarter_start) AS p FROM q) SELECT entity, name, quarter_start AS valid_from, lead(quarter_start) OVER (PARTITION BY entity ORDER BY quarter_start) AS valid_to FROM c WHERE p IS DISTINCT FROM name")
def name_history(label):
    names = label.select("entity", "quarter_start", F.concat(F.lit("Name "), F.floor(F.year("quarter_start") / 2).cast("string")).alias("name"))
    return S.from_history(names, "entity", "quarter_start", "name")


@query("upgraded", "currency_of", "SELECT entity, CASE WHEN entity % 4 > entity % 3 THEN 'new' WHEN entity % 2 = 0 THEN 'old' END AS figi, CASE WHEN entity % 2 = 0 THEN greatest(entity % 3, entity % 4) ELSE entity % 4 END AS quality FROM (SELECT * FROM currency_of WHERE entity % 2 = 0) x UNION ALL SELECT entity, 'new', entity % 4 FROM currency_of WHERE entity % 2 = 1")
def upgraded(currency_of):
    stored = currency_of.where("entity % 2 = 0").select("entity", F.lit("old").alias("figi"), (F.col("entity") % 3).cast("int").alias("quality"))
    fresh = currency_of.select("entity", F.lit("new").alias("figi"), (F.col("entity") % 4).cast("int").alias("quality"))
    return rounded(I.upgraded(stored, fresh, ["entity"]))


@query("review_outcomes", "label", ", q AS (SELECT entity, quarter_start, year(quarter_start) < 1994 AS reviewed FROM label), v AS (SELECT entity, quarter_start, count(DISTINCT verdict) AS n, max(verdict) AS verdict FROM (SELECT entity, quarter_start, 'confirmed' AS verdict FROM label WHERE entity % 2 = 0 UNION ALL SELECT entity, quarter_start, 'rejected' FROM label WHERE entity % 3 = 0) x GROUP BY ALL) SELECT entity, quarter_start, CASE WHEN reviewed THEN 'closed' WHEN n IS NULL THEN 'open' WHEN n > 1 THEN 'ambiguous' ELSE verdict END AS outcome FROM q LEFT JOIN v USING (entity, quarter_start)")
def review_outcomes(label):
    queue = label.select("entity", "quarter_start", (F.year("quarter_start") < 1994).alias("reviewed"))
    say = lambda k, word: label.where(F.col("entity") % k == 0).select("entity", "quarter_start", F.lit(word).alias("verdict"))
    return I.resolve_review(queue, say(2, "confirmed").unionByName(say(3, "rejected")), ["entity", "quarter_start"]).drop("reviewed")


@query("lifecycle", "currency_of", "SELECT entity, CASE WHEN entity % 3 = 0 THEN 'delisted' WHEN entity % 3 = 1 THEN 'active' ELSE 'suspended' END AS status, CASE WHEN entity % 3 = 0 THEN DATE '2001-05-06' WHEN entity % 3 = 2 THEN DATE '1999-01-01' END AS delisted_on FROM currency_of")
def lifecycle(currency_of):
    dim = currency_of.select("entity", F.lit("suspended").alias("status"), F.lit("1999-01-01").cast("date").alias("delisted_on"))
    changes = currency_of.where("entity % 3 < 2").select("entity", F.when(F.col("entity") % 3 == 0, "delisted").otherwise("active").alias("status"), F.lit("2001-05-06").cast("date").alias("on_date"))
    return I.set_status(dim, changes)


@query("instrument_spine", "membership_event", "SELECT scheme, external_id, sym_id IS NULL AS fresh, sym_id FROM (SELECT DISTINCT 'figi' AS scheme, figi AS external_id, CASE WHEN CAST(substr(figi, 2) AS INTEGER) < 20 THEN CAST(substr(figi, 2) AS BIGINT) END AS sym_id FROM membership_event) x")
def instrument_spine(events):
    known = events.select(F.lit("figi").alias("scheme"), F.col("figi").alias("external_id"), F.substring("figi", 2, 9).cast("long").alias("sym_id")).where("sym_id < 20").distinct()
    out, _ = I.instruments(known, events.select(F.lit("figi").alias("scheme"), F.col("figi").alias("external_id")))
    fresh = F.col("sym_id") != F.substring("external_id", 2, 9).cast("long")
    return out.select("scheme", "external_id", fresh.alias("fresh"), F.when(~fresh, F.col("sym_id")).alias("sym_id"))


@query("home_listings", "currency_of", "SELECT entity, ccy || '-' || CAST(entity % 3 AS VARCHAR) AS mic FROM currency_of")
def home_listings(currency_of):
    listings = currency_of.select("entity", F.explode(F.array(*map(F.lit, range(3)))).alias("k"), "ccy").select("entity", F.concat_ws("-", "ccy", F.col("k").cast("string")).alias("mic"), ((F.col("k") - F.col("entity") % 3) % 3 != 0).cast("int").alias("rank"))
    return I.home_listing(listings, F.col("rank")).select("entity", "mic")


@query("share_class_conflicts", "currency_of", "SELECT ccy AS raw, CAST(entity // 4 AS VARCHAR) AS issuer, count(*) AS n FROM currency_of GROUP BY ALL HAVING count(*) > 1")
def share_class_conflicts(currency_of):
    rows = currency_of.select(F.col("ccy").alias("raw"), F.floor(F.col("entity") / 4).cast("string").alias("issuer"), "entity")
    return rounded(I.share_class_conflicts(rows).drop("entities"))


@query("reversals", "membership_event", """, a AS (SELECT DISTINCT universe_id, raw_identifier, change, effective_date FROM membership_event WHERE event_id % 7 = 0), d AS (SELECT DISTINCT universe_id, raw_identifier, change, effective_date FROM membership_event WHERE event_id % 21 = 0)
    SELECT a.universe_id, a.raw_identifier, a.change, a.effective_date, CASE WHEN d.change IS NOT NULL THEN 'there already' ELSE 'appended' END AS verdict FROM a LEFT JOIN d USING (universe_id, raw_identifier, change, effective_date)
    UNION ALL SELECT DISTINCT universe_id, raw_identifier, change, DATE '1990-01-01', 'refused: not recorded' FROM membership_event WHERE event_id % 7 = 0 UNION ALL SELECT DISTINCT universe_id, raw_identifier, 'correct', effective_date, 'refused: only a join or leave' FROM membership_event WHERE event_id % 7 = 0""")
def reversals(events):
    log = _events(events)
    key = ["universe_id", "raw_identifier", "change", "effective_date"]
    done = log.where("event_id % 21 = 0").withColumn("reverses", F.concat_ws("|", "raw_identifier", "change", F.col("effective_date").cast("string"))).withColumn("change", F.lit("correct"))
    asked = events.where("event_id % 7 = 0").select(*key)
    asked = asked.unionByName(asked.withColumn("effective_date", F.lit("1990-01-01").cast("date"))).unionByName(asked.withColumn("change", F.lit("correct")))
    return U.reversals(log.unionByName(done), asked)


@query("membership_pinned_resolved", "membership_event", INTERVALS.replace(", d AS (", ", z AS (SELECT raw_identifier, max_by('R' || CAST(event_id % 9 AS VARCHAR), (effective_date, 'R' || CAST(event_id % 9 AS VARCHAR))) AS figi FROM membership_event WHERE effective_date <= DATE '2024-01-18' GROUP BY raw_identifier), pinned AS (SELECT m.event_id, m.effective_date, m.change, m.raw_identifier, m.universe_id, z.figi FROM membership_event m JOIN z USING (raw_identifier) WHERE event_id <= 4000), d AS (", 1).replace("FROM membership_event GROUP BY ALL)", "FROM pinned GROUP BY ALL)") + " SELECT universe_id, figi, valid_from, valid_to FROM iv")
def membership_pinned_resolved(events):
    known = events.select("raw_identifier", F.concat(F.lit("R"), (F.col("event_id") % 9).cast("string")).alias("figi"), F.col("effective_date").alias("resolved_at"))
    return U.pinned(_events(events), 4000, known, "2024-01-18").drop("raw_identifier")


@query("roster_window", "membership_event", INTERVALS + " SELECT universe_id, figi, min(valid_from) AS member_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS member_to, bool_or(valid_from <= DATE '2024-01-20' AND (valid_to IS NULL OR valid_to > DATE '2024-01-20')) AS active FROM iv GROUP BY ALL")
def roster_window(events):
    return U.roster_window(U.intervals(_events(events)), "2024-01-20")


# ---------------------------------------------------------------- factors and backtests


@query("factor_size", "closes fundamentals", CAPS + " SELECT entity, round(max_by(market_cap_usd, as_of_date), 2) AS raw FROM caps WHERE market_cap_usd > 0 AND as_of_date <= DATE '2000-03-01' GROUP BY entity")
def factor_size(closes, fundamentals):
    return rounded(Q.size("2000-03-01", _caps(closes, fundamentals)), 2)


_SHARPE = (
    ADJUSTED + ENDPOINTS
    + f""", r AS (SELECT entity, session_date, adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY session_date) - 1 AS r FROM adjusted),
    d AS (SELECT max(session_date) AS d FROM calendar WHERE session_date <= DATE '{AS_OF}'),
    s AS (SELECT q.entity, avg(x.r) / stddev_samp(x.r) * sqrt(252) AS raw, stddev_samp(x.r) AS sd FROM (SELECT a.entity, e.base_date, e.end_date FROM adjusted a JOIN d ON a.session_date = d.d JOIN ends e ON e.as_of_date = d.d AND e.code = '1Y' WHERE e.base_date IS NOT NULL) q
      JOIN r x ON x.entity = q.entity AND x.session_date > q.base_date AND x.session_date <= q.end_date GROUP BY q.entity)"""
)


@query("factor_sharpe", "prices calendar splits", _SHARPE + " SELECT entity, round(raw, 4) AS raw FROM s WHERE sd > 1e-9")
def factor_sharpe(prices, calendar, splits):
    day = calendar.where(F.col("session_date") <= F.lit(AS_OF)).agg(F.max("session_date").alias("d")).first().d  # one date
    metrics = R.risk_metrics(P.split_adjusted(prices, splits), calendar, C.windows(prices.sparkSession, ["1Y"]))
    return rounded(Q.sharpe(day, metrics), 4)


@query("factor_run", "closes attention", f"""{_own('1Y', 12, 'y')}{_own('1M', 1, 'm1')}, raw AS (SELECT y.entity, (1 + y.pr) / (1 + m1.pr) - 1 AS raw FROM y JOIN m1 USING (entity, as_of_date) WHERE as_of_date = DATE '{AS_OF}' AND entity % 2 = 0),
    p AS (SELECT *, row_number() OVER (ORDER BY raw) - 1 AS i, count(*) OVER () AS n FROM raw), b AS (SELECT max(raw) FILTER (i = CAST(floor(0.01 * n) AS BIGINT)) AS lo, max(raw) FILTER (i = least(n - 1, CAST(floor(0.99 * n) AS BIGINT))) AS hi FROM p), w AS (SELECT entity, CASE WHEN n < 5 THEN raw ELSE least(greatest(raw, lo), hi) END AS raw FROM p, b)
    SELECT 'mom_12_1' AS factor_key, DATE '{AS_OF}' AS as_of_date, entity, round(raw, 6) AS raw, row_number() OVER (ORDER BY raw DESC, entity) AS rank FROM w""")
def factor_run(closes, attention):
    out, _ = Q.run(["mom_12_1", "size", "nothing"], AS_OF, closes.where("entity % 2 = 0"), {"returns": _returns(closes, ["1Y", "1M"])})
    return rounded(out.select("factor_key", "as_of_date", "entity", "raw", "rank"))


@query("factor_catalogue", "closes", f"""{_own('1Y', 12, 'y')}{_own('1M', 1, 'm1')} SELECT k.factor_key, k.direction, CASE WHEN k.factor_key = 'mom_12_1' AND n > 0 THEN 1 ELSE 0 END AS runs, CASE WHEN k.factor_key = 'mom_12_1' THEN n ELSE 0 END AS names
    FROM (VALUES {', '.join(f"('{f.key}', '{f.direction}')" for f in Q.CATALOGUE.values())}) k(factor_key, direction), (SELECT count(*) AS n FROM y JOIN m1 USING (entity, as_of_date) WHERE as_of_date = DATE '{AS_OF}') c""")
def factor_catalogue(closes):
    out, _ = Q.run(["mom_12_1"], AS_OF, closes, {"returns": _returns(closes, ["1Y", "1M"])})
    return rounded(Q.catalogue_counts(out).select("factor_key", "direction", "runs", "names"))


@query("weights_by_cap", "closes fundamentals", SELECTED + CAPS + " , c AS (SELECT p.rebalance_date, p.entity, k.market_cap_usd AS aux FROM pick p ASOF JOIN caps k ON k.entity = p.entity AND p.rebalance_date >= k.as_of_date) SELECT rebalance_date, entity, round(aux / sum(aux) OVER (PARTITION BY rebalance_date), 6) AS weight FROM c WHERE aux > 0")
def weights_by_cap(closes, fundamentals):
    from ..operators.asof import asof_backward

    names = _held(closes).select("rebalance_date", "entity")
    caps = asof_backward(names, _caps(closes, fundamentals), ["entity"], "rebalance_date", "as_of_date", ["market_cap_usd"]).select("rebalance_date", "entity", F.col("market_cap_usd").alias("aux"))
    return rounded(B.weights(names, "cap", caps.where("aux is not null")))


@query("weights_by_inverse_vol", "closes", SELECTED + " , v AS (SELECT p.rebalance_date, p.entity, stddev_samp(ret) AS aux, count(*) AS n_obs FROM pick p JOIN dr ON dr.entity = p.entity AND dr.session_date <= p.rebalance_date GROUP BY ALL) SELECT rebalance_date, entity, round(1 / aux / sum(1 / aux) OVER (PARTITION BY rebalance_date), 6) AS weight FROM v WHERE aux > 0 AND n_obs >= 60")
def weights_by_inverse_vol(closes):
    from pyspark.sql import Window as W

    names = _held(closes).select("rebalance_date", "entity")
    upto = W.partitionBy("entity").orderBy("session_date")
    vol = P.daily_returns(closes).select("entity", F.col("session_date").alias("rebalance_date"), F.stddev_samp("ret").over(upto).alias("aux"), F.count("ret").over(upto).alias("n_obs"))
    return rounded(B.weights(names, "inverse_vol", vol))


@query("fixed_vector", "closes", DAILY + ", w AS (SELECT DATE '1996-03-01' AS d, entity, 1.0 / count(*) OVER () AS weight FROM (SELECT DISTINCT entity FROM closes WHERE entity % 4 = 0) x) SELECT session_date, round(sum(weight * ret) / sum(weight), 8) AS ret FROM w JOIN dr USING (entity) WHERE session_date > d AND session_date <= DATE '1997-06-30' GROUP BY session_date")
def fixed_vector(closes):
    names = closes.where("entity % 4 = 0").select(F.lit("1996-03-01").cast("date").alias("rebalance_date"), "entity").distinct()
    return rounded(B.holding_returns(B.weights(names), P.daily_returns(closes), last="1997-06-30").select("session_date", "ret"), 8)


@query("sweep", "closes", DAILY + """, t AS (SELECT CAST(trial AS BIGINT) AS trial, session_date, avg(ret) AS ret FROM dr JOIN (VALUES (0, 2), (1, 3), (2, 5)) k(trial, m) ON entity % m = 0 GROUP BY ALL), d AS (SELECT session_date FROM t GROUP BY session_date HAVING count(*) = 3)
    SELECT trial, session_date, round(ret, 8) AS ret FROM t SEMI JOIN d USING (session_date)""")
def sweep(closes):
    daily = P.daily_returns(closes)

    def one(spec):
        if spec["every"] == 0:
            raise B.SpecError("every from 1")
        return daily.where(F.col("entity") % spec["every"] == 0).groupBy("session_date").agg(F.avg("ret").alias("ret"))

    rows, _ = B.sweep({"every": [2, 3, 5]}, one)
    return rounded(rows, 8)


# ---------------------------------------------------------------- live boards and runs


@query("range_position", "closes", "SELECT entity, round(greatest(0, least(1, (max_by(close, session_date) * 1.05 - min(close)) / (max(close) - min(close)))), 6) AS position FROM closes c WHERE session_date >= (SELECT max(session_date) FROM closes x WHERE x.entity = c.entity) - 365 GROUP BY entity")
def range_position(closes):
    low = R.extremes(closes, value="close").groupBy("entity").agg(F.max_by("high_52w", "as_of_date").alias("h"), F.max_by("low_52w", "as_of_date").alias("l"))
    price = closes.groupBy("entity").agg((F.max_by("close", "session_date") * 1.05).alias("price"))
    return rounded(low.join(price, "entity").select("entity", BD.range_position(F.col("price"), F.col("l"), F.col("h")).alias("position")))


@query("live_heat_map", "closes currency_of", _own("1M", 1, "r") + ", l AS (SELECT entity, max_by(pr, as_of_date) AS pr FROM r GROUP BY entity), c AS (SELECT entity, max_by(close, session_date) AS close FROM closes GROUP BY entity) SELECT entity, ccy AS sector, round(CASE WHEN entity % 3 = 0 THEN pr ELSE (1 + entity / 200.0) * (1 + pr) - 1 END, 6) AS pr, entity % 3 > 0 AS live FROM l JOIN c USING (entity) JOIN currency_of USING (entity)")
def live_heat_map(closes, currency_of):
    pr = _returns(closes, ["1M"]).groupBy("entity").agg(F.max_by("pr", "as_of_date").alias("pr"))
    last = closes.groupBy("entity").agg(F.max_by("close", "session_date").alias("close"))
    quotes = last.where("entity % 3 > 0").select("entity", (F.col("close") * (1 + F.col("entity") / 200.0)).alias("price"))
    rows = pr.join(last, "entity").join(currency_of, "entity").join(quotes, "entity", "left")
    live = F.col("price").isNotNull()
    value = F.when(live, BD.rebased_to_live(F.col("pr"), F.col("price"), F.col("close"))).otherwise(F.col("pr"))
    return rounded(rows.select("entity", F.col("ccy").alias("sector"), value.alias("pr"), live.alias("live")))


@query(
    "fx_matrix_live",
    "fx_rate",
    BEST
    + """, q AS (SELECT ccy, max_by(rate, observed) * CASE WHEN ccy = 'ASIA' THEN 1.01 ELSE 1 END AS now FROM best WHERE observed <= DATE '2000-05-20' GROUP BY ccy UNION ALL SELECT 'USD', 1)
    SELECT a.ccy AS base, b.ccy AS quote, round(b.now / a.now, 6) AS rate FROM q a JOIN q b ON a.ccy <> b.ccy""",
)
def fx_matrix_live(rates):
    # a live quote is the rate of a most trusted source, on the day itself
    last = rates.where("as_of_date <= '2000-05-20'").groupBy("ccy").agg(F.max_by("rate", F.struct("as_of_date", -F.ascii("source"))).alias("rate"))
    live = last.where("ccy = 'ASIA'").select("ccy", F.lit("2000-05-20").cast("date").alias("as_of_date"), F.lit("live").alias("source"), (F.col("rate") * 1.01).alias("rate"))
    return rounded(X.cross_matrix(rates.where("as_of_date <= '2000-05-20'").select("ccy", "as_of_date", "source", "rate").unionByName(live), "2000-05-20", ("live", *SOURCES)).select("base", "quote", "rate"))


@query("fx_coverage", "currency_of fx_rate", BEST + ", n AS (SELECT DISTINCT ccy, DATE '1998-06-20' AS d FROM currency_of WHERE ccy <> 'USD'), r AS (SELECT n.ccy, n.d, b.observed FROM n ASOF LEFT JOIN best b ON b.ccy = n.ccy AND n.d >= b.observed) SELECT ccy, CASE WHEN observed IS NULL THEN 'no_data' WHEN datediff('day', observed, d) > 7 THEN 'stale' ELSE 'ok' END AS status, datediff('day', observed, d) AS days_stale, CASE WHEN observed IS NOT NULL AND datediff('day', observed, d) <= 7 THEN 'pass' ELSE 'fail' END AS severity FROM r")
def fx_coverage(currency_of, rates):
    return rounded(V.fx_coverage(currency_of, rates, "1998-06-20", SOURCES))


@query("classification_coverage", "label currency_of", SCD + ", a AS (SELECT entity FROM currency_of WHERE entity % 5 <> 0), s AS (SELECT entity, CASE WHEN entity % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM h WHERE valid_to IS NULL AND label <> '1-URGENT' AND entity IN (SELECT entity FROM a)) SELECT source, count(*) AS n, (SELECT count(*) FROM a) AS total, round((SELECT count(*) FROM s) / (SELECT count(*) FROM a), 6) AS share, CASE WHEN (SELECT count(*) FROM s) / (SELECT count(*) FROM a) >= 0.9 THEN 'pass' ELSE 'fail' END AS severity FROM s GROUP BY source")
def classification_coverage(label, currency_of):
    rows = S.from_history(label, "entity", "quarter_start", "label").withColumn("source", F.when(F.col("entity") % 2 == 0, "a").otherwise("b")).withColumn("label", F.when(F.col("label") != "1-URGENT", F.col("label")))
    securities = currency_of.select("entity", F.when(F.col("entity") % 5 == 0, "delisted").otherwise("active").alias("status"))
    return rounded(V.classification_coverage(securities, rows))


@query("bridge_holes", "currency_of", "SELECT 'unmapped' AS hole, 'F' || CAST(entity AS VARCHAR) AS key FROM currency_of WHERE entity % 6 = 0 UNION ALL SELECT 'orphan', CAST(entity + 1000 AS VARCHAR) FROM currency_of WHERE entity % 7 = 0 UNION ALL SELECT 'many', CAST(k AS VARCHAR) FROM (SELECT CASE WHEN entity % 8 = 1 THEN 1 ELSE entity END AS k FROM currency_of WHERE entity % 6 <> 0) x GROUP BY k HAVING count(*) > 1")
def bridge_holes(currency_of):
    sym = F.when(F.col("entity") % 8 == 1, F.lit(1)).otherwise(F.col("entity")).cast("long")
    securities = currency_of.select(F.concat(F.lit("F"), F.col("entity").cast("string")).alias("figi"), "entity", sym.alias("sym_id"))
    instruments = securities.select("sym_id").unionByName(currency_of.where("entity % 7 = 0").select((F.col("entity") + 1000).cast("long").alias("sym_id"))).select("sym_id", F.lit("equity").alias("kind"))
    xref = securities.where("entity % 6 <> 0").select(F.lit("figi").alias("scheme"), F.col("figi").alias("external_id"), "sym_id")
    mapped = xref.select("sym_id").distinct()
    own = instruments.where("sym_id >= 1000").unionByName(instruments.where("sym_id < 1000").join(mapped, "sym_id", "left_semi").select("sym_id", "kind"))
    return V.bridge_holes(securities, own, xref)


def _board(name: str, key: str, date: str) -> str:
    return f"""SELECT '{name}' AS dataset, max(l) AS latest, max(d) FILTER (n >= 0.9 * most) AS complete, max(most) AS n, max(n) FILTER (d = l) AS n_latest, (SELECT string_agg(k, ',' ORDER BY last, k) FROM (SELECT CAST({key} AS VARCHAR) AS k, max({date}) AS last FROM {name} WHERE {date} <= DATE '2024-01-20' GROUP BY 1 ORDER BY last, k LIMIT 3) z) AS worst
      FROM (SELECT *, max(n) OVER () AS most FROM (SELECT {date} AS d, count(DISTINCT {key}) AS n, (SELECT max({date}) FROM {name} WHERE {date} <= DATE '2024-01-20') AS l FROM {name} WHERE {date} <= DATE '2024-01-20' GROUP BY {date}) x WHERE d >= l - 10) y"""


@query("eod_board", "attention closes observation", f", b AS ({_board('attention', 'entity', 'obs_date')} UNION ALL {_board('closes', 'entity', 'session_date')} UNION ALL {_board('observation', 'series_id', 'obs_date')}) SELECT dataset, latest, complete, datediff('day', complete, DATE '2024-01-20') AS days_behind, CASE WHEN datediff('day', complete, DATE '2024-01-20') <= 1 THEN 'fresh' WHEN datediff('day', complete, DATE '2024-01-20') <= 4 THEN 'late' ELSE 'stale' END AS bucket, n, n_latest, worst FROM b")
def eod_board(attention, closes, observation):
    return rounded(V.eod_board({"attention": (attention, "entity", "obs_date"), "closes": (closes, "entity", "session_date"), "observation": (observation, "series_id", "obs_date")}, "2024-01-20"))


@query("check_log", "attention", "SELECT CAST(entity AS VARCHAR) AS name, count(*) AS runs, max(obs_date) AS last_run, max_by(CASE WHEN value > 2 THEN 'fail' ELSE 'pass' END, obs_date) AS status, max(obs_date) FILTER (NOT value > 2) AS last_pass FROM attention GROUP BY entity")
def check_log(attention):
    runs = attention.select(F.col("entity").cast("string").alias("name"), F.when(F.col("value") > 2, "fail").otherwise("pass").alias("status"), F.col("obs_date").alias("run_at"))
    return rounded(V.check_log(runs))


# ---------------------------------------------------------------- vendor texts, made of stored rows and read again


def _texts(rows, header: str, line):
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("obs_date", "value"))), line), "\n")
    return rows.groupBy("series_id", F.year("obs_date").alias("y")).agg(F.concat(F.lit(header + "\n"), lines).alias("text"))


@query("sdmx_texts", "observation", "SELECT obs_date, round(value, 2) AS value, 'US' AS ref_area FROM observation WHERE day(obs_date) % 2 = 0")
def sdmx_texts(observation):
    area = lambda d: F.when(F.day(d) % 2 == 0, "US").otherwise("FR")
    line = lambda r: F.concat_ws(",", area(r.obs_date), F.lit('"Rate, ""ten"" years"'), r.obs_date.cast("string"), F.round(r.value, 2).cast("decimal(30,2)").cast("string"))
    return rounded(T.sdmx_csv(_texts(observation, "ref_area,TITLE,TIME_PERIOD,OBS_VALUE", line), ref_area="US"), 2)


@query("atom_texts", "observation", "SELECT obs_date AS as_of_date, t.tenor, round(value * t.tenor, 2) AS value FROM observation, (VALUES (2.0), (10.0)) t(tenor)")
def atom_texts(observation):
    entry = lambda r: F.concat(F.lit("<entry><content><m:properties><d:NEW_DATE>"), r.obs_date.cast("string"), F.lit("T00:00:00</d:NEW_DATE><d:BC_2YEAR>"), F.round(r.value * 2, 2).cast("decimal(30,2)").cast("string"), F.lit("</d:BC_2YEAR><d:BC_10YEAR>"), F.round(r.value * 10, 2).cast("decimal(30,2)").cast("string"), F.lit("</d:BC_10YEAR><d:BC_30YEAR></d:BC_30YEAR></m:properties></content></entry>"))
    return rounded(T.atom_curve(_texts(observation, "<feed>", entry), {"BC_2YEAR": 2, "BC_10YEAR": 10, "BC_30YEAR": 30}), 2)


@query("json_texts", "observation", "SELECT CAST(3 AS BIGINT) AS total_pages, CAST(obs_date AS VARCHAR) AS record_date, round(value, 2) AS amount FROM observation")
def json_texts(observation):
    row = lambda r: F.to_json(F.struct(r.obs_date.cast("string").alias("record_date"), F.round(r.value, 2).cast("decimal(30,2)").cast("string").alias("amount")))
    pages = _texts(observation, "", row).select(F.concat(F.lit('{"data": ['), F.translate(F.trim(F.regexp_replace("text", "^\n", "")), "\n", ","), F.lit('], "meta": {"total-pages": 3}}')).alias("text"))
    return rounded(T.json_pages(pages, "record_date: string, amount: string").withColumn("amount", F.col("amount").cast("double")), 2)


@query("wide_texts", "observation", "SELECT obs_date AS as_of_date, t.tenor, round(value * t.tenor, 2) AS value FROM observation, (VALUES (1.0), (7.0)) t(tenor)")
def wide_texts(observation):
    comma = lambda c: F.regexp_replace(F.round(c, 2).cast("decimal(30,2)").cast("string"), r"\.", ",")
    line = lambda r: F.concat_ws(";", r.obs_date.cast("string"), comma(r.value), F.lit("."), comma(r.value * 7))
    return rounded(T.wide_csv(_texts(observation, "Date;1Y;2Y;7Y", line)), 2)


@query("index_graph_texts", "index_levels", "SELECT session_date, round(level, 4) AS level FROM index_levels WHERE region <> 3")
def index_graph_texts(levels):
    row = F.struct(F.date_format("session_date", "yyyyMMdd").cast("int").alias("calc_date"), F.round("level", 4).alias("level_eod"))
    pages = levels.groupBy("region").agg(F.collect_list(row).alias("INDEX_LEVELS"))
    text = F.when(F.col("region") == 3, '{"error_code": " 100", "error_message": "none"}').otherwise(F.to_json(F.struct(F.struct("INDEX_LEVELS").alias("indexes"))))
    return rounded(T.index_graph(pages.select(text.alias("text"))), 4)


@query("index_sheet_texts", "index_levels", "SELECT session_date, round(level, 2) AS level FROM index_levels")
def index_sheet_texts(levels):
    # regions differ in their dates and in how they write numbers
    plain = F.format_number("level", 2)
    number = F.when(F.col("region") % 2 == 0, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.translate(F.translate(F.translate(plain, ",", "_"), ".", ","), "_", "."), F.lit('"')))
    day = F.when(F.col("region") == 0, F.date_format("session_date", "MM/dd/yyyy")).when(F.col("region") == 1, F.date_format("session_date", "dd MMM yyyy")).otherwise(F.col("session_date").cast("string"))
    body = F.array_join(F.collect_list(F.concat_ws(",", day, F.lit("x"), number)), "\n")
    texts = levels.groupBy("region").agg(F.concat(F.lit("Index export,,\nAs of Date,Name,Level\n"), body, F.lit("\nCopyright: all rights,,\n")).alias("text"))
    return rounded(T.index_sheet(texts), 2)


@query("html_texts", "label", "SELECT entity, quarter_start, label FROM label")
def html_texts(label):
    cells = F.concat(F.lit("<tr><td>"), F.col("entity").cast("string"), F.lit("<td> "), F.col("quarter_start").cast("string"), F.lit("<sup>1</sup></td><td>"), F.col("label"), F.lit("</td></tr>"))
    pages = label.select("entity", cells.alias("row")).groupBy("entity").agg(F.concat(F.lit("<table><tr><th>entity<th>since<th>label</tr>"), F.array_join(F.collect_list("row"), ""), F.lit("</table>")).alias("html"))
    spark = label.sparkSession
    spark.udtf.register("vendor_tables", T.html_tables(spark))
    rows = spark.sql("select t.row_no, t.cells from {pages} p, lateral vendor_tables(p.html) t", pages=pages).where("row_no > 0")
    return rows.select(F.col("cells")[0].cast("long").alias("entity"), F.col("cells")[1].cast("date").alias("quarter_start"), F.col("cells")[2].alias("label"))
