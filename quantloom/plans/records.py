"""Queries on identities, catalogues and details."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import boards as BD
from ..operators import calendar as C
from ..operators import catalogue as K
from ..operators import identity as I
from ..operators import optimiser as O
from ..operators import prices as P
from ..operators import rates as RT
from ..operators import returns as R
from ..operators import scd as S
from ..operators import universe as U
from . import market
from .market import rounded
from .membership import INTERVALS, SCD, _events
from .research import DAILY, _own

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)

CAPS = ", caps AS (SELECT f.entity, f.as_of_date, f.shares * c.close AS market_cap_usd FROM fundamentals f ASOF JOIN closes c ON c.entity = f.entity AND f.as_of_date >= c.session_date)"


def _caps(closes, fundamentals):
    from ..operators.asof import asof_backward

    return asof_backward(fundamentals, closes.select("entity", "session_date", "close"), ["entity"], "as_of_date", "session_date", ["close"]).where("matched_date is not null").select("entity", "as_of_date", (F.col("shares") * F.col("close")).alias("market_cap_usd"))


@query(
    "security_detail",
    "closes fundamentals label currency_of",
    SCD + CAPS + _own("1Y", 12, "y") + _own("3M", 3, "q")
    + """ SELECT s.entity, h.label, l.last_date, round(l.close, 6) AS close, round(k.cap, 2) AS market_cap, round(a.pr, 6) AS y1, round(b.pr, 6) AS m3 FROM currency_of s LEFT JOIN (SELECT * FROM h WHERE valid_to IS NULL) h USING (entity)
    LEFT JOIN (SELECT entity, max(session_date) AS last_date, max_by(close, session_date) AS close FROM closes GROUP BY entity) l USING (entity) LEFT JOIN (SELECT entity, max_by(market_cap_usd, as_of_date) AS cap FROM caps GROUP BY entity) k USING (entity)
    LEFT JOIN (SELECT entity, max_by(pr, as_of_date) AS pr FROM y GROUP BY entity) a USING (entity) LEFT JOIN (SELECT entity, max_by(pr, as_of_date) AS pr FROM q GROUP BY entity) b USING (entity)""",
)
def security_detail(closes, fundamentals, label, securities):
    returns = R.own_dates_matrix(closes, C.windows(closes.sparkSession, ["1Y", "3M"]), "entity", "close").where("pr is not null")
    out = K.security_detail(securities, S.from_history(label, "entity", "quarter_start", "label"), closes, _caps(closes, fundamentals), returns)
    out = out.withColumns({"y1": F.try_element_at("returns", F.lit("1Y")), "m3": F.try_element_at("returns", F.lit("3M"))}).drop("returns")
    return rounded(out, 6, market_cap=2)


@query("price_history", "closes", "SELECT entity, session_date, round(close, 6) AS close FROM closes c WHERE session_date > (SELECT max(session_date) FROM closes x WHERE x.entity = c.entity) - 30")
def price_history(closes):
    return rounded(K.history(closes.select("entity", "session_date", "close"), 30))


@query("attention_lists", "flags dividends", "SELECT * FROM (SELECT 'flag' AS kind, CAST(entity AS VARCHAR) AS key, session_date AS opened FROM flags ORDER BY opened DESC, key LIMIT 10) UNION ALL SELECT * FROM (SELECT 'dividend', CAST(entity AS VARCHAR), ex_date AS opened FROM dividends ORDER BY opened DESC, 2 LIMIT 10)")
def attention_lists(flags, dividends):
    return K.attention({"flag": (flags, "session_date"), "dividend": (dividends.select("entity", "ex_date"), "ex_date")}, 10)


@query("universe_list", "membership_event", INTERVALS + " SELECT universe_id, count(DISTINCT CASE WHEN valid_from <= DATE '2024-01-20' AND (valid_to IS NULL OR valid_to > DATE '2024-01-20') THEN figi END) AS members, count(DISTINCT figi) AS ever FROM iv GROUP BY universe_id")
def universe_list(events):
    return rounded(K.universe_list(U.intervals(_events(events)), "2024-01-20"))


@query("level_series", "index_levels", "SELECT region, session_date, round(level / first(level) OVER (PARTITION BY region ORDER BY session_date) - 1, 6) AS since_start FROM index_levels")
def level_series(levels):
    return rounded(K.level_series(levels, "region").select("region", "session_date", "since_start"))


@query("series_catalogue", "observation", "SELECT series_id, count(*) AS n, min(obs_date) AS first, max(obs_date) AS last, round(max_by(value, obs_date), 2) AS latest FROM observation GROUP BY series_id")
def series_catalogue(observation):
    return rounded(K.series_catalogue(observation, "series_id", "obs_date", "value"), 2)


@query("universe_snapshot", "membership_event index_levels", INTERVALS + ", m AS (SELECT universe_id, count(DISTINCT figi) AS members FROM iv WHERE valid_from <= DATE '2024-01-20' AND (valid_to IS NULL OR valid_to > DATE '2024-01-20') GROUP BY universe_id), l AS (SELECT CASE WHEN region = 1 THEN 'even' ELSE 'odd' END AS universe_id, max(session_date) AS level_date, max_by(level, session_date) AS level FROM index_levels WHERE region IN (1, 2) GROUP BY region) SELECT universe_id, members, level_date, round(level, 6) AS level FROM m LEFT JOIN l USING (universe_id)")
def universe_snapshot(events, levels):
    rows = levels.where("region in (1, 2)").select(F.when(F.col("region") == 1, "even").otherwise("odd").alias("universe_id"), "session_date", "level")
    return rounded(K.snapshot(U.intervals(_events(events)), rows, "2024-01-20"))


@query("benchmarks", "index_levels currency_of", "SELECT DISTINCT entity AS region FROM currency_of WHERE entity IN (SELECT region FROM index_levels)")
def benchmarks(levels, currency_of):
    return rounded(K.with_daily_series(currency_of.select(F.col("entity").alias("region")), levels, "region"))


@query(
    "live_board",
    "closes",
    _own("1M", 1, "r")
    + """, l AS (SELECT entity, max_by(pr, as_of_date) AS ret FROM r GROUP BY entity), c AS (SELECT entity, max_by(close, session_date) AS close FROM closes GROUP BY entity)
    SELECT entity, '1M' AS code, round(CASE WHEN entity % 5 = 0 THEN ret ELSE (1 + ret) * (1 + entity / 100.0) - 1 END, 6) AS ret, CASE WHEN entity % 5 = 0 THEN 'close' WHEN entity % 5 = 1 THEN 'live' WHEN entity % 5 < 4 THEN 'delayed' ELSE 'stale' END AS freshness FROM l JOIN c USING (entity)""",
)
def live_board(closes):
    board = R.own_dates_matrix(closes, C.windows(closes.sparkSession, ["1M"]), "entity", "close").where("pr is not null").groupBy("entity", "code").agg(F.max_by("pr", "as_of_date").alias("ret"))
    last = closes.groupBy("entity").agg(F.max_by("close", "session_date").alias("close"))
    k = F.col("entity") % 5
    quotes = last.where(k != 0).select("entity", (F.col("close") * (1 + F.col("entity") / 100.0)).alias("price"), F.date_sub(F.lit("2001-12-01").cast("date"), F.when(k == 1, 0).when(k == 4, 9).otherwise(3)).alias("quoted_on"))
    return rounded(K.live_board(board.join(last, "entity"), quotes, "2001-12-01"))


@query("security_search", "currency_of", "SELECT entity, ccy, count(*) OVER () AS total FROM currency_of WHERE upper(ccy) LIKE '%A%' ORDER BY ccy NULLS LAST, entity LIMIT 5 OFFSET 3")
def security_search(currency_of):
    return rounded(BD.search(currency_of, "a", ["ccy", "entity"], 5, 3))


@query("criteria_members", "closes fundamentals", CAPS + " SELECT entity, round(max_by(market_cap_usd, as_of_date), 2) AS market_cap_usd FROM caps WHERE as_of_date <= DATE '2000-03-01' AND as_of_date >= DATE '2000-03-01' - 180 GROUP BY entity ORDER BY 2 DESC, entity LIMIT 7")
def criteria_members(closes, fundamentals):
    return rounded(I.criteria_members(_caps(closes, fundamentals), "2000-03-01", 7), 2)


@query("load_plan", "closes calendar currency_of", ", g AS (SELECT f.entity, min(c.session_date) AS gap FROM (SELECT entity, min(session_date) AS d FROM closes WHERE entity <> 3 GROUP BY entity) f JOIN calendar c ON c.session_date >= f.d ANTI JOIN closes p ON p.entity = f.entity AND p.session_date = c.session_date GROUP BY f.entity), l AS (SELECT entity, max(session_date) AS last FROM closes WHERE entity <> 3 GROUP BY entity), q AS (SELECT s.entity, CASE WHEN last IS NULL THEN DATE '1995-01-01' WHEN gap IS NOT NULL THEN gap ELSE last + 1 END AS start, DATE '2001-12-31' AS \"end\", CASE WHEN last IS NULL THEN 'new' WHEN gap IS NOT NULL THEN 'gap' ELSE 'forward' END AS reason FROM currency_of s LEFT JOIN l USING (entity) LEFT JOIN g USING (entity)) SELECT * FROM q WHERE start <= \"end\"")
def load_plan(closes, calendar, securities):
    have = closes.where("entity <> 3")
    return I.load_plan(securities, have, P.gaps(have, calendar), "2001-12-31", "1995-01-01", "gaps")


@query("classification_fill", "label currency_of", ", o AS (SELECT entity, label AS value, 'b' AS source FROM label WHERE quarter_start = DATE '2000-01-01' AND entity % 3 <> 0 UNION ALL SELECT entity, 'x', 'a' FROM currency_of WHERE entity % 4 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY source) AS n FROM o) SELECT c.entity, r.value, r.source FROM currency_of c LEFT JOIN r ON r.entity = c.entity AND n = 1")
def classification_fill(label, securities):
    a = label.where("quarter_start = '2000-01-01' and entity % 3 <> 0").select("entity", F.col("label").alias("value"), F.lit("b").alias("source"))
    b = securities.where("entity % 4 = 0").select("entity", F.lit("x").alias("value"), F.lit("a").alias("source"))
    return I.fill_chain(securities, a.unionByName(b), ["a", "b"])


@query("label_maps", "label", "SELECT entity, quarter_start, CASE WHEN contains(lower(label), 'urgent') THEN 'now' WHEN contains(lower(label), 'low') THEN 'later' WHEN contains(lower(label), 'high') THEN 'soon' END AS word, CASE WHEN year(quarter_start) BETWEEN 1995 AND 1997 THEN 'early' WHEN year(quarter_start) BETWEEN 1996 AND 1999 THEN 'middle' END AS band FROM label")
def label_maps(label):
    return label.select("entity", "quarter_start", I.first_match(F.col("label"), [("Urgent", "now"), ("low", "later"), ("high", "soon")]).alias("word"), I.band(F.year("quarter_start"), [(1995, 1997, "early"), (1996, 1999, "middle")]).alias("band"))


@query("dominant_label", "label", "SELECT entity, label, n FROM (SELECT entity, label, count(*) AS n, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, label) AS k FROM label GROUP BY entity, label) x WHERE k = 1")
def dominant_label(label):
    return rounded(I.dominant(label, "entity", "label"))


@query("open_tokens", "membership_event", "SELECT universe_id, raw_identifier FROM (SELECT *, row_number() OVER (PARTITION BY universe_id, raw_identifier ORDER BY effective_date DESC, event_id DESC) AS n FROM membership_event) x WHERE n = 1 AND change = 'join'")
def open_tokens(events):
    return I.open_tokens(events)


@query("identity_classes", "membership_event", "SELECT figi AS raw, count(DISTINCT raw_identifier) AS n, CASE WHEN count(DISTINCT raw_identifier) = 1 THEN 'assigned' ELSE 'ambiguous' END AS verdict FROM membership_event GROUP BY figi")
def identity_classes(events):
    return rounded(S.identity_class(events.select(F.col("figi").alias("raw"), F.col("raw_identifier").alias("figi"))).drop("figi"))


@query("calendar_versions", "closes currency_of", "SELECT ccy AS mic, count(*) AS n, sha256(string_agg(CAST(session_date AS VARCHAR), ',' ORDER BY session_date)) AS content_hash FROM (SELECT DISTINCT ccy, session_date FROM closes JOIN currency_of USING (entity)) x GROUP BY ccy")
def calendar_versions(closes, currency_of):
    return rounded(S.calendar_version(closes.join(currency_of, "entity").select(F.col("ccy").alias("mic"), "session_date").distinct()))


@query("covariances", "closes", DAILY + " SELECT x.entity AS a, y.entity AS b, round(covar_samp(x.ret, y.ret) * 1e4, 6) AS cov, count(*) AS n FROM dr x JOIN dr y USING (session_date) WHERE x.entity <= y.entity GROUP BY ALL HAVING count(*) > 1")
def covariances(closes):
    return rounded(O.covariance(P.daily_returns(closes)).where("n > 1").withColumn("cov", F.col("cov") * 1e4))


MIN_VARIANCE = (
    DAILY
    + _own("6M", 6, "h")
    + """, reb AS (SELECT min(session_date) AS rebalance_date FROM closes GROUP BY date_trunc('quarter', session_date)),
    pick AS (SELECT rebalance_date, entity, row_number() OVER (PARTITION BY rebalance_date ORDER BY pr DESC, entity) AS rank FROM h JOIN reb ON h.as_of_date = reb.rebalance_date QUALIFY rank <= 2),
    pair AS (SELECT a.rebalance_date, least(a.entity, b.entity) AS x, greatest(a.entity, b.entity) AS y FROM pick a JOIN pick b ON a.rebalance_date = b.rebalance_date AND a.rank = 1 AND b.rank = 2),
    c AS (SELECT p.rebalance_date, p.x, p.y, covar_pop(u.ret, w.ret) AS cxy, var_pop(u.ret) AS cx, var_pop(w.ret) AS cy FROM pair p JOIN dr u ON u.entity = p.x AND u.session_date <= p.rebalance_date AND u.session_date > p.rebalance_date - 365
      JOIN dr w ON w.entity = p.y AND w.session_date = u.session_date GROUP BY ALL HAVING count(*) >= 30),
    s AS (SELECT *, greatest(0, least(1, (cy - cxy) / (cx + cy - 2 * cxy))) AS wx FROM c),
    o AS (SELECT rebalance_date, x AS entity, wx AS weight FROM s UNION ALL SELECT rebalance_date, y, 1 - wx FROM s)"""
)


# of two names the shrunk covariance is the sample's, and the weights have a closed form
@query("min_variance", "closes", MIN_VARIANCE + " SELECT rebalance_date, entity, round(weight, 4) AS weight, CAST(2 - count(*) OVER (PARTITION BY rebalance_date) AS BIGINT) AS dropped FROM o WHERE weight > 1e-9")
def min_variance(closes):
    dates = C.period_firsts(closes, "quarter").withColumnRenamed("session_date", "rebalance_date")
    value = R.own_dates_matrix(closes, C.windows(closes.sparkSession, ["6M"]), "entity", "close").where("pr is not null")
    value = value.select(F.col("as_of_date").alias("rebalance_date"), "entity", F.col("pr").alias("value")).join(F.broadcast(dates), "rebalance_date")
    legs = B.selected(value, top_n=2).select("rebalance_date", "entity", (-F.col("value")).alias("rank"))
    return rounded(O.min_variance_by_date(legs, P.daily_returns(closes), steps=20_000), 4)


@query("even_sample", "index_levels", ", n AS (SELECT *, row_number() OVER (ORDER BY session_date, region) - 1 AS i, count(*) OVER () AS n FROM index_levels) SELECT region, session_date, round(level, 6) AS level FROM n WHERE n <= 50 OR round(round(i / ((n - 1) / 49.0)) * ((n - 1) / 49.0)) = i")
def even_sample(levels):
    return rounded(C.even_sample(levels, 50, "session_date", "region"))


@query("curve_complete_days", "curve_point", "SELECT as_of_date, tenor FROM curve_point WHERE NOT (tenor = 7 AND as_of_date > DATE '2001-06-15') AND as_of_date <= DATE '2001-06-15'")
def curve_complete_days(points):
    # the longest tenor is made to end early; so must the others
    rows = points.where("not (tenor = 7 and as_of_date > '2001-06-15')")
    return RT.complete_days(rows, ["tenor"]).select("as_of_date", "tenor")


@query("series_sweep", "observation attention", "SELECT DISTINCT series_id FROM observation WHERE series_id NOT IN (SELECT series_id FROM observation WHERE obs_date < DATE '1995-01-01')")
def series_sweep(observation, attention):
    return I.swept(observation.select("series_id").distinct(), observation.where("obs_date < '1995-01-01'"), ["series_id"])
