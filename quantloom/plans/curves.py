"""Queries on several countries' curves: catalogue, comparison, spread sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rates as X
from . import market
from .market import rounded
from .screens import _at

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)

PRIMARY = """, nd AS (SELECT country, max(as_of_date) AS d FROM rate_point WHERE basis = 'nominal' GROUP BY country),
prim AS (SELECT p.country, curve_set, basis, rate_type, count(*) AS nodes FROM rate_point p JOIN nd ON nd.country = p.country AND nd.d = p.as_of_date WHERE basis = 'nominal' GROUP BY p.country, curve_set, basis, rate_type
  QUALIFY row_number() OVER (PARTITION BY p.country ORDER BY rate_type = 'forward', count(*) DESC, CASE rate_type WHEN 'spot' THEN 0 WHEN 'par' THEN 1 WHEN 'yield' THEN 2 ELSE 3 END, curve_set) = 1),
own AS (SELECT p.* FROM rate_point p JOIN prim USING (country, curve_set, basis, rate_type))"""
SPREADS = (
    PRIMARY
    + """, legs AS (SELECT country, curve_set, basis, rate_type, as_of_date, max(value) FILTER (tenor = 2) AS v2, max(value) FILTER (tenor = 5) AS v5, max(value) FILTER (tenor = 10) AS v10, max(value) FILTER (tenor = 30) AS v30 FROM rate_point GROUP BY ALL),
gb AS (SELECT n.*, r.v10 AS r10, o.v10 AS o10 FROM (SELECT * FROM legs WHERE country = 'GB' AND curve_set = 'glc' AND basis = 'nominal' AND rate_type = 'spot') n
  LEFT JOIN (SELECT * FROM legs WHERE country = 'GB' AND curve_set = 'glc' AND basis = 'real') r USING (as_of_date) LEFT JOIN (SELECT * FROM legs WHERE country = 'GB' AND curve_set = 'ois') o USING (as_of_date)),
g AS (SELECT legs.* FROM legs JOIN prim USING (country, curve_set, basis, rate_type) WHERE country <> 'GB'),
be AS (SELECT n.country, n.as_of_date, n.v - r.v AS value FROM """
    + f"(SELECT country, as_of_date, {_at('value', 10)} AS v FROM own c WHERE country = 'BR' GROUP BY ALL) n JOIN (SELECT country, as_of_date, {_at('value', 10)} AS v FROM rate_point c WHERE country = 'BR' AND basis = 'real' GROUP BY ALL) r USING (country, as_of_date)),"
    + """ spread AS (SELECT 'GB' AS country, '2s10s' AS key, 'bp' AS unit, as_of_date, (v10 - v2) * 100 AS value FROM gb UNION ALL SELECT 'GB', '2s5s10s', 'bp', as_of_date, (2 * v5 - v2 - v10) * 100 FROM gb
  UNION ALL SELECT 'GB', 'be10y', '%', as_of_date, v10 - r10 FROM gb UNION ALL SELECT 'GB', 'asw10y', 'bp', as_of_date, (v10 - o10) * 100 FROM gb
  UNION ALL SELECT country, '2s10s', 'bp', as_of_date, (v10 - v2) * 100 FROM g UNION ALL SELECT country, '2s5s10s', 'bp', as_of_date, (2 * v5 - v2 - v10) * 100 FROM g UNION ALL SELECT country, '5s30s', 'bp', as_of_date, (v30 - v5) * 100 FROM g
  UNION ALL SELECT country, 'be10y', '%', as_of_date, value FROM be)"""
)


@query("curve_countries", "rate_point", "SELECT country, min(as_of_date) AS first, max(as_of_date) AS last FROM rate_point GROUP BY country")
def curve_countries(points):
    return X.curve_countries(points)


@query("curve_sets", "rate_point", "SELECT country, curve_set, basis, rate_type, count(DISTINCT as_of_date) AS days, min(as_of_date) AS first, max(as_of_date) AS last FROM rate_point GROUP BY ALL")
def curve_sets(points):
    return rounded(X.curve_sets(points))


@query("curve_primary", "rate_point", PRIMARY + " SELECT * FROM prim")
def curve_primary(points):
    return rounded(X.primary_series(points))


@query("curve_compare", "rate_point", PRIMARY + ", d AS (SELECT country, max(as_of_date) AS as_of_date FROM own WHERE as_of_date <= DATE '1996-10-15' GROUP BY country) SELECT country, curve_set, basis, rate_type, as_of_date, tenor, round(value, 6) AS value FROM own JOIN d USING (country, as_of_date)")
def curve_compare(points):
    return rounded(X.compare_curves(points, "1996-10-15"))


@query("curve_tenor_history", "rate_point", PRIMARY + " SELECT country, curve_set, basis, rate_type, as_of_date, round(value, 6) AS value FROM own WHERE tenor = 10")
def curve_tenor_history(points):
    return rounded(X.tenor_history(points, 10))


@query("spread_set", "rate_point", SPREADS + " SELECT country, key, unit, as_of_date, round(value, 6) AS value FROM spread WHERE value IS NOT NULL")
def spread_set(points):
    return rounded(X.spread_set(points))


@query(
    "spread_set_richness",
    "rate_point",
    SPREADS
    + """, s AS (SELECT * FROM spread WHERE value IS NOT NULL), n AS (SELECT country, key, max_by(value, as_of_date) AS current FROM s GROUP BY ALL)
    SELECT country, key, round(any_value(current), 6) AS current, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(100 * avg(CASE WHEN value <= current THEN 1.0 ELSE 0 END), 4) AS percentile, count(*) AS n,
      round(CASE WHEN stddev_pop(value) > 0 THEN (any_value(current) - avg(value)) / stddev_pop(value) END, 5) AS zscore FROM s JOIN n USING (country, key) GROUP BY country, key""",
)
def spread_set_richness(points):
    return rounded(X.richness(X.spread_set(points), ["country", "key"], "value"), 6, percentile=4, zscore=5)


@query("inflation_gaps", "rate_point", "SELECT n.country, n.curve_set, n.as_of_date, n.tenor, round(abs(n.value - r.value - (n.value - r.value) * 1.02), 6) AS gap FROM (SELECT * FROM rate_point WHERE basis = 'nominal' AND rate_type = 'spot' AND curve_set = 'glc') n JOIN (SELECT * FROM rate_point WHERE basis = 'real') r USING (country, curve_set, as_of_date, tenor) WHERE abs((n.value - r.value) * 0.02) > 0.0213")
def inflation_gaps(points):
    # an inflation curve made two per cent off the difference
    key = ["country", "curve_set", "as_of_date", "tenor"]
    real = points.where("basis = 'real'").select(*key, F.col("value").alias("r"))
    made = points.where("basis = 'nominal' and rate_type = 'spot' and curve_set = 'glc'").join(real, key).select("country", "curve_set", F.lit("inflation").alias("basis"), "rate_type", "as_of_date", "tenor", ((F.col("value") - F.col("r")) * 1.02).alias("value"))
    return rounded(X.inflation_gaps(points.unionByName(made), 0.0213))


@query("asset_swap", "rate_point", f"SELECT as_of_date, round((b.v - o.v) * 100, 6) AS asset_swap FROM (SELECT as_of_date, {_at('value', 11)} AS v FROM rate_point c WHERE country = 'GB' AND curve_set = 'glc' AND basis = 'nominal' AND rate_type = 'spot' GROUP BY as_of_date) b JOIN (SELECT as_of_date, {_at('value', 11)} AS v FROM rate_point c WHERE country = 'GB' AND curve_set = 'ois' GROUP BY as_of_date) o USING (as_of_date)")
def asset_swap(points):
    gb = points.where("country = 'GB' and rate_type = 'spot'")
    bonds = X.as_arrays(gb.where("curve_set = 'glc' and basis = 'nominal'"), ["as_of_date"])
    swaps = X.as_arrays(gb.where("curve_set = 'ois'"), ["as_of_date"]).withColumnRenamed("curve", "ois")
    return rounded(bonds.join(swaps, "as_of_date").select("as_of_date", X.asset_swap_bp(F.col("curve"), F.col("ois"), 11).alias("asset_swap")))


@query("curve_movie", "rate_point", """, d AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY as_of_date) - 1 AS i, count(*) OVER (PARTITION BY country) AS m FROM (SELECT DISTINCT country, as_of_date FROM rate_point) x),
    k AS (SELECT country, as_of_date FROM d WHERE m <= 12 OR round(round(i / ((m - 1) / 11.0)) * ((m - 1) / 11.0)) = i) SELECT country, as_of_date, count(*) AS nodes, round(sum(value), 6) AS total FROM rate_point JOIN k USING (country, as_of_date) GROUP BY ALL""")
def curve_movie(points):
    shown = X.curve_movie(points, ["country"], 12)
    return rounded(shown.groupBy("country", "as_of_date").agg(F.count(F.lit(1)).alias("nodes"), F.sum("value").alias("total")))
