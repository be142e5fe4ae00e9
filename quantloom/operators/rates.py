"""Yield curves: interpolation, discounting, spreads, carry, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import latest


def as_arrays(points: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """One row for each curve: its (tenor, value) points in order."""
    return points.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tenor", F.col(value).alias("value")))).alias("curve"))


def at_tenor(curve: Column, tenor: Column) -> Column:
    """The curve's value at a tenor, linear between its points; null outside them."""
    low = F.try_element_at(F.filter(curve, lambda p: p.tenor <= tenor), F.lit(-1))
    high = F.get(F.filter(curve, lambda p: p.tenor >= tenor), 0)
    share = F.try_divide(tenor - low.tenor, high.tenor - low.tenor)
    return F.when(low.tenor.isNotNull() & high.tenor.isNotNull(), F.when(low.tenor == high.tenor, low.value).otherwise(low.value + (high.value - low.value) * share))


def discount(zero: Column, tenor: Column) -> Column:
    """exp(-z t) of a continuously compounded rate in percent."""
    return F.exp(-zero / 100 * tenor)


def zero_rate(factor: Column, tenor: Column) -> Column:
    return F.when((factor > 0) & (tenor > 0), -F.log(F.when(factor > 0, factor)) / F.when(tenor > 0, tenor) * 100)


def spread_bp(curve: Column, short: float, long: float) -> Column:
    return (at_tenor(curve, F.lit(float(long))) - at_tenor(curve, F.lit(float(short)))) * 100


def butterfly_bp(curve: Column, short: float, belly: float, long: float) -> Column:
    at = lambda t: at_tenor(curve, F.lit(float(t)))
    return (2 * at(belly) - at(short) - at(long)) * 100


def breakeven(nominal: Column, real: Column, tenor: float) -> Column:
    return at_tenor(nominal, F.lit(float(tenor))) - at_tenor(real, F.lit(float(tenor)))


def roll_down_bp(curve: Column, tenor: float, horizon: float) -> Column:
    """What a held yield falls by as it ages by horizon years, the curve unchanged."""
    return (at_tenor(curve, F.lit(float(tenor))) - at_tenor(curve, F.lit(float(tenor - horizon)))) * 100


def carry_and_roll_bp(curve: Column, tenor: float, horizon: float, funding: Column) -> Column:
    return (at_tenor(curve, F.lit(float(tenor))) - funding) * horizon * 100 + roll_down_bp(curve, tenor, horizon)


def present_values(cashflows: DataFrame, curves: DataFrame, by: list[str], shift_bp: float = 0.0) -> DataFrame:
    """cashflows(leg, tenor, amount) on each curve -> pv; null where a leg has a flow outside the curve."""
    rows = curves.crossJoin(F.broadcast(cashflows))  # a few flows, on every curve
    z = at_tenor(F.col("curve"), F.col("tenor")) + shift_bp / 100
    pv = F.col("amount") * discount(z, F.col("tenor"))
    return rows.groupBy(*by, "leg").agg(F.when(F.count(F.when(pv.isNull(), 1)) == 0, F.sum(pv)).alias("pv"))


def dv01(cashflows: DataFrame, curves: DataFrame, by: list[str]) -> DataFrame:
    """What a fall of all rates by one basis point is worth."""
    base = present_values(cashflows, curves, by)
    down = present_values(cashflows, curves, by, -1.0).withColumnRenamed("pv", "pv_down")
    return base.join(down, [*by, "leg"]).withColumn("dv01", F.col("pv_down") - F.col("pv"))


def curve_as_of(points: DataFrame, by: list[str], as_of) -> DataFrame:
    """The points of each curve's latest day up to as_of."""
    last = points.where(F.col("as_of_date") <= F.lit(as_of)).groupBy(*by).agg(F.max("as_of_date").alias("as_of_date"))
    return points.join(last, [*by, "as_of_date"])


def richness(spreads: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, current, mean, sd, zscore, percentile) of each spread's latest value in its history; population figures."""
    now = spreads.groupBy(*by).agg(F.max_by(value, "as_of_date").alias("current"))
    rows = spreads.join(now, by)
    out = rows.groupBy(*by).agg(F.max("current").alias("current"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (100 * F.avg(F.when(F.col(value) <= F.col("current"), 1.0).otherwise(0.0))).alias("percentile"), F.count(value).alias("n"))
    return out.withColumn("zscore", F.when(F.col("sd") > 0, (F.col("current") - F.col("mean")) / F.col("sd")))


SERIES = ["country", "curve_set", "basis", "rate_type"]


def curve_countries(points: DataFrame) -> DataFrame:
    """(country, first, last): the days that each country's curves span."""
    return points.groupBy("country").agg(F.min("as_of_date").alias("first"), F.max("as_of_date").alias("last"))


def curve_sets(points: DataFrame) -> DataFrame:
    """(country, curve_set, basis, rate_type, days, first, last) of each series."""
    return points.groupBy(*SERIES).agg(F.countDistinct("as_of_date").alias("days"), F.min("as_of_date").alias("first"), F.max("as_of_date").alias("last"))


def primary_series(points: DataFrame) -> DataFrame:
    """Each country's nominal curve to show, by its latest nominal day: not a forward one if there is another,
    most points, spot before par before yield, by name."""
    nominal = points.where("basis = 'nominal'")
    last = nominal.groupBy("country").agg(F.max("as_of_date").alias("as_of_date"))
    sizes = nominal.join(last, ["country", "as_of_date"]).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("nodes"))
    rank = F.when(F.col("rate_type") == "spot", 0).when(F.col("rate_type") == "par", 1).when(F.col("rate_type") == "yield", 2).otherwise(3)
    over = W.partitionBy("country").orderBy(F.col("rate_type") == "forward", F.desc("nodes"), rank, "curve_set")
    return sizes.withColumn("nth", F.row_number().over(over)).where("nth = 1").drop("nth")


def compare_curves(points: DataFrame, as_of=None) -> DataFrame:
    """(series, as_of_date, tenor, value): each country's primary curve on its latest day up to as_of."""
    own = points.join(primary_series(points).select(*SERIES), SERIES)
    return curve_as_of(own, SERIES, as_of if as_of is not None else "9999-12-31").select(*SERIES, "as_of_date", "tenor", "value")


def tenor_history(points: DataFrame, tenor: float) -> DataFrame:
    """(series, as_of_date, value) of one published tenor on each country's primary curve."""
    return points.where(F.col("tenor") == float(tenor)).join(primary_series(points).select(*SERIES), SERIES).select(*SERIES, "as_of_date", "value")


def asset_swap_bp(bond: Column, ois: Column, tenor: float) -> Column:
    """The proxy of an asset swap: the government yield less the overnight swap's at the tenor."""
    return (at_tenor(bond, F.lit(float(tenor))) - at_tenor(ois, F.lit(float(tenor)))) * 100


def spread_set(points: DataFrame, curated: str = "GB") -> DataFrame:
    """(country, key, unit, as_of_date, value) of days on which all legs are there.

    The curated country has its own set: the slope and butterfly of its nominal spot curve, a breakeven against
    the real one and an asset-swap proxy against swaps, at published tenors. Other countries have slopes and a
    butterfly of their primary curve, and a breakeven, interpolated on both curves, where their set has a real
    curve and no inflation curve.
    """
    leg = lambda t: F.max(F.when(F.col("tenor") == t, F.col("value"))).alias(f"v{t}")
    legs = points.where(F.col("tenor").isin(2, 5, 10, 30)).groupBy(*SERIES, "as_of_date").agg(*(leg(t) for t in (2, 5, 10, 30)))
    slope, fly, long_slope = (F.col("v10") - F.col("v2")) * 100, (2 * F.col("v5") - F.col("v2") - F.col("v10")) * 100, (F.col("v30") - F.col("v5")) * 100
    entry = lambda key, unit, v: F.struct(F.lit(key).alias("key"), F.lit(unit).alias("unit"), v.alias("value"))
    listed = lambda df, *x: df.select("country", "as_of_date", F.explode(F.array(*(entry(*e) for e in x))).alias("s")).select("country", "s.key", "s.unit", "as_of_date", "s.value").where("value is not null")
    of = lambda curve_set, basis: legs.where((F.col("country") == curated) & (F.col("curve_set") == curve_set) & (F.col("basis") == basis) & (F.col("rate_type") == "spot"))
    bonds = of("glc", "nominal")
    other = lambda df, name: df.select("country", "as_of_date", F.col("v10").alias(name))
    own = bonds.join(other(of("glc", "real"), "real"), ["country", "as_of_date"], "left").join(other(of("ois", "nominal"), "ois"), ["country", "as_of_date"], "left")
    own = listed(own, ("2s10s", "bp", slope), ("2s5s10s", "bp", fly), ("be10y", "%", F.col("v10") - F.col("real")), ("asw10y", "bp", (F.col("v10") - F.col("ois")) * 100))
    primary = primary_series(points).where(F.col("country") != curated).select(*SERIES)
    generic = listed(legs.join(primary, SERIES), ("2s10s", "bp", slope), ("2s5s10s", "bp", fly), ("5s30s", "bp", long_slope))
    sets = points.where(F.col("country") != curated).select(*SERIES).distinct()
    with_real = sets.where("basis = 'real' and rate_type <> 'forward'").select("country", "curve_set", F.col("rate_type").alias("real_type"))
    fitted = sets.where("basis = 'inflation'").select("country")
    pairs = primary.join(with_real, ["country", "curve_set"]).join(fitted, "country", "left_anti")
    nominal = as_arrays(points.join(pairs, SERIES), ["country", "as_of_date"])
    keys = pairs.select("country", "curve_set", F.col("real_type").alias("rate_type"))
    real = as_arrays(points.where("basis = 'real'").join(keys, ["country", "curve_set", "rate_type"]), ["country", "as_of_date"]).withColumnRenamed("curve", "real_curve")
    even = nominal.join(real, ["country", "as_of_date"]).select("country", F.lit("be10y").alias("key"), F.lit("%").alias("unit"), "as_of_date", breakeven(F.col("curve"), F.col("real_curve"), 10).alias("value"))
    return own.unionByName(generic).unionByName(even.where("value is not null"))


def curve_movie(points: DataFrame, by: list[str], n: int) -> DataFrame:
    """Each series' curves on n of its days, evenly spaced: the first and the last are among them."""
    days = points.select(*by, "as_of_date").distinct()
    over = W.partitionBy(*by)
    days = days.withColumns({"i": F.row_number().over(over.orderBy("as_of_date")) - 1, "m": F.count(F.lit(1)).over(over)})
    step = (F.col("m") - 1) / F.lit(max(1, n - 1))
    shown = days.where((F.col("m") <= n) | (F.round(F.round(F.col("i") / F.greatest(step, F.lit(1e-9))) * step) == F.col("i")))
    return points.join(shown.select(*by, "as_of_date"), [*by, "as_of_date"])


def complete_days(points: DataFrame, by: list[str]) -> DataFrame:
    """Points less the days at the end on which not all of the series are there."""
    width = points.select(*by).distinct().agg(F.count(F.lit(1)).alias("width"))
    days = points.groupBy("as_of_date").agg(F.countDistinct(*by).alias("k")).crossJoin(F.broadcast(width))
    last = days.where("k = width").agg(F.max("as_of_date").alias("last_full"))
    return points.crossJoin(F.broadcast(last)).where("as_of_date <= last_full").drop("last_full")


def forward_spot_gaps(spot: DataFrame, forward: DataFrame, tolerance: float) -> DataFrame:
    """Tenors at which the mean of forwards, by trapezoids, leaves the spot rate by more than tolerance."""
    over = W.partitionBy("as_of_date").orderBy("tenor")
    prev_t, prev_v = F.lag("tenor").over(over), F.lag("value").over(over)
    area = F.when(prev_t.isNull(), F.col("value") * F.col("tenor")).otherwise((F.col("value") + prev_v) / 2 * (F.col("tenor") - prev_t))
    rows = forward.withColumn("a", area).withColumn("mean", F.sum("a").over(over) / F.col("tenor"))
    both = rows.select("as_of_date", "tenor", "mean").join(spot.select("as_of_date", "tenor", F.col("value").alias("spot")), ["as_of_date", "tenor"])
    return both.withColumn("gap", F.abs(F.col("mean") - F.col("spot"))).where(F.col("gap") > tolerance)


def inflation_gaps(points: DataFrame, tolerance: float) -> DataFrame:
    """(country, curve_set, as_of_date, tenor, gap) where a published inflation curve leaves the difference of the
    nominal and real ones by more than tolerance."""
    at = lambda basis: F.max(F.when(F.col("basis") == basis, F.col("value")))
    rows = points.where("rate_type <> 'forward'").groupBy("country", "curve_set", "as_of_date", "tenor").agg(at("nominal").alias("nominal"), at("real").alias("real"), at("inflation").alias("inflation"))
    gap = F.abs(F.col("nominal") - F.col("real") - F.col("inflation"))
    return rows.withColumn("gap", gap).where(F.col("gap") > tolerance).select("country", "curve_set", "as_of_date", "tenor", "gap")


def stale_by_cadence(dates: DataFrame, key: str, as_of, floor_days: int = 5, last_gaps: int = 10) -> DataFrame:
    """(key, last, median_gap, days_behind, stale): a series may lag max(floor, twice the median of its last gaps)."""
    over = W.partitionBy(key).orderBy("obs_date")
    rows = dates.select(key, "obs_date").distinct().withColumn("gap", F.datediff("obs_date", F.lag("obs_date").over(over)))
    recent = rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc("obs_date")))).where(F.col("nth") <= last_gaps)
    out = recent.groupBy(key).agg(F.max("obs_date").alias("last"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    behind = F.datediff(F.lit(as_of).cast("date"), "last")
    return out.select(key, "last", "median_gap", behind.alias("days_behind"), (behind > F.greatest(F.lit(float(floor_days)), 2 * F.coalesce("median_gap", F.lit(0.0)))).alias("stale"))
