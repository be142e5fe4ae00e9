"""Foreign exchange around a US-dollar star: resolution, conversion, crosses, market capitalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_backward

PIVOT = "USD"
MAX_STALE_DAYS = 7
MAX_LEG_GAP_DAYS = 3
MAX_PRICE_AGE_DAYS = 30
#: earlier currencies are quoted as base against later ones
CONVENTION = ("EUR", "GBP", "AUD", "NZD", "USD", "CAD", "CHF", "JPY")


def source_rank(source: Column, order: tuple[str, ...]) -> Column:
    """The place of a source in the order of trust; unknown ones come last."""
    out = F.lit(100)
    for i, name in reversed(list(enumerate(order, 1))):
        out = F.when(source == name, 10 * i).otherwise(out)
    return out


def resolve(asks: DataFrame, rates: DataFrame, sources: tuple[str, ...] = (), max_days: int = MAX_STALE_DAYS) -> DataFrame:
    """asks(ccy, as_of_date, ...) with rate (units of ccy for a dollar), observed, days_stale, is_filled and
    status ok, stale (withheld: older than max_days) or no_data; of one day's rates the most trusted source's.

    Some dozens of currencies are each asked by many rows: the distinct days are resolved, and joined to the asks.
    """
    rates = rates.select("ccy", F.col("as_of_date").alias("observed"), "rate", source_rank(F.col("source"), sources).alias("trust"))
    days = asks.select("ccy", "as_of_date").where("ccy is not null and as_of_date is not null").distinct()
    found = asof_backward(days, rates, ["ccy"], "as_of_date", "observed", ["rate"], prefer=[F.col("trust")])
    pivot = F.col("ccy") == PIVOT
    seen = F.when(pivot, F.col("as_of_date")).otherwise(F.col("matched_date"))
    stale = F.datediff("as_of_date", seen)
    status = F.when(seen.isNull(), "no_data").when(stale > max_days, "stale").otherwise("ok")
    found = found.withColumns({"observed": seen, "days_stale": stale, "status": status, "is_filled": F.coalesce(stale > 0, F.lit(False))})
    rate = F.when(pivot, F.lit(1.0)).when(F.col("status") == "ok", F.col("rate"))
    out = asks.join(found.withColumn("rate", rate).drop("matched_date"), ["ccy", "as_of_date"], "left")
    out = out.withColumns({"status": F.coalesce("status", F.lit("no_data")), "is_filled": F.coalesce("is_filled", F.lit(False))})
    return out.select(*asks.columns, "rate", "observed", "days_stale", "status", "is_filled")


def convert(asks: DataFrame, rates: DataFrame, sources: tuple[str, ...] = (), amount: str = "amount", max_gap: int = MAX_LEG_GAP_DAYS) -> DataFrame:
    """asks(amount, from_ccy, to_ccy, as_of_date, ...) with converted: over the dollar, null where a leg is
    missing or the legs were observed more than max_gap days apart; a currency into itself is itself."""
    legs = asks
    for side in ("from", "to"):
        legs = resolve(legs.withColumn("ccy", F.col(f"{side}_ccy")), rates, sources)
        legs = legs.withColumnsRenamed({"rate": f"{side}_rate", "observed": f"{side}_observed"}).drop("ccy", "days_stale", "status", "is_filled")
    near = F.coalesce(F.abs(F.datediff("from_observed", "to_observed")) <= max_gap, F.lit(False))
    # the dollar has a rate each day: it is never apart from the other leg
    near = near | (F.col("from_ccy") == PIVOT) | (F.col("to_ccy") == PIVOT)
    out = F.when(F.col("from_ccy") == F.col("to_ccy"), F.col(amount)).when(near, F.col(amount) * F.col("to_rate") / F.col("from_rate"))
    return legs.withColumn("converted", out).drop("from_observed", "to_observed")


def daily_filled(rates: DataFrame, max_days: int = MAX_STALE_DAYS) -> DataFrame:
    """(ccy, day, rate, is_filled) for each weekday from a currency's first rate to its last, the last rate carried on."""
    span = rates.groupBy("ccy").agg(F.min("as_of_date").alias("lo"), F.max("as_of_date").alias("hi"))
    days = span.select("ccy", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day")).where(F.weekday("day") < 5)
    out = asof_backward(days, rates.select("ccy", "as_of_date", "rate"), ["ccy"], "day", "as_of_date", ["rate"], cap_days=max_days)
    return out.select("ccy", "day", "rate", (F.col("matched_date") < F.col("day")).alias("is_filled")).where("rate is not null")


def source_divergence(rates: DataFrame, tolerance: float) -> DataFrame:
    """Days on which two sources' rates for a currency differ by more than a relative tolerance."""
    a = rates.select("ccy", "as_of_date", F.col("source").alias("source_a"), F.col("rate").alias("rate_a"))
    b = rates.select("ccy", "as_of_date", F.col("source").alias("source_b"), F.col("rate").alias("rate_b"))
    both = a.join(b, ["ccy", "as_of_date"]).where("source_a < source_b")
    return both.withColumn("diff", F.abs(F.try_divide(F.col("rate_b"), F.col("rate_a")) - 1)).where(F.col("diff") > tolerance)


def both_directions(rates: DataFrame) -> DataFrame:
    """(base, quote, as_of_date, rate): dollars into each currency, and each into dollars."""
    there = rates.select(F.lit(PIVOT).alias("base"), F.col("ccy").alias("quote"), "as_of_date", "rate")
    back = rates.select(F.col("ccy").alias("base"), F.lit(PIVOT).alias("quote"), "as_of_date", F.try_divide(F.lit(1.0), F.col("rate")).alias("rate"))
    return there.unionByName(back)


def rebased(rates: DataFrame, pivot: str = PIVOT, base: str = "EUR") -> DataFrame:
    """Rates for one unit of base as rates for one of pivot; days without the pivot's rate are skipped."""
    leg = rates.where(F.col("ccy") == pivot).select("as_of_date", F.col("rate").alias("p"))
    out = rates.where(F.col("ccy") != pivot).join(leg, "as_of_date").select("ccy", "as_of_date", F.try_divide(F.col("rate"), F.col("p")).alias("rate"))
    return out.unionByName(leg.select(F.lit(base).alias("ccy"), "as_of_date", F.try_divide(F.lit(1.0), F.col("p")).alias("rate")))


def per_dollar(rate: Column, quoted_in_dollars: Column) -> Column:
    return F.when(quoted_in_dollars, F.try_divide(F.lit(1.0), rate)).otherwise(rate)


def conventional(a: Column, b: Column) -> Column:
    """Whether a is the pair's base by market convention; other currencies come after, by name."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, CONVENTION)), c), F.lit(0))
    ra, rb = (F.when(rank(c) == 0, F.lit(100)).otherwise(rank(c)) for c in (a, b))
    return (ra < rb) | ((ra == rb) & (a < b))


def cross_matrix(rates: DataFrame, as_of, sources: tuple[str, ...] = ()) -> DataFrame:
    """(base, quote, rate, change, days_stale, conventional): every pair of currencies at the latest day up to as_of
    and the change against the day before that the currency has."""
    day = rates.where(F.col("as_of_date") <= F.lit(as_of)).withColumn("trust", source_rank(F.col("source"), sources))
    one = W.partitionBy("ccy", "as_of_date").orderBy("trust", "source")
    day = day.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    back = W.partitionBy("ccy").orderBy(F.desc("as_of_date"))
    day = day.withColumn("back", F.row_number().over(back)).where("back <= 2").groupBy("ccy").agg(
        F.max(F.when(F.col("back") == 1, F.col("rate"))).alias("now"), F.max(F.when(F.col("back") == 2, F.col("rate"))).alias("before"), F.max("as_of_date").alias("seen")
    )
    dollar = day.sparkSession.range(1).select(F.lit(PIVOT).alias("ccy"), F.lit(1.0).alias("now"), F.lit(1.0).alias("before"), F.lit(as_of).cast("date").alias("seen"))
    day = day.unionByName(dollar)
    a, b = (day.select(*(F.col(c).alias(f"{c}_{s}") for c in day.columns)) for s in "ab")
    grid = a.crossJoin(F.broadcast(b)).where("ccy_a <> ccy_b")  # currencies by currencies
    rate = F.try_divide(F.col("now_b"), F.col("now_a"))
    return grid.select(
        F.col("ccy_a").alias("base"), F.col("ccy_b").alias("quote"), rate.alias("rate"),
        (F.try_divide(rate, F.try_divide(F.col("before_b"), F.col("before_a"))) - 1).alias("change"),
        F.greatest(F.datediff(F.lit(as_of).cast("date"), "seen_a"), F.datediff(F.lit(as_of).cast("date"), "seen_b")).alias("days_stale"),
        conventional(F.col("ccy_a"), F.col("ccy_b")).alias("conventional"),
    )


def market_caps(asks: DataFrame, prices: DataFrame, shares: DataFrame, rates: DataFrame, currency: DataFrame, sources: tuple[str, ...] = ()) -> DataFrame:
    """asks(entity, as_of_date) with market_cap_lcy and market_cap_usd: the last raw close, at most 30 days old,
    by the last reported shares, at the resolved rate; null where one of them is missing."""
    out = asof_backward(asks, prices.select("entity", "session_date", "close"), ["entity"], "as_of_date", "session_date", ["close"], cap_days=MAX_PRICE_AGE_DAYS).drop("matched_date")
    reported = shares.select("entity", F.col("as_of_date").alias("reported"), "shares")
    out = asof_backward(out, reported, ["entity"], "as_of_date", "reported", ["shares"]).drop("matched_date")
    out = out.withColumn("market_cap_lcy", F.col("close") * F.col("shares")).join(currency, "entity", "left")
    out = resolve(out, rates, sources)
    return out.withColumn("market_cap_usd", F.try_divide(F.col("market_cap_lcy"), F.col("rate"))).drop("observed", "days_stale", "is_filled")
