"""Portfolios with effective-dated weights: daily series, performance, profit and loss, attribution, exposures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import steps

MIN_COVERAGE = 0.99
MIN_OBS = 20


def daily_series(weights: DataFrame, daily: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(portfolio_id, session_date, ret, coverage): Σ w r / Σ |w| priced, by the weights effective before the day.
    Days on which less than min_coverage of |w| has a return are left out."""
    spans = steps(weights, ["portfolio_id"], "as_of_date", ["entity", "weight"])
    gross = spans.groupBy("portfolio_id", "effective_from").agg(F.sum(F.abs("weight")).alias("all_w"))
    # each portfolio's vector of each calendar day makes the join with returns an equality
    stop = daily.agg(F.max("session_date").alias("stop"))
    vectors = spans.select("portfolio_id", "effective_from", "effective_to").distinct().crossJoin(F.broadcast(stop))
    vectors = vectors.withColumn("until", F.coalesce("effective_to", "stop")).where("until > effective_from")
    days = vectors.select("portfolio_id", "effective_from", F.explode(F.sequence(F.date_add("effective_from", 1), F.col("until"), F.expr("interval 1 day"))).alias("session_date"))
    days = days.join(F.broadcast(daily.select("session_date").distinct()), "session_date", "left_semi")
    held = days.join(spans.select("portfolio_id", "effective_from", "entity", "weight"), ["portfolio_id", "effective_from"])
    rows = held.join(daily, ["session_date", "entity"]).groupBy("portfolio_id", "session_date", "effective_from").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("c"), F.sum(F.abs("weight")).alias("w")
    )
    rows = rows.join(gross, ["portfolio_id", "effective_from"])
    out = rows.select("portfolio_id", "session_date", F.try_divide(F.col("c"), F.col("w")).alias("ret"), F.try_divide(F.col("w"), F.col("all_w")).alias("coverage"))
    return out.where(F.col("coverage") >= min_coverage)


def performance(series: DataFrame, benchmark: DataFrame, since=None) -> DataFrame:
    """A row for each portfolio: n, twr, ann_return, ann_vol, sharpe, beta, alpha, corr, tracking_error,
    information_ratio, hit, batting, slugging; nulls with fewer than 20 days."""
    rows = series.join(benchmark.select("session_date", F.col("ret").alias("b")), "session_date")
    if since is not None:
        rows = rows.where(F.col("session_date") > F.lit(since))
    rows = rows.withColumn("x", F.col("ret") - F.col("b"))
    up, down = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    agg = rows.groupBy("portfolio_id").agg(
        F.count("ret").alias("n"), F.exp(F.sum(F.log1p("ret"))).alias("g"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.avg("b").alias("mb"), F.covar_samp("ret", "b").alias("cov"), F.var_samp("b").alias("vb"),
        F.corr("ret", "b").alias("corr"), F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit"), F.avg(F.when(F.col("x") > 0, 1.0).otherwise(0.0)).alias("batting"), F.try_divide(up, -down).alias("slugging"),
    )
    enough = F.col("n") >= MIN_OBS
    year = math.sqrt(252)
    beta = F.try_divide(F.col("cov"), F.col("vb"))
    show = lambda c, name: F.when(enough, c).alias(name)
    return agg.select(
        "portfolio_id", "n", (F.col("g") - 1).alias("twr"), show(F.pow("g", F.try_divide(F.lit(252.0), F.col("n"))) - 1, "ann_return"), show(F.col("sd") * year, "ann_vol"),
        show(F.try_divide(F.col("m"), F.col("sd")) * year, "sharpe"), show(beta, "beta"), show((F.col("m") - beta * F.col("mb")) * 252, "alpha"), show(F.col("corr"), "corr"),
        show(F.col("sx") * year, "tracking_error"), show(F.try_divide(F.col("mx"), F.col("sx")) * year, "information_ratio"), show(F.col("hit"), "hit"), show(F.col("batting"), "batting"), show(F.col("slugging"), "slugging"),
    )


def profit_and_loss(series: DataFrame, as_of, notional: float) -> DataFrame:
    """(portfolio_id, day, mtd, ytd): the last day's, the month's and the year's linked return in money."""
    day = F.lit(as_of).cast("date")
    rows = series.where((F.col("session_date") <= day) & (F.col("session_date") >= F.trunc(day, "year")))
    last = F.max("session_date").over(W.partitionBy("portfolio_id"))
    rows = rows.withColumn("last", last)
    linked = lambda c: (F.exp(F.sum(F.when(c, F.log1p("ret")).otherwise(0.0))) - 1) * notional
    return rows.groupBy("portfolio_id").agg(linked(F.col("session_date") == F.col("last")).alias("day"), linked(F.col("session_date") >= F.trunc("last", "month")).alias("mtd"), linked(F.lit(True)).alias("ytd"))


def broad_date(facts: DataFrame, date: str, share: float = 0.9) -> DataFrame:
    """One row: the latest date that has at least share of the most rows that a date has."""
    days = facts.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    most = days.agg(F.max("n").alias("most"))
    return days.crossJoin(F.broadcast(most)).where(F.col("n") >= share * F.col("most")).agg(F.max(date).alias(date))


def attribution(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio_id, entity, weight, pr, contribution): the latest vector by returns of the latest broad date."""
    last = weights.groupBy("portfolio_id").agg(F.max("as_of_date").alias("as_of_date"))
    vector = weights.join(last, ["portfolio_id", "as_of_date"])
    at = returns.join(F.broadcast(broad_date(returns, "as_of_date")), "as_of_date").select("entity", "pr")
    return vector.join(at, "entity", "left").select("portfolio_id", "entity", "weight", "pr", (F.col("weight") * F.col("pr")).alias("contribution"))


def sector_rollup(parts: DataFrame, sectors: DataFrame, levels: tuple[str, ...] = ("sector",)) -> DataFrame:
    """(portfolio_id, levels, gross, ret) with subtotals, nested as levels are: a null level is the total of the one
    before, null portfolios all."""
    rows = parts.join(sectors, "entity", "left")
    priced = F.when(F.col("pr").isNotNull(), F.abs("weight"))
    return rows.rollup("portfolio_id", *levels).agg(F.sum(F.abs("weight")).alias("gross"), F.try_divide(F.sum(priced * F.col("pr")), F.sum(priced)).alias("ret"))


def exposures(weights: DataFrame) -> DataFrame:
    """(portfolio_id, as_of_date, net, gross, long, short, n)"""
    w = F.col("weight")
    return weights.groupBy("portfolio_id", "as_of_date").agg(F.sum(w).alias("net"), F.sum(F.abs(w)).alias("gross"), F.sum(F.greatest(w, F.lit(0.0))).alias("long"), F.sum(F.least(w, F.lit(0.0))).alias("short"), F.count(F.lit(1)).alias("n"))


def live(series_weights: DataFrame, quotes: DataFrame, closes: DataFrame, as_of) -> DataFrame:
    """(portfolio_id, ret, coverage, oldest, worst): latest weights by quotes over last closes; the oldest quote and the worst freshness."""
    last = series_weights.groupBy("portfolio_id").agg(F.max("as_of_date").alias("as_of_date"))
    vector = series_weights.join(last, ["portfolio_id", "as_of_date"])
    close = closes.groupBy("entity").agg(F.max_by("close", "session_date").alias("close"))
    rows = vector.join(quotes.select("entity", "price", "quoted_on"), "entity", "left").join(close, "entity", "left")
    move = F.try_divide(F.col("price"), F.when(F.col("close") > 0, F.col("close"))) - 1
    priced = F.when(move.isNotNull(), F.abs("weight"))
    days = F.max(F.datediff(F.lit(as_of).cast("date"), "quoted_on"))
    return rows.groupBy("portfolio_id").agg(
        F.try_divide(F.sum(F.col("weight") * move), F.sum(priced)).alias("ret"), F.try_divide(F.sum(priced), F.sum(F.abs("weight"))).alias("coverage"), F.min("quoted_on").alias("oldest"),
        F.when(F.count("price") == 0, "none").when(days <= 1, "live").when(days <= 4, "delayed").otherwise("stale").alias("worst"),
    )
