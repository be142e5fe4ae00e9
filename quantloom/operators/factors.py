"""Cross-sectional factors: raw values, winsorised scores, ranks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import latest


@dataclass(frozen=True)
class Factor:
    key: str
    name: str
    direction: str  # which end is favoured: high or low
    inputs: tuple[str, ...]
    raw: Callable[..., DataFrame]


CATALOGUE: dict[str, Factor] = {}


class MissingInput(KeyError):
    """A factor's input that the caller has not given."""


def factor(key: str, name: str, direction: str, *inputs: str):
    def add(f):
        CATALOGUE[key] = Factor(key, name, direction, inputs, f)
        return f

    return add


@factor("mom_12_1", "Momentum, 12 months less the last", "high", "returns")
def momentum(as_of, returns: DataFrame) -> DataFrame:
    """(entity, raw): (1 + 1Y) / (1 + 1M) - 1 of exact as_of rows. One pass, no self-join."""
    at = returns.where((F.col("as_of_date") == F.lit(as_of)) & F.col("code").isin("1Y", "1M"))
    both = at.groupBy("entity").agg(F.max(F.when(F.col("code") == "1Y", F.col("pr"))).alias("y"), F.max(F.when(F.col("code") == "1M", F.col("pr"))).alias("m"))
    return both.select("entity", (F.try_divide(1 + F.col("y"), 1 + F.col("m")) - 1).alias("raw")).where("raw is not null")


@factor("vol_1y", "Volatility, 1 year", "low", "daily")
def volatility(as_of, daily: DataFrame, least: int = 60) -> DataFrame:
    day = F.lit(as_of).cast("date")
    at = daily.where((F.col("session_date") > F.date_sub(day, 365)) & (F.col("session_date") <= day))
    out = at.groupBy("entity").agg(F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n"))
    return out.where(F.col("n") >= least).select("entity", (F.col("sd") * math.sqrt(252)).alias("raw"))


@factor("sharpe_tr", "Sharpe ratio, 1 year", "high", "metrics")
def sharpe(as_of, metrics: DataFrame) -> DataFrame:
    at = metrics.where((F.col("as_of_date") == F.lit(as_of)) & (F.col("window_id") == 11) & ~F.col("gated"))
    return at.select("entity", F.col("sharpe").alias("raw")).where("raw is not null")


@factor("size", "Size", "low", "caps")
def size(as_of, caps: DataFrame) -> DataFrame:
    return latest(caps.where("market_cap_usd > 0").select("entity", "as_of_date", "market_cap_usd"), ["entity"], "as_of_date", as_of).select("entity", F.col("market_cap_usd").alias("raw"))


@factor("wiki_attention", "Attention, a week against a month", "high", "attention")
def attention(as_of, attention: DataFrame, least_week: int = 5, least_month: int = 15) -> DataFrame:
    day = F.lit(as_of).cast("date")
    at = attention.where((F.col("obs_date") > F.date_sub(day, 30)) & (F.col("obs_date") <= day))
    week = F.when(F.col("obs_date") > F.date_sub(day, 7), F.col("value"))
    out = at.groupBy("entity").agg(F.avg(week).alias("w"), F.count(week).alias("nw"), F.avg("value").alias("m"), F.count("value").alias("nm"))
    return out.where((F.col("nw") >= least_week) & (F.col("nm") >= least_month)).select("entity", F.try_divide(F.col("w"), F.when(F.col("m") != 0, F.col("m"))).alias("raw")).where("raw is not null")


@factor("fiscal_sens", "Sensitivity to debt", "low", "daily", "series")
def sensitivity(as_of, daily: DataFrame, series: DataFrame, least: int = 60) -> DataFrame:
    """|β| of daily returns on a series' relative changes, matched on dates of the last year."""
    day = F.lit(as_of).cast("date")
    lead_in = series.where((F.col("obs_date") > F.date_sub(day, 372)) & (F.col("obs_date") <= day))
    over = W.orderBy("obs_date")  # one series of a year
    change = lead_in.select(F.col("obs_date").alias("session_date"), (F.try_divide(F.col("value"), F.lag("value").over(over)) - 1).alias("x"))
    change = change.where((F.col("session_date") > F.date_sub(day, 365)) & F.col("x").isNotNull())
    out = daily.join(F.broadcast(change), "session_date").groupBy("entity").agg(F.covar_samp("ret", "x").alias("c"), F.var_samp("x").alias("v"), F.count("ret").alias("n"))
    return out.where((F.col("n") >= least) & (F.col("v") > 0)).select("entity", F.abs(F.col("c") / F.col("v")).alias("raw"))


def winsorised(raw: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """raw within its values at positions int(0.01 n) and min(n - 1, int(0.99 n)), where there are 5 at least."""
    all_ = W.partitionBy(*by)
    pos = F.row_number().over(all_.orderBy("raw")) - 1
    rows = raw.withColumns({"__i": pos, "__n": F.count(F.lit(1)).over(all_)})
    low = F.max(F.when(F.col("__i") == F.floor(0.01 * F.col("__n")), F.col("raw"))).over(all_)
    high = F.max(F.when(F.col("__i") == F.least(F.col("__n") - 1, F.floor(0.99 * F.col("__n"))), F.col("raw"))).over(all_)
    rows = rows.withColumns({"__lo": low, "__hi": high})
    return rows.withColumn("raw", F.when(F.col("__n") < 5, F.col("raw")).otherwise(F.least(F.greatest("raw", "__lo"), "__hi"))).drop("__i", "__n", "__lo", "__hi")


def scores(raw: DataFrame, direction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(entity, raw, zscore, rank, pctile): population z, positive where favoured, rank 1 the best, ties by entity."""
    sign = 1 if direction == "high" else -1
    rows = winsorised(raw, by)
    all_ = W.partitionBy(*by)
    sd = F.stddev_pop("raw").over(all_)
    z = F.when(sd > 0, sign * (F.col("raw") - F.avg("raw").over(all_)) / sd).otherwise(F.lit(0.0))
    best = F.row_number().over(all_.orderBy(F.col("raw") * -sign, "entity"))
    n = F.count(F.lit(1)).over(all_)
    return rows.withColumns({"zscore": z, "rank": best, "__n": n}).withColumn("pctile", (F.col("__n") - F.col("rank")) / F.col("__n")).drop("__n")


def top(scored: DataFrame, n: int, best: bool = True) -> DataFrame:
    return scored.orderBy("rank" if best else F.desc("rank")).limit(n)


def run(keys: list[str], as_of, members: DataFrame, inputs: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Scores of each factor among the members, and why the others were skipped."""
    out, skipped = None, {}
    for key in keys:
        f = CATALOGUE.get(key)
        if f is None:
            skipped[key] = "unknown factor"
            continue
        missing = [i for i in f.inputs if i not in inputs]
        if missing:
            skipped[key] = f"no {', '.join(missing)}"
            continue
        raw = f.raw(as_of, **{i: inputs[i] for i in f.inputs}).join(members.select("entity").distinct(), "entity", "left_semi")
        rows = scores(raw, f.direction).select(F.lit(key).alias("factor_key"), F.lit(as_of).cast("date").alias("as_of_date"), "entity", "raw", "zscore", "rank", "pctile")
        out = rows if out is None else out.unionByName(rows)
    return out, skipped


def catalogue_counts(scored: DataFrame) -> DataFrame:
    """(factor_key, name, direction, runs, last, names): every factor, and what the scores hold of it."""
    rows = [(f.key, f.name, f.direction) for f in CATALOGUE.values()]
    have = scored.groupBy("factor_key").agg(F.countDistinct("as_of_date").alias("runs"), F.max("as_of_date").alias("last"), F.countDistinct("entity").alias("names"))
    return scored.sparkSession.createDataFrame(rows, "factor_key string, name string, direction string").join(have, "factor_key", "left").fillna(0, ["runs", "names"])
