"""Walk-forward backtests: selection, weights, holding-period returns, costs, statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_backward, asof_forward

HURDLE_T = 3.0
SCHEMES = ("equal", "cap", "inverse_vol", "neutral")


class SpecError(ValueError):
    """A run that cannot be: which part of the spec, and why."""


def checked(spec: dict) -> dict:
    """The spec with defaults; contradictions are refused, never resolved silently."""
    out = {"direction": "high", "scheme": "equal", "top_n": None, "pct": None, "period": "quarter", "cost_bps": 0.0, "borrow_bps": 0.0, "legs": "long", "keep_mult": None} | spec
    if out["direction"] not in ("high", "low"):
        raise SpecError(f"direction {out['direction']!r}: high or low")
    if out["scheme"] not in (*SCHEMES, "min_variance"):
        raise SpecError(f"scheme {out['scheme']!r}: one of {', '.join(SCHEMES)}, min_variance")
    if (out["top_n"] is None) == (out["pct"] is None):
        raise SpecError("either top_n or pct")
    if out["top_n"] is not None and out["top_n"] < 1 or out["pct"] is not None and not 0 < out["pct"] <= 1:
        raise SpecError("top_n from 1, pct over 0 up to 1")
    if out["period"] not in ("month", "quarter"):
        raise SpecError(f"period {out['period']!r}: month or quarter")
    if out["cost_bps"] < 0 or out["borrow_bps"] < 0:
        raise SpecError("costs from 0")
    if out["legs"] not in ("long", "long_short"):
        raise SpecError(f"legs {out['legs']!r}: long or long_short")
    if out["legs"] == "long" and (out["borrow_bps"] or out["scheme"] == "neutral"):
        raise SpecError("borrowing and neutral weights need a short leg")
    if out["keep_mult"] is not None and (out["keep_mult"] < 1 or out["legs"] == "long"):
        raise SpecError("keep_mult from 1, with long_short legs")
    return out


def covered(factor: DataFrame, roster: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """Rows of dates whose members with a value are max(least, int(share * members)) at least."""
    sizes = roster.groupBy("rebalance_date").agg(F.countDistinct("entity").alias("members"))
    rows = factor.join(roster.select("rebalance_date", "entity").distinct(), ["rebalance_date", "entity"])
    n = F.count(F.lit(1)).over(W.partitionBy("rebalance_date"))
    rows = rows.withColumn("__n", n).join(F.broadcast(sizes), "rebalance_date")
    return rows.where(F.col("__n") >= F.greatest(F.lit(least), F.floor(share * F.col("members")))).drop("__n", "members")


def selected(factor: DataFrame, direction: str = "high", top_n: int | None = None, pct: float | None = None) -> DataFrame:
    """Each date's best names: top_n, or max(1, ceil(pct n)); ties by entity. All dates at once."""
    sign = -1 if direction == "high" else 1
    day = W.partitionBy("rebalance_date")
    rows = factor.withColumns({"__r": F.row_number().over(day.orderBy(F.col("value") * sign, "entity")), "__n": F.count(F.lit(1)).over(day)})
    keep = F.lit(top_n) if top_n is not None else F.greatest(F.lit(1), F.ceil(F.col("__n") * pct))
    return rows.where(F.col("__r") <= keep).drop("__r", "__n")


def sticky_legs(factor: DataFrame, n_long: int, n_short: int, keep_mult: float = 1.5, by: tuple[str, ...] = (), most: int = 5_000_000) -> DataFrame:
    """(by, rebalance_date, entity, leg): names held stay while they rank within keep_mult times the leg's size;
    the best others fill it; no name is in both legs. A fold over dates, of one row a date and name, for each
    strategy or universe that the columns by tell apart; a fold of over most rows is refused."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise SpecError(f"{len(pdf)} dates by names in one fold; at most {most}")
        held: dict[str, list] = {"long": [], "short": []}
        out = []
        for day, rows in pdf.sort_values("rebalance_date").groupby("rebalance_date", sort=True):
            ranked = rows.sort_values(["value", "entity"], ascending=[False, True]).entity.tolist()
            taken: set = set()
            for leg, order, n in (("long", ranked, n_long), ("short", ranked[::-1], n_short)):
                order = [e for e in order if e not in taken]
                band = set(order[: int(n * keep_mult)])
                stay = [e for e in order if e in held[leg] and e in band][:n]
                held[leg] = stay + [e for e in order if e not in stay][: n - len(stay)]
                taken |= set(held[leg])
                out += [(day, e, leg) for e in held[leg]]
        out = pd.DataFrame(out, columns=["rebalance_date", "entity", "leg"])
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    kinds = dict(factor.dtypes)
    schema = f"rebalance_date {kinds['rebalance_date']}, entity {kinds['entity']}, leg string"
    schema = ", ".join([schema, *(f"{c} {kinds[c]}" for c in by)])
    return factor.select("rebalance_date", "entity", "value", *by).groupBy(*by).applyInPandas(run, schema)


def weights(names: DataFrame, scheme: str = "equal", aux: DataFrame | None = None) -> DataFrame:
    """(rebalance_date, entity, weight) of selected names. cap: by aux, positive ones; inverse_vol: by 1 / aux with
    60 observations (n_obs); neutral: halves for leg long and short."""
    day = W.partitionBy("rebalance_date")
    if scheme == "equal":
        rows = names.withColumn("m", F.lit(1.0))
    elif scheme == "neutral":
        side = F.when(F.col("leg") == "long", 1.0).otherwise(-1.0)
        return names.withColumn("weight", 0.5 * side / F.count(F.lit(1)).over(W.partitionBy("rebalance_date", "leg"))).select("rebalance_date", "entity", "weight")
    else:
        rows = names.join(aux, ["rebalance_date", "entity"])
        rows = rows.where("aux > 0").withColumn("m", F.col("aux")) if scheme == "cap" else rows.where("aux > 0 and n_obs >= 60").withColumn("m", 1 / F.col("aux"))
    return rows.withColumn("weight", F.col("m") / F.sum("m").over(day)).select("rebalance_date", "entity", "weight")


def holding_returns(held: DataFrame, daily: DataFrame, last=None) -> DataFrame:
    """(session_date, rebalance_date, ret, gross) of days in (rebalance, next rebalance]: Σ w r over Σ |w| of names
    that have a return. Each day looks up its rebalance date in a list of calendar days: no range join."""
    over = W.orderBy("rebalance_date")
    spans = held.select("rebalance_date").distinct().withColumn("until", F.lead("rebalance_date").over(over))
    stop = daily.agg(F.max("session_date").alias("stop"))
    until = F.coalesce("until", F.lit(last).cast("date") if last is not None else F.col("stop"))
    spans = spans.crossJoin(F.broadcast(stop)).withColumn("until", until).where("until > rebalance_date")
    days = spans.select("rebalance_date", F.explode(F.sequence(F.date_add("rebalance_date", 1), F.col("until"), F.expr("interval 1 day"))).alias("session_date"))
    rows = daily.join(F.broadcast(days), "session_date").join(held, ["rebalance_date", "entity"])
    out = rows.groupBy("session_date", "rebalance_date").agg(F.sum(F.col("weight") * F.col("ret")).alias("c"), F.sum(F.abs("weight")).alias("g"))
    return out.select("session_date", "rebalance_date", F.try_divide(F.col("c"), F.col("g")).alias("ret"), F.col("g").alias("gross"))


def turnover(held: DataFrame) -> DataFrame:
    """(rebalance_date, turnover): half of Σ |Δw|; the first is from nothing."""
    over = W.orderBy("rebalance_date")
    dates = held.select("rebalance_date").distinct().withColumn("next_date", F.lead("rebalance_date").over(over))
    before = held.join(F.broadcast(dates), "rebalance_date").where("next_date is not null").select(F.col("next_date").alias("rebalance_date"), "entity", F.col("weight").alias("old"))
    both = held.join(before, ["rebalance_date", "entity"], "full")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    return both.groupBy("rebalance_date").agg((F.sum(change) / 2).alias("turnover"))


def net_returns(gross: DataFrame, held: DataFrame, cost_bps: float, borrow_bps: float = 0.0) -> DataFrame:
    """(session_date, ret, net): the cost of a rebalance falls on the first day from it on; borrowing accrues daily
    on the short gross of the holding whose rebalance is the last up to the day."""
    days = gross.select("session_date")
    # as-of joins of days and rebalances, a row a date each
    firsts = asof_forward(turnover(held), days, [], "rebalance_date", "session_date", []).withColumnRenamed("matched_date", "session_date").where("session_date is not null")
    costs = firsts.groupBy("session_date").agg(F.sum(F.col("turnover") * cost_bps / 1e4).alias("cost"))
    short = held.groupBy("rebalance_date").agg(F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short"))
    borrow = asof_backward(days, short, [], "session_date", "rebalance_date", ["short"]).select("session_date", (F.col("short") * borrow_bps / 1e4 / 252).alias("borrow"))
    rows = gross.select("session_date", "ret").join(costs, "session_date", "left")
    rows = rows.join(borrow, "session_date", "left") if borrow_bps else rows.withColumn("borrow", F.lit(0.0))
    return rows.withColumn("net", F.col("ret") - F.coalesce("cost", F.lit(0.0)) - F.coalesce("borrow", F.lit(0.0))).select("session_date", "ret", "net")


def equity(daily: DataFrame, value: str = "ret") -> DataFrame:
    """(session_date, curve, drawdown): the product of 1 + r, against its highest so far (its first point at least)."""
    over = W.orderBy("session_date")
    rows = daily.where(F.col(value).isNotNull()).select("session_date", F.exp(F.sum(F.log1p(F.col(value))).over(over)).alias("curve"))
    return rows.withColumn("drawdown", F.col("curve") / F.max("curve").over(over) - 1)


def statistics(daily: DataFrame, value: str = "ret") -> DataFrame:
    """One row: n, total, ann_return, ann_vol (population), sharpe, max_drawdown, t_stat, passes."""
    curve = equity(daily, value)
    low = curve.agg(F.min("drawdown").alias("max_drawdown"))
    rows = daily.where(F.col(value).isNotNull()).agg(F.count(value).alias("n"), F.exp(F.sum(F.log1p(F.col(value)))).alias("growth"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd"))
    rows = rows.select(
        "n", (F.col("growth") - 1).alias("total"), (F.pow("growth", F.try_divide(F.lit(252.0), F.col("n"))) - 1).alias("ann_return"), (F.col("sd") * math.sqrt(252)).alias("ann_vol"),
        (F.col("mean") / sd * math.sqrt(252)).alias("sharpe"), (F.col("mean") / sd * F.sqrt("n")).alias("t_stat"),
    )
    return rows.crossJoin(F.broadcast(low)).withColumn("passes", F.abs("t_stat") >= HURDLE_T)


def sweep(grid: dict[str, list], run_one) -> tuple[DataFrame, list[dict]]:
    """run_one(spec) -> (session_date, ret) for every point of a grid; all are tried, refusals kept with reasons.
    Returns (trial, session_date, ret) on the days that all trials have, and the trials."""
    import itertools

    out, trials = None, []
    for values in itertools.product(*grid.values()):
        spec = dict(zip(grid, values))
        try:
            rows = run_one(spec).select(F.lit(len(trials)).alias("trial"), "session_date", "ret")
            out = rows if out is None else out.unionByName(rows)
            trials.append(spec)
        except SpecError as e:
            trials.append(spec | {"refused": str(e)})
    if out is None:
        raise SpecError("no point of the grid can run")
    n = sum("refused" not in t for t in trials)
    days = out.groupBy("session_date").agg(F.countDistinct("trial").alias("k")).where(F.col("k") == n).select("session_date")
    return out.join(F.broadcast(days), "session_date", "left_semi"), trials
