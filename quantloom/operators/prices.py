"""Daily bars: validation, gaps, anomalies, split adjustment, total-return index."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .asof import asof_backward, asof_forward

def series_window():
    return W.partitionBy("entity").orderBy("session_date")


def bar_fault() -> Column:
    """The first reason for which a bar is refused, or null."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return (
        F.when(~(finite(o) & finite(h) & finite(low) & finite(c)), "not a number")
        .when((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "non-positive price")
        .when(h < low, "high below low")
        .when((o > h) | (o < low) | (c > h) | (c < low), "outside high and low")
        .when(v < 0, "negative volume")
    )


def refused_bars(bars: DataFrame) -> DataFrame:
    """(bar, reason) of refused bars; of a date's bars the first is fine, the others are duplicates."""
    nth = F.row_number().over(W.partitionBy("entity", "session_date").orderBy("close", "volume"))
    reason = F.coalesce(bar_fault(), F.when(F.col("nth") > 1, "duplicate date"))
    return bars.withColumn("nth", nth).withColumn("reason", reason).where("reason is not null").drop("nth")


def gaps(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(entity, session_date): sessions from an entity's first bar on a session to the calendar's end that have no bar."""
    sessions = calendar.select("session_date").distinct().withColumn("i", F.row_number().over(W.orderBy("session_date")))
    last = sessions.agg(F.max("i").alias("last"))
    # between a bar and the next lie the sessions that are due: only those are made
    placed = prices.select("entity", "session_date").distinct().join(F.broadcast(sessions), "session_date").crossJoin(F.broadcast(last))
    nxt = F.coalesce(F.lead("i").over(W.partitionBy("entity").orderBy("i")), F.col("last") + 1)
    due = placed.withColumn("next_i", nxt).where("next_i > i + 1").select("entity", F.explode(F.sequence(F.col("i") + 1, F.col("next_i") - 1)).alias("i"))
    return due.join(F.broadcast(sessions), "i").select("entity", "session_date")


def split_factor(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds factor, the exact product of the ratios of splits after the session; 1 where there is none."""
    later = W.partitionBy("entity").orderBy(F.desc("ex_date")).rowsBetween(W.unboundedPreceding, 0)
    one = F.lit(1).cast("decimal(38,12)")
    product = F.aggregate(F.collect_list("ratio").over(later), one, lambda a, r: (a * r).cast("decimal(38,12)"))
    ahead = splits.select("entity", "ex_date", product.alias("factor"))
    out = asof_forward(prices, ahead, ["entity"], "session_date", "ex_date", ["factor"], strict=True)
    return out.drop("matched_date").withColumn("factor", F.coalesce("factor", one))


def split_adjusted(prices: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds factor and adj_close: close by the product of later splits' ratios."""
    out = split_factor(prices, splits)
    return out.withColumn("adj_close", F.col("close") / F.col("factor").cast("double"))


def total_return_index(adjusted: DataFrame, dividends: DataFrame) -> DataFrame:
    """Adds tri: adj_close with dividends reinvested at the first priced bar on or after their ex-date.

    Dividends before the first bar are dropped, those on it count. Without dividends tri is adj_close exactly.
    """
    priced = adjusted.where("adj_close > 0").select("entity", "session_date")
    first = adjusted.groupBy("entity").agg(F.min("session_date").alias("first"))
    due = dividends.join(first, "entity").where("ex_date >= first").select("entity", "ex_date", "amount")
    due = asof_forward(due, priced.withColumn("paid", F.col("session_date")), ["entity"], "ex_date", "session_date", ["paid"])
    due = due.where("paid is not null").groupBy("entity", F.col("paid").alias("session_date")).agg(F.sum("amount").alias("dividend"))
    out = adjusted.join(due, ["entity", "session_date"], "left")
    step = F.when(F.col("dividend").isNotNull() & (F.col("adj_close") > 0), F.log1p(F.col("dividend") / F.col("adj_close"))).otherwise(F.lit(0.0))
    grown = F.sum(step).over(series_window())
    paid = F.count("dividend").over(series_window())
    return out.withColumn("tri", F.when(paid == 0, F.col("adj_close")).otherwise(F.col("adj_close") * F.exp(grown))).drop("dividend")


def daily_returns(prices: DataFrame, value: str = "close") -> DataFrame:
    """(entity, session_date, ret) from bar to bar; a price of zero or less breaks the chain."""
    prev = F.lag(value).over(series_window())
    rows = prices.select("entity", "session_date", F.col(value).alias("v"), prev.alias("prev"))
    return rows.where((F.col("v") > 0) & (F.col("prev") > 0)).select("entity", "session_date", (F.col("v") / F.col("prev") - 1).alias("ret"))


def anomalies(prices: DataFrame, splits: DataFrame, calendar: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """(entity, session_date, flag, pct_move, off_calendar): split-adjusted moves beyond limit against the bar
    before, else prices on days that are no session. A jump on such a day is a jump, and says so."""
    adj = split_adjusted(prices, splits)
    prev = F.lag("adj_close").over(series_window())
    rows = adj.select("entity", "session_date", (F.col("adj_close") / F.when(prev > 0, prev) - 1).alias("pct_move"))
    if calendar is not None:
        days = calendar.select("session_date", F.lit(True).alias("session")).distinct()
        rows = rows.join(F.broadcast(days), "session_date", "left").withColumn("off_calendar", F.col("session").isNull())
    else:
        rows = rows.withColumn("off_calendar", F.lit(False))
    flag = F.when(F.abs("pct_move") > limit, "price jump").when(F.col("off_calendar"), "non-trading day")
    return rows.withColumn("flag", flag).where("flag is not null").select("entity", "session_date", "flag", "pct_move", "off_calendar")


def divergence(stored: DataFrame, fetched: DataFrame, tolerance: float) -> DataFrame:
    """Stored closes that a second fetch contradicts by more than a relative tolerance."""
    both = stored.select("entity", "session_date", F.col("close").alias("old")).join(
        fetched.select("entity", "session_date", F.col("close").alias("new")), ["entity", "session_date"]
    )
    diff = F.abs(F.try_divide(F.col("new") - F.col("old"), F.col("old")))
    return both.withColumn("diff", diff).where(F.col("diff") > tolerance)


def change_points(series: DataFrame, key: str, date: str, value: str, arrival: str | None = None) -> DataFrame:
    """The first value of each key and each that differs from the one before; of one date the last to arrive counts."""
    if arrival:
        series = series.groupBy(key, date).agg(F.max_by(value, arrival).alias(value))
    over = W.partitionBy(key).orderBy(date)
    same = F.col(value).eqNullSafe(F.lag(value).over(over)) & (F.row_number().over(over) > 1)
    return series.select(key, date, value, same.alias("__same")).where("not __same").drop("__same")


def plausible(series: DataFrame, key: str, date: str, value: str, limit: float, relative: bool = True) -> DataFrame:
    """Adds accepted: whether a value lies within limit of the last accepted one; a rejected value does not move
    it, and a null value is not accepted.

    Each key's rows pass in order through one task, which holds a batch and the last accepted value, whatever
    the length of a history: Python, for the fold has no closed form that windows could express.
    """

    def run(batches):
        last_key, prev = object(), None
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            accepted = []
            for k, v in zip(keys, values):
                if k != last_key:
                    last_key, prev = k, None
                ok = v is not None and (prev is None or abs(v - prev) <= (limit * abs(prev) if relative else limit))
                if ok:
                    prev = v
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_())], [key, date, value, "accepted"])

    rows = series.select(key, date, value)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(key).sortWithinPartitions(key, date, value).mapInArrow(run, f"{kinds}, accepted boolean")
