"""Catalogue and detail reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import latest
from .scd import current_or_latest


def security_detail(securities: DataFrame, labels: DataFrame, prices: DataFrame, caps: DataFrame, returns: DataFrame) -> DataFrame:
    """(entity, label, last_date, close, market_cap, returns): current label, latest bar and capitalisation, and the
    latest return of each window as a map."""
    last = prices.groupBy("entity").agg(F.max("session_date").alias("last_date"), F.max_by("close", "session_date").alias("close"))
    cap = caps.groupBy("entity").agg(F.max_by("market_cap_usd", "as_of_date").alias("market_cap"))
    rets = returns.groupBy("entity", "code").agg(F.max_by("pr", "as_of_date").alias("pr"))
    rets = rets.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "pr")))).alias("returns"))
    label = current_or_latest(labels, "entity").select("entity", "label")
    return securities.select("entity").distinct().join(label, "entity", "left").join(last, "entity", "left").join(cap, "entity", "left").join(rets, "entity", "left")


def history(prices: DataFrame, days: int) -> DataFrame:
    """Each entity's bars of the last days before its own latest."""
    last = prices.groupBy("entity").agg(F.max("session_date").alias("__last"))
    return prices.join(last, "entity").where(F.col("session_date") > F.date_sub("__last", days)).drop("__last")


def attention(lists: dict[str, tuple[DataFrame, str]], n: int) -> DataFrame:
    """(kind, key, opened): the newest n rows of each list of open things."""
    out = None
    for kind, (frame, at) in lists.items():
        key = F.concat_ws("|", *(F.col(c).cast("string") for c in frame.columns if c != at))
        rows = frame.select(F.lit(kind).alias("kind"), key.alias("key"), F.col(at).alias("opened")).orderBy(F.desc("opened"), "key").limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out


def universe_list(intervals: DataFrame, as_of) -> DataFrame:
    """(universe_id, members, ever): members at a date and names that ever were."""
    day = F.lit(as_of).cast("date")
    now = (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
    return intervals.groupBy("universe_id").agg(F.countDistinct(F.when(now, F.col("figi"))).alias("members"), F.countDistinct("figi").alias("ever"))


def level_series(levels: DataFrame, key: str) -> DataFrame:
    """Adds since_start, the return since the series' first level."""
    first = F.first("level").over(W.partitionBy(key).orderBy("session_date"))
    return levels.withColumn("since_start", F.try_divide(F.col("level"), first) - 1)


def series_catalogue(observations: DataFrame, key: str, date: str, value: str) -> DataFrame:
    return observations.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), F.max_by(value, date).alias("latest"))


def snapshot(intervals: DataFrame, levels: DataFrame, as_of) -> DataFrame:
    """(universe_id, members, level_date, level): a universe's members, and its index's last level, at a date."""
    day = F.lit(as_of).cast("date")
    members = intervals.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))).groupBy("universe_id").agg(F.countDistinct("figi").alias("members"))
    level = latest(levels, ["universe_id"], "session_date", as_of).select("universe_id", F.col("session_date").alias("level_date"), "level")
    return members.join(level, "universe_id", "left")


def with_daily_series(benchmarks: DataFrame, levels: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Benchmarks that have a daily series."""
    have = levels.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return benchmarks.join(have.select(key), key, "left_semi")


def live_board(board: DataFrame, quotes: DataFrame, as_of) -> DataFrame:
    """(entity, code, ret, freshness): returns carried to the quote; without one they stay as of the close."""
    rows = board.join(quotes.select("entity", "price", "quoted_on"), "entity", "left")
    live = F.try_divide(F.col("price"), F.when(F.col("close") > 0, F.col("close")))
    age = F.datediff(F.lit(as_of).cast("date"), "quoted_on")
    fresh = F.when(age.isNull(), "close").when(age <= 1, "live").when(age <= 4, "delayed").otherwise("stale")
    return rows.select("entity", "code", F.coalesce((1 + F.col("ret")) * live - 1, F.col("ret")).alias("ret"), fresh.alias("freshness"))
