"""Boards: trailing returns and changes as screens show them. Their conventions differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import issuer_key
from .asof import asof_backward

#: index boards: the base is the last level on or before the start date, a period's first day included
INDEX_SPANS = (("5D", 7), ("1M", 30), ("3M", 91), ("6M", 182), ("1Y", 365), ("2Y", 730), ("3Y", 1095), ("5Y", 1825), ("10Y", 3650))
COMMODITY_SPANS = (("1W", 7), ("1M", 30))
MACRO_MONTHS = (("1M", 1), ("3M", 3), ("12M", 12))


def _targets(last: Column, spans, extra) -> Column:
    parts = [F.struct(F.lit(c).alias("code"), F.date_sub(last, d).alias("target")) for c, d in spans]
    return F.explode(F.array(*parts, *(F.struct(F.lit(c).alias("code"), t.alias("target")) for c, t in extra)))


def _against(latest_rows: DataFrame, series: DataFrame, key: str, spans, extra, value: str, strict: bool = False) -> DataFrame:
    asks = latest_rows.select(key, "last_date", "last_value", _targets(F.col("last_date"), spans, extra(F.col("last_date"))).alias("t")).select(key, "last_date", "last_value", "t.*")
    return asof_backward(asks, series.select(key, F.col("obs_date"), F.col(value).alias("base")), [key], "target", "obs_date", ["base"], strict=strict)


def last_rows(series: DataFrame, key: str, value: str) -> DataFrame:
    return series.groupBy(key).agg(F.max("obs_date").alias("last_date"), F.max_by(value, "obs_date").alias("last_value"))


def index_board(levels: DataFrame, key: str, value: str = "level") -> DataFrame:
    """(key, code, last_date, ret) for the month, quarter and year to date and spans of days."""
    extra = lambda d: [(c, F.trunc(d, p)) for c, p in (("MTD", "month"), ("QTD", "quarter"), ("YTD", "year"))]
    rows = _against(last_rows(levels, key, value), levels, key, INDEX_SPANS, extra, value)
    return rows.select(key, "code", "last_date", (F.try_divide(F.col("last_value"), F.when(F.col("base") > 0, F.col("base"))) - 1).alias("ret"))


def commodity_board(levels: DataFrame, key: str, value: str = "level") -> DataFrame:
    """(key, code, last_date, pct): a week, 30 days, since the last day of the year before, and a calendar year, in percent."""
    extra = lambda d: [("YTD", F.date_sub(F.trunc(d, "year"), 1)), ("1Y", F.add_months(d, -12))]
    rows = _against(last_rows(levels, key, value), levels, key, COMMODITY_SPANS, extra, value)
    return rows.select(key, "code", "last_date", ((F.try_divide(F.col("last_value"), F.when(F.col("base") != 0, F.col("base"))) - 1) * 100).alias("pct"))


def macro_deltas(series: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, code, last_date, delta): absolute changes over months and since the year began, from the series' own last value."""
    last = last_rows(series, key, value)
    extra = lambda d: [(c, F.add_months(d, -m)) for c, m in MACRO_MONTHS] + [("YTD", F.date_sub(F.trunc(d, "year"), 1))]
    rows = _against(last, series, key, (), extra, value)
    return rows.select(key, "code", "last_date", (F.col("last_value") - F.col("base")).alias("delta"))


def sparkline(series: DataFrame, key: str, value: str, n: int = 48) -> DataFrame:
    """(key, points): the last n values in order."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("obs_date")))
    rows = series.withColumn("__n", nth).where(F.col("__n") <= n)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("obs_date", F.col(value).alias("v")))).alias("s")).select(key, F.col("s.v").alias("points"))


def two_latest(series: DataFrame, key: str, value: str) -> DataFrame:
    """(key, last_date, last_value, previous, change)"""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc("obs_date")))
    rows = series.withColumn("__n", nth).where("__n <= 2")
    at = lambda c, n: F.max(F.when(F.col("__n") == n, F.col(c)))
    out = rows.groupBy(key).agg(at("obs_date", 1).alias("last_date"), at(value, 1).alias("last_value"), at(value, 2).alias("previous"))
    return out.withColumn("change", F.try_divide(F.col("last_value"), F.col("previous")) - 1)


def attention_rates(series: DataFrame, key: str, today=None) -> DataFrame:
    """(key, avg7, avg30, spike): values a calendar day, absent days as zero; anchored on today, or for a source
    that lags on its own last day."""
    anchor = F.lit(today).cast("date") if today is not None else F.max("obs_date").over(W.partitionBy(key))
    rows = series.withColumn("anchor", anchor)
    total = lambda d: F.sum(F.when((F.col("obs_date") > F.date_sub("anchor", d)) & (F.col("obs_date") <= F.col("anchor")), F.col("value")).otherwise(0.0)) / d
    out = rows.groupBy(key).agg(total(7).alias("avg7"), total(30).alias("avg30"))
    return out.withColumn("spike", F.try_divide(F.col("avg7"), F.when(F.col("avg30") != 0, F.col("avg30"))))


def range_position(price: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(price - low, F.when(high != low, high - low))))


def rebased_to_live(pr: Column, live: Column, last_close: Column) -> Column:
    return F.try_divide(live * (1 + pr), last_close) - 1


def heat_map(caps: DataFrame, returns: DataFrame, sectors: DataFrame, names: DataFrame) -> DataFrame:
    """(issuer, entity, sector, market_cap_usd, pr): an issuer's largest share class, with its return and sector."""
    keyed = caps.join(names, "entity", "left").withColumn("issuer", issuer_key(F.col("isin"), F.col("figi")))
    over = W.partitionBy("issuer").orderBy(F.desc_nulls_last("market_cap_usd"), "entity")
    top = keyed.withColumn("nth", F.row_number().over(over)).where("nth = 1")
    return top.join(returns.select("entity", "pr"), "entity", "left").join(sectors, "entity", "left").select("issuer", "entity", "sector", "market_cap_usd", "pr")


def coverage(roster: DataFrame, layers: dict[str, tuple[DataFrame, str, int]], as_of) -> DataFrame:
    """roster(universe_id, entity) -> members and, for each layer (frame, date, days), how many have a row not older."""
    day = F.lit(as_of).cast("date")
    rows = roster.select("universe_id", "entity").distinct()
    for name, (frame, date, days) in layers.items():
        have = frame.where((F.col(date) <= day) & (F.col(date) >= F.date_sub(day, days))).select("entity", F.lit(1).alias(name)).distinct()
        rows = rows.join(have, "entity", "left")
    return rows.groupBy("universe_id").agg(F.count(F.lit(1)).alias("members"), *(F.count(name).alias(name) for name in layers))


def search(securities: DataFrame, text: str, columns: list[str], n: int, offset: int = 0) -> DataFrame:
    """A page of the rows that contain text literally in one of the columns; nulls last, total on each row."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.upper(F.col(c).cast("string")).contains(text.upper()), F.lit(False))
    found = securities.where(hit)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy(F.asc_nulls_last(columns[0]), columns[-1]).offset(offset).limit(n)
    return page.crossJoin(F.broadcast(total))
