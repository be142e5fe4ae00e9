"""Trading sessions, the 28 return windows, and what they snap to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The stable window ids, codes, kinds and parameters that return facts are keyed by.
WINDOWS = (
    (1, "1D", "calendar", "day", None, None, None, None, False),
    (2, "WTD", "calendar", "week", None, None, None, None, False),
    (3, "MTD", "calendar", "month", None, None, None, None, False),
    (4, "QTD", "calendar", "quarter", None, None, None, None, False),
    (5, "YTD", "calendar", "year", None, None, None, None, False),
    (6, "1W", "trailing", None, None, 7, None, None, False),
    (7, "1M", "trailing", None, None, None, 1, None, False),
    (8, "3M", "trailing", None, None, None, 3, None, False),
    (9, "6M", "trailing", None, None, None, 6, None, False),
    (10, "9M", "trailing", None, None, None, 9, None, False),
    (11, "1Y", "trailing", None, None, None, 12, None, False),
    (12, "2Y_ANN", "trailing", None, None, None, None, 2, True),
    (13, "3Y_ANN", "trailing", None, None, None, None, 3, True),
    (14, "5Y_ANN", "trailing", None, None, None, None, 5, True),
    (15, "10Y_ANN", "trailing", None, None, None, None, 10, True),
    (16, "20Y_ANN", "trailing", None, None, None, None, 20, True),
    (17, "30Y_ANN", "trailing", None, None, None, None, 30, True),
    (18, "SI_ANN", "inception", None, None, None, None, None, True),
    (19, "5D", "session", None, 5, None, None, None, False),
    (20, "10D", "session", None, 10, None, None, None, False),
    (21, "2Y", "trailing", None, None, None, None, 2, False),
    (22, "3Y", "trailing", None, None, None, None, 3, False),
    (23, "5Y", "trailing", None, None, None, None, 5, False),
    (24, "10Y", "trailing", None, None, None, None, 10, False),
    (25, "20Y", "trailing", None, None, None, None, 20, False),
    (26, "30Y", "trailing", None, None, None, None, 30, False),
    (27, "SI", "inception", None, None, None, None, None, False),
    (28, "PQ", "period", "quarter", None, None, None, None, False),
)


def windows(spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
    schema = "window_id int, code string, kind string, period string, sessions int, days int, months int, years int, annualized boolean"
    return spark.createDataFrame([w for w in WINDOWS if codes is None or w[1] in codes], schema)


def indexed(calendar: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sessions with session_idx, their place from 1 in the calendar, or in each exchange's."""
    over = W.partitionBy(*by).orderBy("session_date")
    return calendar.select(*by, "session_date").distinct().withColumn("session_idx", F.row_number().over(over))


def last_session(calendar: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(day, last_session, session_idx) for every calendar day from the first session to the last."""
    sessions = indexed(calendar, by)
    nxt = F.lead("session_date").over(W.partitionBy(*by).orderBy("session_date"))
    spans = sessions.withColumn("until", F.coalesce(F.date_sub(nxt, 1), F.col("session_date")))
    return spans.select(*by, F.explode(F.sequence("session_date", "until", F.expr("interval 1 day"))).alias("day"), F.col("session_date").alias("last_session"), "session_idx")


def period_start(day: Column, period: Column) -> Column:
    out = F.when(period == "day", day)
    for p in ("week", "month", "quarter", "year"):
        out = out.when(period == p, F.trunc(day, p))
    return out


def endpoints(calendar: DataFrame, wins: DataFrame) -> DataFrame:
    """(as_of_date, window columns, base_date, end_date): each session with the sessions that each window begins
    and ends at; null where the history is too short. A calendar is small, whatever the prices are."""
    sessions, snap = indexed(calendar), last_session(calendar)
    first = sessions.agg(F.min("session_date").alias("first"))
    grid = sessions.withColumnRenamed("session_date", "as_of_date").crossJoin(F.broadcast(wins)).crossJoin(F.broadcast(first))
    as_of = F.col("as_of_date")
    to_end = snap.select(F.col("day").alias("end_target"), F.col("last_session").alias("end_snap"))
    grid = grid.withColumn("end_target", F.when(F.col("kind") == "period", F.date_sub(period_start(as_of, F.col("period")), 1)).otherwise(as_of))
    grid = grid.join(to_end, "end_target", "left").withColumn("end_date", F.when(F.col("kind") == "period", F.col("end_snap")).otherwise(as_of))
    back = F.coalesce(F.col("months"), 12 * F.col("years"))
    target = (
        F.when(F.col("kind") == "calendar", F.date_sub(period_start(as_of, F.col("period")), 1))
        .when((F.col("kind") == "trailing") & F.col("days").isNotNull(), F.date_sub(as_of, F.col("days")))
        .when(F.col("kind") == "trailing", F.add_months(as_of, -back))
        .when(F.col("kind") == "period", F.date_sub(period_start(F.col("end_date"), F.col("period")), 1))
        .when(F.col("kind") == "inception", F.col("first"))
    )
    to_base = snap.select(F.col("day").alias("target"), F.col("last_session").alias("snapped"))
    by_idx = sessions.select(F.col("session_idx").alias("base_idx"), F.col("session_date").alias("by_sessions"))
    grid = grid.withColumn("target", target).withColumn("base_idx", F.col("session_idx") - F.col("sessions"))
    grid = grid.join(to_base, "target", "left").join(by_idx, "base_idx", "left")
    base = F.when(F.col("kind") == "session", F.col("by_sessions")).otherwise(F.col("snapped"))
    return grid.withColumn("base_date", base).select("as_of_date", "window_id", "code", "kind", "annualized", "base_date", "end_date")


def period_firsts(days: DataFrame, period: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first date that the data have in each month, quarter or year."""
    return days.groupBy(*by, F.trunc("session_date", period).alias("period")).agg(F.min("session_date").alias("session_date")).drop("period")


def even_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """n rows evenly spaced in order, the first and the last among them; all if there are fewer. For a chart's
    points: a series' rows are numbered in one pass."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    nth = F.row_number().over(W.orderBy(*order)) - 1
    rows = df.withColumn("__i", nth).crossJoin(F.broadcast(total))
    step = (F.col("__n") - 1) / F.lit(max(1, n - 1))
    slot = F.round(F.round(F.col("__i") / F.greatest(step, F.lit(1e-9))) * step)
    return rows.where((F.col("__n") <= n) | (slot == F.col("__i"))).drop("__i", "__n")
