"""Return matrix, risk metrics, extremes, forward returns and their restatement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import SESSIONS_PER_YEAR, content_hash, window_return
from .asof import asof_backward, asof_forward
from .calendar import endpoints, last_session, period_start


def series_window():
    return W.partitionBy("entity").orderBy("session_date")


def with_flag(bars: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Adds flagged: whether the bar's date is flagged for its entity."""
    if flags is None:
        return bars.withColumn("flagged", F.lit(False))
    marks = flags.select("entity", "session_date", F.lit(True).alias("__f")).distinct()
    return bars.join(marks, ["entity", "session_date"], "left").withColumn("flagged", F.col("__f").isNotNull()).drop("__f")


def _ends_of(rows: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Adds end_* values: a window that ends on its own date has its row's (own_*); only period windows look theirs up."""
    own = rows.where("kind <> 'period'").select("*", *(F.col(f"own_{c}").alias(f"end_{c}") for c in names))
    looked = rows.where("kind = 'period'").join(values.select("entity", F.col("session_date").alias("end_date"), *(F.col(c).alias(f"end_{c}") for c in names)), ["entity", "end_date"], "left")
    return own.unionByName(looked.select(*own.columns)).drop(*(f"own_{c}" for c in names))


def return_matrix(series: DataFrame, calendar: DataFrame, wins: DataFrame, flags: DataFrame | None = None, ex_dates: DataFrame | None = None) -> DataFrame:
    """(entity, window_id, code, as_of_date, base_date, end_date, pr, tr, gated) for each bar and window.

    series has entity, session_date, adj_close and tri. Endpoints are exact sessions: one without a bar makes
    null. Since-inception windows begin at the entity's first bar. A flag on the bars of as_of, base or end gates
    both returns; a flagged ex-date within (base, end] gates the total return. Flags travel with the bars, so that
    the rows of all windows are shuffled once, to look up their bases.
    """
    bars = with_flag(series.select("entity", "session_date", F.col("adj_close").alias("p"), F.col("tri").alias("t")), flags)
    if flags is not None and ex_dates is not None:
        bad = ex_dates.select("entity", F.col("ex_date").alias("session_date")).join(flags, ["entity", "session_date"]).distinct()
        upto = bad.select("entity", F.col("session_date").alias("ex"), F.row_number().over(series_window()).alias("n"))
        bars = asof_backward(bars, upto, ["entity"], "session_date", "ex", ["n"]).drop("matched_date").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        bars = bars.withColumn("n", F.lit(0))
    bars = bars.withColumn("first_bar", F.min("session_date").over(W.partitionBy("entity")))
    names = ["p", "t", "flagged", "n"]
    # sessions by windows: as long as the calendar, however many entities there are
    rows = bars.select("entity", F.col("session_date").alias("as_of_date"), "first_bar", F.col("flagged").alias("as_of_flagged"), *(F.col(c).alias(f"own_{c}") for c in names))
    rows = rows.join(F.broadcast(endpoints(calendar, wins)), "as_of_date")
    rows = rows.withColumn("base_date", F.when(F.col("kind") == "inception", F.col("first_bar")).otherwise(F.col("base_date"))).drop("first_bar")
    rows = _ends_of(rows, bars, names)
    base = bars.select("entity", F.col("session_date").alias("base_date"), *(F.col(c).alias(f"base_{c}") for c in names))
    rows = rows.join(base.hint("shuffle_hash"), ["entity", "base_date"], "left")
    days = F.datediff("end_date", "base_date").cast("double")
    pr, tr = (window_return(F.col(f"base_{c}"), F.col(f"end_{c}"), F.col("annualized"), days) for c in "pt")
    gated = F.col("as_of_flagged") | F.coalesce("base_flagged", F.lit(False)) | F.coalesce("end_flagged", F.lit(False))
    tr_gated = F.coalesce("end_n", F.lit(0)) > F.coalesce("base_n", F.lit(0))
    return rows.select("entity", "window_id", "code", "as_of_date", "base_date", "end_date", F.when(~gated, pr).alias("pr"), F.when(~(gated | tr_gated), tr).alias("tr"), gated.alias("gated"))


def with_hash(matrix: DataFrame) -> DataFrame:
    """Adds input_hash, which changes when an endpoint or a return does."""
    return matrix.withColumn("input_hash", content_hash(*(F.col(c) for c in ("window_id", "as_of_date", "base_date", "end_date", "pr", "tr"))))


def own_dates_matrix(levels: DataFrame, wins: DataFrame, key: str, value: str) -> DataFrame:
    """Returns of series that have no exchange calendar: each is its own. (key, window_id, code, as_of_date, pr)"""
    series = levels.select(F.col(key).alias("entity"), "session_date", F.col(value).alias("adj_close"))
    dates = series.select("entity", "session_date")
    idx = dates.withColumn("session_idx", F.row_number().over(series_window()))
    nxt = F.lead("session_date").over(series_window())
    span = idx.withColumn("until", F.coalesce(F.date_sub(nxt, 1), F.col("session_date")))
    snap = span.select("entity", F.explode(F.sequence("session_date", "until", F.expr("interval 1 day"))).alias("day"), F.col("session_date").alias("snapped"))
    first = F.min("session_date").over(W.partitionBy("entity"))
    grid = idx.withColumn("first", first).withColumnRenamed("session_date", "as_of_date").crossJoin(F.broadcast(wins))
    as_of = F.col("as_of_date")
    end_target = F.when(F.col("kind") == "period", F.date_sub(period_start(as_of, F.col("period")), 1)).otherwise(as_of)
    grid = grid.withColumn("day", end_target).join(snap.withColumnRenamed("snapped", "end_date"), ["entity", "day"], "left").drop("day")
    back = F.coalesce(F.col("months"), 12 * F.col("years"))
    day = (
        F.when(F.col("kind") == "calendar", F.date_sub(period_start(as_of, F.col("period")), 1))
        .when((F.col("kind") == "trailing") & F.col("days").isNotNull(), F.date_sub(as_of, F.col("days")))
        .when(F.col("kind") == "trailing", F.add_months(as_of, -back))
        .when(F.col("kind") == "period", F.date_sub(period_start(F.col("end_date"), F.col("period")), 1))
        .when(F.col("kind") == "inception", F.col("first"))
    )
    grid = grid.withColumn("day", day).withColumn("base_idx", F.col("session_idx") - F.col("sessions"))
    grid = grid.join(snap, ["entity", "day"], "left").join(idx.select("entity", F.col("session_idx").alias("base_idx"), F.col("session_date").alias("by_sessions")), ["entity", "base_idx"], "left")
    grid = grid.withColumn("base_date", F.when(F.col("kind") == "session", F.col("by_sessions")).otherwise(F.col("snapped")))
    value_at = lambda side: series.select("entity", F.col("session_date").alias(f"{side}_date"), F.col("adj_close").alias(side))
    grid = grid.join(value_at("base"), ["entity", "base_date"], "left").join(value_at("end"), ["entity", "end_date"], "left")
    pr = window_return(F.col("base"), F.col("end"), F.col("annualized"), F.datediff("end_date", "base_date").cast("double"))
    return grid.select(F.col("entity").alias(key), "window_id", "code", "as_of_date", pr.alias("pr"))


def risk_metrics(series: DataFrame, calendar: DataFrame, wins: DataFrame, flags: DataFrame | None = None, value: str = "adj_close") -> DataFrame:
    """(entity, window_id, as_of_date, vol, sharpe, n_obs, gated) over the daily returns in (base, end].

    Sums up to each date, of returns less the entity's mean, make every window a difference of two rows. They are
    carried on over sessions without a bar, so that a window's base is looked up by equality. Returns from or to
    a flagged bar are left out; a flagged as_of gates. Bars outside the calendar's days take no part.
    """
    bars = with_flag(series.select("entity", "session_date", F.col(value).alias("v")), flags)
    prev, prev_f = F.lag("v").over(series_window()), F.lag("flagged").over(series_window())
    ret = F.when((F.col("v") > 0) & (prev > 0) & ~F.col("flagged") & ~prev_f, F.col("v") / prev - 1)
    mean = F.coalesce(F.avg("r").over(W.partitionBy("entity")), F.lit(0.0))
    bars = bars.withColumn("r", ret).withColumn("m", mean).withColumn("x", F.col("r") - F.col("m"))
    upto = lambda c: F.coalesce(F.sum(c).over(series_window()), F.lit(0.0))
    sums = bars.select(
        "entity", "session_date", "flagged", "m", F.count("r").over(series_window()).alias("n"), upto(F.col("x")).alias("s"), upto(F.col("x") * F.col("x")).alias("q"),
        F.min("session_date").over(W.partitionBy("entity")).alias("first_bar"),     )
    names = ["m", "n", "s", "q"]
    rows = sums.select("entity", F.col("session_date").alias("as_of_date"), "flagged", "first_bar", *(F.col(c).alias(f"own_{c}") for c in names))
    rows = rows.join(F.broadcast(endpoints(calendar, wins)), "as_of_date")
    rows = rows.withColumn("base_date", F.when(F.col("kind") == "inception", F.col("first_bar")).otherwise(F.col("base_date")))
    rows = rows.where("base_date is not null and end_date is not null").select("entity", "window_id", "kind", "as_of_date", "base_date", "end_date", "flagged", *(f"own_{c}" for c in names))
    # each bar's sums stand for its session and those up to the next bar
    sessions = last_session(calendar).where("day = last_session").select("session_idx", F.col("last_session").alias("on"))
    places = last_session(calendar).select(F.col("day").alias("session_date"), "session_idx")
    carried = sums.join(F.broadcast(places), "session_date").withColumn("next_idx", F.lead("session_idx").over(series_window()))
    until = F.coalesce(F.col("next_idx") - 1, F.col("session_idx"))
    carried = carried.where(until >= F.col("session_idx")).select("entity", F.explode(F.sequence("session_idx", until)).alias("session_idx"), *names)
    carried = carried.join(F.broadcast(sessions), "session_idx").select("entity", F.col("on").alias("session_date"), *names)
    rows = _ends_of(rows, carried, names)
    base = carried.select("entity", F.col("session_date").alias("base_date"), *(F.col(c).alias(f"base_{c}") for c in names))
    rows = rows.join(base.hint("shuffle_hash"), ["entity", "base_date"], "left")
    n, s, q = (F.coalesce(f"end_{c}", F.lit(0)) - F.coalesce(f"base_{c}", F.lit(0)) for c in ("n", "s", "q"))
    rows = rows.select("entity", "window_id", "as_of_date", n.alias("n_obs"), s.alias("s"), q.alias("q"), F.coalesce("end_m", F.lit(0.0)).alias("m"), F.col("flagged").alias("gated"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.when(F.col("n_obs") > 1, F.col("n_obs"))) / F.when(F.col("n_obs") > 1, F.col("n_obs") - 1)
    rows = rows.withColumn("sd", F.when(var > 1e-18, F.sqrt(var)))
    year = math.sqrt(SESSIONS_PER_YEAR)
    show = lambda c: F.when(~F.col("gated"), c)
    mean_ret = F.col("m") + F.col("s") / F.when(F.col("n_obs") > 0, F.col("n_obs"))
    return rows.select("entity", "window_id", "as_of_date", show(F.col("sd") * year).alias("vol"), show(mean_ret / F.col("sd") * year).alias("sharpe"), "n_obs", "gated")


def extremes(prices: DataFrame, days: int = 365, value: str = "adj_close", flags: DataFrame | None = None) -> DataFrame:
    """The highest and lowest price of the window [as_of - days, as_of], ties to the latest session, and how far
    off the price is; gated by a flag on any of the three sessions' bars."""
    at = F.unix_date("session_date")
    over = W.partitionBy("entity").orderBy(at).rangeBetween(-days, 0)
    v = F.col("v")
    bars = with_flag(prices.select("entity", "session_date", F.col(value).alias("v")), flags)
    high = F.max(F.when(v > 0, F.struct(v.alias("v"), at.alias("d"), F.col("flagged").alias("f")))).over(over)
    low = F.min(F.when(v > 0, F.struct(v.alias("v"), (-at).alias("d"), F.col("flagged").alias("f")))).over(over)
    rows = bars.select("entity", F.col("session_date").alias("as_of_date"), v.alias("price"), "flagged", high.alias("h"), low.alias("l"))
    gated = F.col("flagged") | F.coalesce("h.f", F.lit(False)) | F.coalesce("l.f", F.lit(False))
    rows = rows.select(
        "entity", "as_of_date", "price", F.col("h.v").alias("high_52w"), F.date_from_unix_date("h.d").alias("high_date"),
        F.col("l.v").alias("low_52w"), F.date_from_unix_date(-F.col("l.d")).alias("low_date"), gated.alias("gated"),
    )
    rows = rows.withColumn("pct_off_high", F.col("price") / F.col("high_52w") - 1).withColumn("pct_off_low", F.col("price") / F.col("low_52w") - 1)
    hide = ["high_52w", "low_52w", "high_date", "low_date", "pct_off_high", "pct_off_low"]
    return rows.select("entity", "as_of_date", *(F.when(~F.col("gated"), F.col(c)).alias(c) for c in hide), "gated")


HORIZONS = (("1W", 7, 0), ("1M", 0, 1), ("3M", 0, 3), ("6M", 0, 6), ("9M", 0, 9), ("1Y", 0, 12))


def forward_returns(prices: DataFrame, flags: DataFrame | None = None, value: str = "adj_close", grace_days: int = 14) -> DataFrame:
    """(entity, as_of_date, horizon, fwd_date, fwd_ret): to the first bar at or after the horizon, at most
    grace_days later; horizons not reached yet are absent, flagged endpoints make null."""
    bars = with_flag(prices.select("entity", "session_date", F.col(value).alias("v")), flags).withColumnRenamed("flagged", "f")
    due = F.explode(F.array(*(F.struct(F.lit(c).alias("horizon"), (F.date_add("session_date", d) if d else F.add_months("session_date", m)).alias("due")) for c, d, m in HORIZONS)))
    rows = bars.select("entity", F.col("session_date").alias("as_of_date"), F.col("v").alias("base"), F.col("f").alias("base_f"), due.alias("h")).select("entity", "as_of_date", "base", "base_f", "h.*")
    later = bars.select("entity", "session_date", F.col("v").alias("end"), F.col("f").alias("end_f"))
    rows = asof_forward(rows, later, ["entity"], "due", "session_date", ["end", "end_f"], cap_days=grace_days).where("matched_date is not null")
    fine = ~F.col("base_f") & ~F.col("end_f") & (F.col("base") > 0) & (F.col("end") > 0)
    return rows.select("entity", "as_of_date", "horizon", F.col("matched_date").alias("fwd_date"), F.when(fine, F.col("end") / F.col("base") - 1).alias("fwd_ret"))


def restated(ret: Column, fx_base: Column, fx_end: Column, annualized: Column, days: Column) -> Column:
    """A return in another currency: (1 + r) by the rate's change; yearly rates are undone and done again."""
    years = days / 365.25
    whole = F.when(annualized, F.pow(1 + ret, years)).otherwise(1 + ret) * F.try_divide(fx_end, fx_base)
    return F.when(annualized, F.when((whole > 0) & (years > 0), F.pow(whole, F.try_divide(F.lit(1.0), years)) - 1)).otherwise(whole - 1)


def alpha(assets: DataFrame, index: DataFrame) -> DataFrame:
    """Asset less index return, at the same window and date."""
    bench = index.select("window_id", "as_of_date", F.col("pr").alias("index_pr"))
    return assets.join(bench, ["window_id", "as_of_date"]).withColumn("alpha", F.col("pr") - F.col("index_pr"))
