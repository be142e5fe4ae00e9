"""As-of joins by union and fill: one shuffle on the key, one sort, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _asof(left, right, by, left_on, right_on, values, forward, strict, prefer):
    values = values or [c for c in right.columns if c not in {*by, right_on}]
    prefer = list(prefer or [])
    found = F.struct(F.col(right_on).alias("matched_date"), *(F.col(v) for v in values))
    extra = [c for c in left.columns if c not in {*by, left_on}]
    # at equal dates the right rows come first, unless the match is strict; the preferred right row comes last
    right_first = strict
    l_rows = left.select(
        *by, F.col(left_on).alias("__at"), F.lit(0 if right_first else 1).alias("__side"),
        *(F.lit(None).cast("double").alias(f"__p{i}") for i in range(len(prefer))),
        F.struct(*(F.col(c) for c in extra), F.lit(1).alias("__row")).alias("__left"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("__found"),
    )
    r_rows = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("__at"), F.lit(1 if right_first else 0).alias("__side"),
        *((-p).cast("double").alias(f"__p{i}") for i, p in enumerate(prefer)),
        F.lit(None).cast(l_rows.schema["__left"].dataType).alias("__left"), found.alias("__found"),
    )
    order = [F.col("__at").desc() if forward else F.col("__at"), "__side", *(f"__p{i}" for i in range(len(prefer)))]
    over = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    filled = l_rows.unionByName(r_rows).withColumn("__found", F.last("__found", ignorenulls=True).over(over))
    filled = filled.where("__left is not null")
    return filled.select(*by, F.col("__at").alias(left_on), *(F.col(f"__left.{c}") for c in extra), *(F.col(f"__found.{c}").alias(c) for c in ["matched_date", *values]))


def _capped(df, left_on, cap_days, values):
    if cap_days is None:
        return df
    fresh = F.abs(F.datediff(F.col(left_on), F.col("matched_date"))) <= cap_days
    return df.select(*(F.when(fresh, F.col(c)).alias(c) if c in {"matched_date", *values} else F.col(c) for c in df.columns))


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str] | None = None,
    cap_days: int | None = None, strict: bool = False, prefer=None,
) -> DataFrame:
    """Each left row with the values of the key's latest right row at or before (strict: before) its date, no
    older than cap_days; of right rows of one date, that with the least prefer columns. matched_date is
    null where none is found."""
    out = _asof(left, right, by, left_on, right_on, values, False, strict, prefer)
    return _capped(out, left_on, cap_days, values or [c for c in right.columns if c not in {*by, right_on}])


def asof_forward(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str] | None = None,
    cap_days: int | None = None, strict: bool = False, prefer=None,
) -> DataFrame:
    """The same with the earliest right row at or after (strict: after) the date."""
    out = _asof(left, right, by, left_on, right_on, values, True, strict, prefer)
    return _capped(out, left_on, cap_days, values or [c for c in right.columns if c not in {*by, right_on}])


def latest(df: DataFrame, by: list[str], date: str, as_of=None, prefer=()) -> DataFrame:
    """The latest row of each key, at or before as_of; ties by the least prefer columns. Aggregated before the shuffle."""
    if as_of is not None:
        df = df.where(F.col(date) <= F.lit(as_of))
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(date), *((-F.col(p)) for p in prefer)))
    return df.groupBy(*by).agg(best.alias("__r")).select(*by, *(F.col(f"__r.{c}") for c in rest))


def steps(df: DataFrame, by: list[str], date: str, vector: list[str]) -> DataFrame:
    """A step function's dates as intervals: effective after effective_from, up to and with effective_to (null: open)."""
    dates = df.select(*by, date).distinct()
    nxt = F.lead(date).over(W.partitionBy(*by).orderBy(date))
    spans = dates.select(*by, F.col(date).alias("effective_from"), nxt.alias("effective_to"))
    return df.withColumnRenamed(date, "effective_from").join(spans, [*by, "effective_from"]).select(*by, "effective_from", "effective_to", *vector)
