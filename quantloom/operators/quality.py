"""Data-quality checks: each returns violations, and the runner one row a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = {"pass": 0, "warn": 1, "fail": 2}
RESULT = "name string, status string, checked long, failures long, warnings long, detail string"


def worst(statuses: list[str]) -> str:
    return max(statuses, key=ORDER.__getitem__, default="pass")


def run(spark: SparkSession, checks: dict[str, Callable[[], tuple[DataFrame, DataFrame]]]) -> DataFrame:
    """checks: name -> function that returns (checked rows, violations with severity fail or warn). A check that
    breaks fails, and does not stop the others."""
    rows = []
    for name, check in checks.items():
        try:
            checked, violations = check()
            by = {r.severity: r.n for r in violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
            status = "fail" if by.get("fail") else "warn" if by.get("warn") else "pass"
            rows.append((name, status, checked.count(), by.get("fail", 0), by.get("warn", 0), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "fail", 0, 0, 0, f"{type(e).__name__}: {e}"[:200]))
    return spark.createDataFrame(rows, RESULT)


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    return child.select(*key).distinct().join(parent.select(*key), key, "left_anti").withColumn("severity", F.lit("fail"))


def ticker_collisions(symbology: DataFrame) -> DataFrame:
    """Open (ticker, exchange) pairs that more than one security holds."""
    held = symbology.where("valid_to is null").groupBy("ticker", "mic").agg(F.countDistinct("figi").alias("n"))
    return held.where("n > 1").withColumn("severity", F.lit("fail"))


def completeness(members: DataFrame, layers: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(entity, layer, severity) of members without a row in a layer."""
    out = None
    for layer, (frame, severity) in layers.items():
        rows = members.select("entity").distinct().join(frame.select("entity"), "entity", "left_anti").select("entity", F.lit(layer).alias("layer"), F.lit(severity).alias("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def off_calendar(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    return prices.select("entity", "session_date").join(F.broadcast(calendar.select("session_date")), "session_date", "left_anti").withColumn("severity", F.lit("warn"))


def projection_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of the two has, with which: repeated rows count."""
    a = stored.exceptAll(recomputed).withColumn("side", F.lit("stored only"))
    return a.unionByName(recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed only")))


def readiness(members: DataFrame, returns: DataFrame, threshold: float) -> DataFrame:
    """(universe_id, members, ready, share, severity): members that have a return."""
    have = returns.where("pr is not null").select("entity", F.lit(1).alias("r")).distinct()
    rows = members.join(have, "entity", "left").groupBy("universe_id").agg(F.count(F.lit(1)).alias("members"), F.count("r").alias("ready"))
    share = F.try_divide(F.col("ready"), F.col("members"))
    return rows.withColumn("share", share).withColumn("severity", F.when(share < threshold, "fail").otherwise("pass"))


def freshness(facts: DataFrame, by: list[str], date: str, as_of, stale_days: int = 4) -> DataFrame:
    """(by, last, days_behind, status, n): ok, late or stale; none where nothing is there."""
    out = facts.groupBy(*by).agg(F.max(date).alias("last"), F.count(F.lit(1)).alias("n"))
    behind = F.datediff(F.lit(as_of).cast("date"), "last")
    return out.withColumn("days_behind", behind).withColumn("status", F.when(behind.isNull(), "none").when(behind > stale_days, "stale").when(behind > 1, "late").otherwise("ok"))


def partial_days(facts: DataFrame, by: list[str], date: str, share: float = 0.9) -> DataFrame:
    """(by, last, shown, partial): a last day with less than share of the day before's rows is partial, and the day
    before is shown."""
    days = facts.groupBy(*by, date).agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(date)))
    two = days.withColumn("k", nth).where("k <= 2").groupBy(*by).agg(
        F.max(F.when(F.col("k") == 1, F.col(date))).alias("last"), F.max(F.when(F.col("k") == 2, F.col(date))).alias("prev"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("m")
    )
    partial = F.coalesce(F.col("n") < share * F.col("m"), F.lit(False))
    return two.select(*by, "last", F.when(partial, F.col("prev")).otherwise(F.col("last")).alias("shown"), partial.alias("partial"))


def level_differences(ours: DataFrame, official: DataFrame, warn_bps: float, fail_bps: float) -> DataFrame:
    """(key, session_date, bps, severity) of levels against official ones."""
    both = ours.join(official.withColumnRenamed("level", "official"), ["region", "session_date"])
    bps = F.abs(F.try_divide(F.col("level"), F.col("official")) - 1) * 1e4
    return both.withColumn("bps", bps).withColumn("severity", F.when(F.col("bps") > fail_bps, "fail").when(F.col("bps") > warn_bps, "warn").otherwise("pass"))


def action_agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(entity, ex_date, action_type, verdict): splits must agree exactly, dividends within max(0.5 %, 0.005)."""
    key = ["entity", "ex_date", "action_type"]
    both = ours.select(*key, F.col("value").alias("a")).join(theirs.select(*key, F.col("value").alias("b")), key, "full")
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(0.005 * F.abs("a"), F.lit(0.005))
    ok = F.when(F.col("action_type") == "split", F.col("a") == F.col("b")).otherwise(near)
    return both.select(*key, F.when(F.col("b").isNull(), "only ours").when(F.col("a").isNull(), "only theirs").when(ok, "agree").otherwise("differ").alias("verdict"))


def fx_coverage(currencies: DataFrame, rates: DataFrame, as_of, sources: tuple[str, ...] = ()) -> DataFrame:
    """(ccy, status, days_stale, severity): each priced currency must resolve a rate that is not stale."""
    from .fx import PIVOT, resolve

    asks = currencies.select("ccy").where(F.col("ccy") != PIVOT).distinct().withColumn("as_of_date", F.lit(as_of).cast("date"))
    return resolve(asks, rates, sources).select("ccy", "status", "days_stale", F.when(F.col("status") == "ok", "pass").otherwise("fail").alias("severity"))


def classification_coverage(securities: DataFrame, labels: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(source, n, total, share, severity): how many active securities each source has classified; the share, and
    whether it reaches the threshold, is of all sources together."""
    active = securities.where("status = 'active'").select("entity").distinct()
    now = labels.where("valid_to is null and label is not null").select("entity", "source").distinct().join(active, "entity")
    total = active.agg(F.count(F.lit(1)).alias("total")).crossJoin(now.agg(F.countDistinct("entity").alias("have")))
    share = F.try_divide(F.col("have"), F.col("total"))
    rows = now.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row
    return rows.select("source", "n", "total", share.alias("share"), F.when(share >= threshold, "pass").otherwise("fail").alias("severity"))


def bridge_holes(securities: DataFrame, instruments: DataFrame, xref: DataFrame, scheme: str = "figi") -> DataFrame:
    """(hole, key) where securities and equity instruments do not meet one to one: unmapped securities, orphan
    instruments, and instruments that carry several securities."""
    equity = instruments.where("kind = 'equity'").select("sym_id").distinct()
    mapped = xref.where(F.col("scheme") == scheme).select("sym_id", "external_id").distinct().join(equity, "sym_id")
    unmapped = securities.select(F.col("figi").alias("external_id")).distinct().join(mapped, "external_id", "left_anti").select(F.lit("unmapped").alias("hole"), F.col("external_id").alias("key"))
    orphan = equity.join(mapped, "sym_id", "left_anti").select(F.lit("orphan").alias("hole"), F.col("sym_id").cast("string").alias("key"))
    many = mapped.groupBy("sym_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("many").alias("hole"), F.col("sym_id").cast("string").alias("key"))
    return unmapped.unionByName(orphan).unionByName(many)


def eod_board(datasets: dict[str, tuple[DataFrame, str, str]], as_of, share: float = 0.9, window_days: int = 10, laggards: int = 3) -> DataFrame:
    """datasets: name -> (facts, key, date). (dataset, latest, complete, days_behind, bucket, n, n_latest, worst): the
    last day, the last on which share of the fullest recent day's keys are there, and by that the bucket; worst
    are the keys whose own last day lies furthest back."""
    out, day = None, F.lit(as_of).cast("date")
    for name, (facts, key, date) in datasets.items():
        rows = facts.where(F.col(date) <= day).select(F.col(key).cast("string").alias("k"), F.col(date).alias("d"))
        top = rows.agg(F.max("d").alias("latest"))
        per_day = rows.crossJoin(F.broadcast(top)).where(F.col("d") >= F.date_sub("latest", window_days)).groupBy("d", "latest").agg(F.countDistinct("k").alias("n"))
        full = per_day.agg(F.max("n").alias("most"))
        seen = per_day.crossJoin(F.broadcast(full)).groupBy("latest").agg(
            F.max(F.when(F.col("n") >= share * F.col("most"), F.col("d"))).alias("complete"), F.max("most").alias("n"), F.max(F.when(F.col("d") == F.col("latest"), F.col("n"))).alias("n_latest")
        )
        behind = rows.groupBy("k").agg(F.max("d").alias("last")).orderBy("last", "k").limit(laggards)
        worst = behind.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("last", "k"))), lambda x: x.k), ",").alias("worst"))
        gap = F.datediff(day, "complete")
        row = seen.crossJoin(worst).select(F.lit(name).alias("dataset"), "latest", "complete", gap.alias("days_behind"), F.when(gap <= 1, "fresh").when(gap <= 4, "late").otherwise("stale").alias("bucket"), "n", "n_latest", "worst")
        out = row if out is None else out.unionByName(row)
    return out


def check_log(results: DataFrame) -> DataFrame:
    """(name, runs, last_run, status, last_pass) of the runs of checks, results(name, status, run_at)."""
    return results.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.max("run_at").alias("last_run"), F.max_by("status", F.struct("run_at", "status")).alias("status"), F.max(F.when(F.col("status") == "pass", F.col("run_at"))).alias("last_pass")
    )
