"""Universes: an event log projected to membership intervals, set operations, gating of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import valid_at

CHANGES = ("join", "leave", "correct")


class PitBoundaryError(ValueError):
    """A date before the first for which a universe's membership is known."""


def refuse_before(as_of, pit_valid_from) -> None:
    if pit_valid_from is not None and str(as_of) < str(pit_valid_from):
        raise PitBoundaryError(f"membership is known from {pit_valid_from}, not as of {as_of}")


def paired_corrections(events: DataFrame) -> DataFrame:
    """The events without corrections that void an event, and without the events they void.

    A correction names what it reverses (raw identifier, change, date) in reverses; each voids the first such
    event that is not voided yet. Corrections without provenance stay, as toggles. Those that name an event
    which is not there are dropped.
    """
    key = F.concat_ws("|", "raw_identifier", "change", F.col("effective_date").cast("string"))
    nth = F.row_number().over(W.partitionBy("universe_id", "__key").orderBy("event_id"))
    plain = events.where("change <> 'correct'").withColumn("__key", key).withColumn("__nth", nth)
    fixes = events.where("change = 'correct' and reverses is not null").select("universe_id", F.col("reverses").alias("__key"), "event_id")
    voids = fixes.withColumn("__nth", nth).select("universe_id", "__key", "__nth")
    kept = plain.join(voids, ["universe_id", "__key", "__nth"], "left_anti").drop("__key", "__nth")
    return kept.select(*events.columns).unionByName(events.where("change = 'correct' and reverses is null"))


def intervals(events: DataFrame) -> DataFrame:
    """(universe_id, figi, raw_identifier, valid_from, valid_to) of an event log, whatever its order.

    A join opens when nothing is open, a leave closes what is, a correction without provenance toggles. On one
    date leaves go first. Intervals of no length vanish, those that touch become one, with the latest raw id.
    """
    rank = F.when(F.col("change") == "leave", 0).when(F.col("change") == "join", 1).otherwise(2)
    row = F.struct(F.col("effective_date").alias("d"), rank.alias("r"), F.col("event_id").alias("id"), F.col("raw_identifier").alias("raw"))
    log = paired_corrections(events).groupBy("universe_id", "figi").agg(F.sort_array(F.collect_list(row)).alias("log"))
    done = "array<struct<f: date, t: date, raw: string>>"
    start = F.struct(F.lit(None).cast("date").alias("since"), F.lit(None).cast("string").alias("raw"), F.array().cast(done).alias("out"))

    def step(s, e):
        opens = s.since.isNull() & (e.r != 0)
        closes = s.since.isNotNull() & (e.r != 1)
        again = s.since.isNotNull() & (e.r == 1)
        last = F.try_element_at(s.out, F.lit(-1))
        # an interval that begins where the last ended goes on with that one
        touches = opens & (F.size(s.out) > 0) & (last.t == e.d)
        out = (
            F.when(closes & (s.since < e.d), F.concat(s.out, F.array(F.struct(s.since.alias("f"), e.d.alias("t"), s.raw.alias("raw")))))
            .when(touches, F.slice(s.out, 1, F.size(s.out) - 1))
            .otherwise(s.out)
        )
        since = F.when(touches, last.f).when(opens, e.d).when(closes, F.lit(None).cast("date")).otherwise(s.since)
        raw = F.when(opens | again, e.raw).when(closes, F.lit(None).cast("string")).otherwise(s.raw)
        return F.struct(since.alias("since"), raw.alias("raw"), out.alias("out"))

    def finish(s):
        return F.when(s.since.isNotNull(), F.concat(s.out, F.array(F.struct(s.since.alias("f"), F.lit(None).cast("date").alias("t"), s.raw.alias("raw"))))).otherwise(s.out)

    folded = log.select("universe_id", "figi", F.explode(F.aggregate("log", start, step, finish)).alias("x"))
    return folded.select("universe_id", "figi", F.col("x.raw").alias("raw_identifier"), F.col("x.f").alias("valid_from"), F.col("x.t").alias("valid_to"))


def events_of(members: DataFrame) -> DataFrame:
    """The joins and leaves that make these intervals."""
    joins = members.select("universe_id", "figi", F.lit("join").alias("change"), F.col("valid_from").alias("effective_date"), "raw_identifier")
    leaves = members.where("valid_to is not null").select("universe_id", "figi", F.lit("leave").alias("change"), F.col("valid_to").alias("effective_date"), "raw_identifier")
    return joins.unionByName(leaves)


def pinned(events: DataFrame, event_id: int, resolutions: DataFrame | None = None, resolved_through=None) -> DataFrame:
    """Intervals as they were when the log ended at event_id; with resolutions (raw_identifier, figi, resolved_at),
    of the securities that raw identifiers were last resolved to by then. What was not resolved yet is left out."""
    events = events.where(F.col("event_id") <= event_id)
    if resolutions is not None:
        known = resolutions.where(F.col("resolved_at") <= F.lit(resolved_through)) if resolved_through is not None else resolutions
        known = known.groupBy("raw_identifier").agg(F.max_by("figi", F.struct("resolved_at", "figi")).alias("__figi"))
        events = events.join(known.where("__figi is not null"), "raw_identifier").withColumn("figi", F.col("__figi")).select(*events.columns)
    return intervals(events)


def reversals(events: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(universe_id, raw_identifier, change, effective_date) with verdict: appended, of changes that get a
    correction on their date, there already, or refused, of what was never recorded or is no join or leave."""
    key = ["universe_id", "raw_identifier", "change", "effective_date"]
    recorded = events.select(*key).distinct().withColumn("__there", F.lit(True))
    name = F.concat_ws("|", "raw_identifier", "change", F.col("effective_date").cast("string"))
    done = events.where("change = 'correct' and reverses is not null").select("universe_id", F.col("reverses").alias("__name")).distinct().withColumn("__done", F.lit(True))
    rows = asked.select(*key).distinct().withColumn("__name", name).join(recorded, key, "left").join(done, ["universe_id", "__name"], "left")
    verdict = (
        F.when(~F.col("change").isin("join", "leave"), "refused: only a join or leave")
        .when(F.col("__there").isNull(), "refused: not recorded")
        .when(F.col("__done").isNotNull(), "there already")
        .otherwise("appended")
    )
    return rows.select(*key, verdict.alias("verdict"))


def roster_window(interval: DataFrame, as_of) -> DataFrame:
    """(universe_id, figi, member_from, member_to, active): the span for which a member's data are wanted, open
    while any of its intervals is."""
    day = F.lit(as_of).cast("date")
    is_open = F.bool_or(F.col("valid_to").isNull())
    return interval.groupBy("universe_id", "figi").agg(
        F.min("valid_from").alias("member_from"), F.when(~is_open, F.max("valid_to")).alias("member_to"), F.bool_or(valid_at(day)).alias("active")
    )


def members(interval: DataFrame, as_of) -> DataFrame:
    day = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    return interval.where(valid_at(day)).select("universe_id", "figi").distinct()


def of(interval: DataFrame, universe_id: str, as_of) -> DataFrame:
    return members(interval.where(F.col("universe_id") == universe_id), as_of).select("figi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(figi, change) that turn one set of members into the other."""
    joins = new.select("figi").distinct().join(old, "figi", "left_anti").withColumn("change", F.lit("join"))
    leaves = old.select("figi").distinct().join(new, "figi", "left_anti").withColumn("change", F.lit("leave"))
    return joins.unionByName(leaves)


def revision_diff(snapshots: DataFrame, key: str = "figi", at: str = "as_of_date") -> DataFrame:
    """(as_of_date, figi, change) between consecutive snapshots; the first seeds joins."""
    over = W.orderBy(at)
    dates = snapshots.select(at).distinct().select(at, F.row_number().over(over).alias("i"), F.lead(at).over(over).alias("next_at"))
    rows = snapshots.select(key, at).distinct().join(F.broadcast(dates), at)
    series = W.partitionBy(key).orderBy("i")
    rows = rows.withColumns({"before": F.lag("i").over(series), "after": F.lead("i").over(series)})
    joins = rows.where("before is null or before < i - 1").select(at, key, F.lit("join").alias("change"))
    leaves = rows.where("next_at is not null and (after is null or after > i + 1)").select(F.col("next_at").alias(at), key, F.lit("leave").alias("change"))
    return joins.unionByName(leaves)


def jaccard(ours: DataFrame, theirs: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n_ours, n_theirs, n_both, similarity, distance) of two sets in each group."""
    a = ours.select(*by, key).distinct().withColumn("a", F.lit(1))
    b = theirs.select(*by, key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, [*by, key], "full").groupBy(*by).agg(F.count("a").alias("n_ours"), F.count("b").alias("n_theirs"), F.count(F.col("a") + F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    share = F.col("n_both") / F.col("n_any")
    return both.select(*by, "n_ours", "n_theirs", "n_both", share.alias("similarity"), (1 - share).alias("distance"))


def proposals(sightings: DataFrame, sizes: DataFrame, as_of, rejected: DataFrame | None = None, churn: float = 0.1, persistence_days: int = 2, corroborations: int = 2, cooldown_days: int = 30) -> DataFrame:
    """sightings(universe_id, figi, change, seen_on, source) -> one row a change with promotable and the reason
    why not: rejected within the cooldown, too much churn at once, not seen long enough, too few sources."""
    day = F.lit(as_of).cast("date")
    seen = sightings.where(F.col("seen_on") <= day).groupBy("universe_id", "figi", "change").agg(
        F.min("seen_on").alias("first_seen"), F.max("seen_on").alias("last_seen"), F.countDistinct("source").alias("n_sources"), F.countDistinct("seen_on").alias("n_days")
    )
    total = F.count(F.lit(1)).over(W.partitionBy("universe_id"))
    seen = seen.withColumn("n_changes", total).join(F.broadcast(sizes.select("universe_id", "n_members")), "universe_id", "left")
    if rejected is not None:
        last = rejected.groupBy("universe_id", "figi", "change").agg(F.max("rejected_on").alias("rejected_on"))
        seen = seen.join(last, ["universe_id", "figi", "change"], "left")
    else:
        seen = seen.withColumn("rejected_on", F.lit(None).cast("date"))
    reason = (
        F.when(F.datediff(day, "rejected_on") < cooldown_days, "cooldown")
        .when(F.col("n_changes") > churn * F.coalesce("n_members", F.lit(0)), "churn")
        .when(F.datediff("last_seen", "first_seen") < persistence_days, "persistence")
        .when(F.col("n_sources") < corroborations, "corroboration")
    )
    return seen.withColumn("reason", reason).withColumn("promotable", F.col("reason").isNull())
