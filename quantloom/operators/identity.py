"""Identities: candidates, instruments and their external ids, classification, lifecycle, review, load plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("active", "delisted", "suspended", "unresolved")
KINDS = ("index", "criteria", "custom", "etf")


class RegistryError(ValueError):
    """A universe or status that the registry does not take."""


def universe_spec(universe_id: str, kind: str, config: dict | None = None) -> dict:
    """A checked entry of the universe registry."""
    import re

    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{1,63}", universe_id or ""):
        raise RegistryError(f"universe id {universe_id!r}")
    if kind not in KINDS:
        raise RegistryError(f"kind {kind!r}: one of {', '.join(KINDS)}")
    if kind == "criteria" and not (config or {}).get("top_n"):
        raise RegistryError("a criteria universe needs top_n")
    return {"universe_id": universe_id, "kind": kind, "config": config or {}}


def criteria_members(caps: DataFrame, as_of, top_n: int, max_age_days: int = 180, least: float = 0.0) -> DataFrame:
    """The top_n entities by latest market cap of at most max_age_days; ties by entity."""
    day = F.lit(as_of).cast("date")
    last = caps.where((F.col("as_of_date") <= day) & (F.col("as_of_date") >= F.date_sub(day, max_age_days))).groupBy("entity").agg(F.max_by("market_cap_usd", "as_of_date").alias("market_cap_usd"))
    return last.where(F.col("market_cap_usd") > least).orderBy(F.desc("market_cap_usd"), "entity").limit(top_n)


def home_listing(listings: DataFrame, rank: Column) -> DataFrame:
    """Each security's listing of the least rank; ties by exchange."""
    over = W.partitionBy("entity").orderBy(rank, "mic")
    return listings.withColumn("__n", F.row_number().over(over)).where("__n = 1").drop("__n")


def share_class_conflicts(rows: DataFrame) -> DataFrame:
    """Raw names that resolve to several share classes of one issuer."""
    out = rows.groupBy("raw", "issuer").agg(F.countDistinct("entity").alias("n"), F.sort_array(F.collect_set("entity")).alias("entities"))
    return out.where("n > 1")


def upgraded(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Resolutions (key, figi, quality) that only get better: quality 0 none, 1 ambiguous, 2 assigned; an equal one
    does not replace."""
    b = fresh.select(*key, F.col("figi").alias("new"), F.col("quality").alias("q"))
    rows = stored.join(b, key, "full")
    better = F.col("q") > F.coalesce("quality", F.lit(-1))
    return rows.select(*key, F.when(better, F.col("new")).otherwise(F.col("figi")).alias("figi"), F.greatest(F.coalesce("quality", F.lit(-1)), F.coalesce("q", F.lit(-1))).alias("quality"))


def instruments(xref: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """xref(scheme, external_id, sym_id) with fresh(scheme, external_id): what is known keeps its id, the rest gets one
    from a hash. Also the conflicts: external ids with more than one."""
    key = ["scheme", "external_id"]
    new = fresh.select(*key).distinct().join(xref, key, "left_anti")
    out = xref.select(*key, "sym_id").unionByName(new.withColumn("sym_id", F.xxhash64(*key)))
    return out, out.groupBy(*key).agg(F.countDistinct("sym_id").alias("n")).where("n > 1")


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first keyword that a text contains."""
    out = F.lit(None).cast("string")
    for word, label in reversed(rules):
        out = F.when(F.lower(text).contains(word.lower()), label).otherwise(out)
    return out


def band(code: Column, bands: list[tuple[int, int, str]]) -> Column:
    """The label of the first band that holds a numeric code."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(bands):
        out = F.when(code.between(lo, hi), label).otherwise(out)
    return out


def fill_chain(names: DataFrame, opinions: DataFrame, order: list[str]) -> DataFrame:
    """(entity, value, source): each name's value by the first source in order that has one; null where none has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    best = opinions.where(F.col("value").isNotNull() & (rank > 0)).groupBy("entity").agg(F.min_by(F.struct("value", "source"), F.struct(rank, "value")).alias("b"))
    return names.select("entity").distinct().join(best, "entity", "left").select("entity", F.col("b.value").alias("value"), F.col("b.source").alias("source"))


def set_status(dim: DataFrame, changes: DataFrame) -> DataFrame:
    """dim(entity, status, delisted_on, ...) after changes(entity, status, on_date): no row goes."""
    c = changes.select("entity", F.col("status").alias("new"), "on_date")
    rows = dim.join(c, "entity", "left")
    gone = F.when(F.col("new") == "delisted", F.col("on_date")).when(F.col("new") == "active", F.lit(None).cast("date")).otherwise(F.col("delisted_on"))
    return rows.select(*(F.coalesce("new", "status").alias("status") if x == "status" else gone.alias("delisted_on") if x == "delisted_on" else F.col(x) for x in dim.columns))


def resolve_review(queue: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """queue(key, reviewed) with outcome: confirmed, rejected, ambiguous (several verdicts differ) or open."""
    v = verdicts.groupBy(*key).agg(F.countDistinct("verdict").alias("n"), F.max("verdict").alias("verdict"))
    rows = queue.join(v, key, "left")
    outcome = F.when(F.col("reviewed"), "closed").when(F.col("n").isNull(), "open").when(F.col("n") > 1, "ambiguous").otherwise(F.col("verdict"))
    return rows.withColumn("outcome", outcome).drop("n", "verdict")


def load_plan(entities: DataFrame, prices: DataFrame, gaps: DataFrame, end, backfill_from, mode: str = "forward") -> DataFrame:
    """(entity, start, end, reason) of what to fetch: new names from the start, others from the day after their last
    bar, with mode gaps from their first gap, with overwrite everything; up to date ones are left out."""
    last = prices.groupBy("entity").agg(F.max("session_date").alias("last"))
    gap = gaps.groupBy("entity").agg(F.min("session_date").alias("gap"))
    rows = entities.select("entity").distinct().join(last, "entity", "left").join(gap, "entity", "left")
    first, stop = F.lit(backfill_from).cast("date"), F.lit(end).cast("date")
    start = F.when(F.col("last").isNull() | F.lit(mode == "overwrite"), first).when(F.lit(mode == "gaps") & F.col("gap").isNotNull(), F.col("gap")).otherwise(F.date_add("last", 1))
    reason = F.when(F.col("last").isNull(), "new").when(F.lit(mode == "overwrite"), "overwrite").when(F.lit(mode == "gaps") & F.col("gap").isNotNull(), "gap").otherwise("forward")
    return rows.select("entity", start.alias("start"), stop.alias("end"), reason.alias("reason")).where("start <= end")


def conformance(bars: DataFrame, required: dict[str, str]) -> list[str]:
    """What a source's frame lacks of the contract: missing columns, other types."""
    have = dict(bars.dtypes)
    return [f"no column {c}" for c in required if c not in have] + [f"{c} is {have[c]}, not {t}" for c, t in required.items() if c in have and have[c] != t]


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value; ties by value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def open_tokens(events: DataFrame) -> DataFrame:
    """(universe_id, raw_identifier) of tokens whose last change is a join."""
    last = events.groupBy("universe_id", "raw_identifier").agg(F.max_by("change", F.struct("effective_date", "event_id")).alias("change"))
    return last.where("change = 'join'").drop("change")


def swept(dim: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """Rows of dim without a fact: what a sweep deletes."""
    return dim.join(facts.select(*key), key, "left_anti")
