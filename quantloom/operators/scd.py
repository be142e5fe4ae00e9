"""Interval tables (type 2): current and as-of rows, overlaps, and the application of new facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_history(observed: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, value, valid_from, valid_to) of observations: each change opens an interval."""
    over = W.partitionBy(key).orderBy(at)
    changed = observed.withColumn("__p", F.lag(value).over(over)).withColumn("__n", F.row_number().over(over)).where((F.col("__n") == 1) | ~F.col("__p").eqNullSafe(F.col(value)))
    return changed.select(key, value, F.col(at).alias("valid_from"), F.lead(at).over(over).alias("valid_to"))


def current_or_latest(rows: DataFrame, key: str) -> DataFrame:
    """Each key's open row, or that which began last."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col("valid_to").isNull(), F.col("valid_from")))
    return rows.groupBy(key).agg(best.alias("r")).select(key, *(F.col(f"r.{c}") for c in rest))


def overlaps(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose interval begins before one that began earlier, or with it, has ended: by one running maximum."""
    far = F.lit("9999-12-31").cast("date")
    over = W.partitionBy(*key).orderBy("valid_from", F.coalesce("valid_to", far)).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("__until", F.max(F.coalesce("valid_to", far)).over(over)).where("valid_from < __until").drop("__until")


def apply(open_rows: DataFrame, incoming: DataFrame, key: list[str], value: str, precedence) -> DataFrame:
    """incoming(key, value, source, valid_from) against the open rows -> one row a key with action:

    insert, unchanged, upgrade (a better source says the same), update (another value on the same day),
    close_insert, refused_backdated, or refused_outranked. precedence ranks a source column, least first.
    """
    new = incoming.select(*key, F.col(value).alias("new_value"), F.col("source").alias("new_source"), F.col("valid_from").alias("new_from"))
    both = new.join(open_rows.where("valid_to is null").select(*key, value, "source", "valid_from"), key, "left")
    better = precedence(F.col("new_source")) < precedence(F.col("source"))
    worse = precedence(F.col("new_source")) > precedence(F.col("source"))
    same = F.col("new_value").eqNullSafe(F.col(value))
    action = (
        F.when(F.col("valid_from").isNull(), "insert")
        .when(same & better, "upgrade")
        .when(same, "unchanged")
        .when(worse, "refused_outranked")
        .when(F.col("new_from") < F.col("valid_from"), "refused_backdated")
        .when(F.col("new_from") == F.col("valid_from"), "update")
        .otherwise("close_insert")
    )
    return both.withColumn("action", action)


def applied(table: DataFrame, decisions: DataFrame, key: list[str], value: str) -> DataFrame:
    """The interval table after the decisions of apply()."""
    d = decisions.select(*key, "new_value", "new_source", "new_from", "action")
    rows = table.join(d, key, "left")
    is_open = F.col("valid_to").isNull()
    kept = rows.select(
        *key,
        F.when(is_open & (F.col("action") == "update"), F.col("new_value")).otherwise(F.col(value)).alias(value),
        F.when(is_open & F.col("action").isin("update", "upgrade"), F.col("new_source")).otherwise(F.col("source")).alias("source"),
        "valid_from",
        F.when(is_open & (F.col("action") == "close_insert"), F.col("new_from")).otherwise(F.col("valid_to")).alias("valid_to"),
    )
    added = d.where(F.col("action").isin("insert", "close_insert")).select(
        *key, F.col("new_value").alias(value), F.col("new_source").alias("source"), F.col("new_from").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")
    )
    return kept.unionByName(added)


def symbology_transition(open_rows: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(figi, ticker, mic, valid_from) -> action: collision (another figi holds the ticker there), refused_later
    (an open row began after), unchanged, update (same day), close_insert or insert."""
    held = open_rows.where("valid_to is null")
    other = held.select(F.col("figi").alias("holder"), "ticker", "mic")
    new = incoming.join(other, ["ticker", "mic"], "left").groupBy("figi", "ticker", "mic", "valid_from").agg(F.bool_or(F.col("holder") != F.col("figi")).alias("collides"))
    own = held.select("figi", F.col("ticker").alias("old_ticker"), F.col("mic").alias("old_mic"), F.col("valid_from").alias("old_from"))
    rows = new.join(own, "figi", "left")
    action = (
        F.when(F.coalesce("collides", F.lit(False)), "collision")
        .when(F.col("old_from").isNull(), "insert")
        .when((F.col("old_ticker") == F.col("ticker")) & (F.col("old_mic") == F.col("mic")), "unchanged")
        .when(F.col("old_from") > F.col("valid_from"), "refused_later")
        .when(F.col("old_from") == F.col("valid_from"), "update")
        .otherwise("close_insert")
    )
    return rows.withColumn("action", action).select("figi", "ticker", "mic", "valid_from", "action")


def best_opinion(opinions: DataFrame, key: str, precedence) -> DataFrame:
    """Of the sources' current opinions on a key, the best source's; ties by value."""
    over = W.partitionBy(key).orderBy(precedence(F.col("source")), "value")
    return opinions.where("valid_to is null").withColumn("n", F.row_number().over(over)).where("n = 1").drop("n")


def identity_class(candidates: DataFrame) -> DataFrame:
    """(raw, n, verdict): none, assigned or ambiguous, by how many identifiers a raw name resolves to."""
    n = F.countDistinct("figi")
    return candidates.groupBy("raw").agg(n.alias("n"), F.when(n == 0, "none").when(n == 1, "assigned").otherwise("ambiguous").alias("verdict"), F.when(n == 1, F.max("figi")).alias("figi"))


def calendar_version(days: DataFrame) -> DataFrame:
    """(mic, n, content_hash) of session sets: an equal hash is an unchanged calendar."""
    return days.groupBy("mic").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_set(F.col("session_date").cast("string")))).cast("binary"), 256).alias("content_hash"))
