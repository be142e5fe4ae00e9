"""Upserts on plain files: joins that return each row with what happens to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty(stored: DataFrame, fresh: DataFrame, key: list[str], compare: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(key, action): insert, update (a compared column differs), unchanged, or delete, which scope, the keys
    recomputed, limits; without it every stored key that is not fresh goes."""
    a = stored.select(*key, F.struct(*compare).alias("old"))
    b = fresh.select(*key, F.struct(*compare).alias("new"))
    rows = a.join(b, key, "full")
    if scope is not None:
        rows = rows.join(scope.select(*scope.columns, F.lit(True).alias("in_scope")).distinct(), scope.columns, "left")
    else:
        rows = rows.withColumn("in_scope", F.lit(True))
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), F.when(F.col("in_scope"), "delete").otherwise("keep"))
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("update")
    )
    return rows.select(*key, action.alias("action"))


def merged(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows, and the stored ones of other keys."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def insert_new(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows, and the fresh ones whose keys are not stored: nothing stored ever changes."""
    return stored.unionByName(fresh.dropDuplicates(key).join(stored.select(*key), key, "left_anti"))


def vintages(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """stored(key, value, first_value) and fresh(key, value) -> key, value, first_value, action: the first value
    stays, the latest replaces; inserted, restated, unchanged or kept."""
    a = stored.select(*key, F.col("value").alias("old"), F.col("first_value").alias("first_old"), F.lit(True).alias("had"))
    b = fresh.select(*key, F.col("value").alias("new"), F.lit(True).alias("got"))
    rows = a.join(b, key, "full")
    action = F.when(F.col("had").isNull(), "inserted").when(F.col("got").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("restated")
    return rows.select(*key, F.when(F.col("got"), F.col("new")).otherwise(F.col("old")).alias("value"), F.when(F.col("had"), F.col("first_old")).otherwise(F.col("new")).alias("first_value"), action.alias("action"))


def replace_vector(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """A vector's rows on its dates are replaced whole; keys without fresh rows stay as they are."""
    return merged(stored, fresh, key)


def overwrite_span(stored: DataFrame, fresh: DataFrame, by: list[str], date: str) -> DataFrame:
    """Stored rows outside the fresh rows' first to last date of their key, and the fresh rows; an empty fetch deletes nothing."""
    span = fresh.groupBy(*by).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    kept = stored.join(span, by, "left").where(F.col("lo").isNull() | (F.col(date) < F.col("lo")) | (F.col(date) > F.col("hi"))).select(*stored.columns)
    return kept.unionByName(fresh.select(*stored.columns))


def append_events(log: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The fresh events that the log does not have, numbered on from its last."""
    from pyspark.sql import Window as W

    last = log.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("last"))
    new = fresh.dropDuplicates(key).join(log.select(*key), key, "left_anti")
    numbered = new.withColumn("event_id", F.row_number().over(W.orderBy(*key)))
    return numbered.crossJoin(F.broadcast(last)).withColumn("event_id", F.col("event_id") + F.col("last")).drop("last")


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
