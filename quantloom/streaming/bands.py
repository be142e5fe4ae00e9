"""Streams: bands, extrema and memberships with state, upserts of vintages, incremental fills, event-time windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.merge import vintages


def banded(stream: DataFrame, limit: float) -> DataFrame:
    """(key, at, value, accepted) of a stream (key, at, value): as plausible() does in batch, the last accepted value of
    each key is the state, and a rejected one does not move it. Rows of one batch go by time."""

    def run(key, frames, state):
        prev = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("at")
        ok = []
        for v in rows.value:
            fine = v is not None and (prev is None or abs(v - prev) <= limit * abs(prev))
            ok.append(fine)
            prev = v if fine else prev
        if prev is not None:
            state.update((prev,))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "value": rows.value.to_numpy(), "accepted": ok})

    return stream.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, value double, accepted boolean", "prev double", "append", GroupStateTimeout.NoTimeout)


def extremes(stream: DataFrame, days: int = 365) -> DataFrame:
    """(key, at, value, high, low) of a stream (key, at date, value): the extremes of the days up to each row. A
    key's state is two queues, of the values that may yet be the highest or lowest; rows come in order of days,
    those of one batch are sorted, and a row that lies before its key's last is compared with what is left."""

    def run(key, frames, state):
        highs, lows = ([list(zip(*q)) for q in (state.get[0:2], state.get[2:4])] if state.exists else ([], []))
        rows = pd.concat(list(frames)).sort_values("at")
        out = []
        for at, v in zip(rows["at"], rows.value):
            day = at.toordinal()
            for queue, worse in ((highs, lambda x: x <= v), (lows, lambda x: x >= v)):
                while queue and worse(queue[-1][1]):
                    queue.pop()
                queue.append((day, v))
                while queue[0][0] < day - days:
                    queue.pop(0)
            out.append((highs[0][1], lows[0][1]))
        state.update(tuple([x[i] for x in q] for q in (highs, lows) for i in (0, 1)))
        yield pd.DataFrame({"key": key[0], "at": rows["at"].to_numpy(), "value": rows.value.to_numpy(), "high": [o[0] for o in out], "low": [o[1] for o in out]})

    kept = "high_days array<long>, highs array<double>, low_days array<long>, lows array<double>"
    return stream.groupBy("key").applyInPandasWithState(run, "key string, at date, value double, high double, low double", kept, "append", GroupStateTimeout.NoTimeout)


def memberships(stream: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) of a stream (key, at date, change, n) of joins and leaves: an interval when it
    closes, by the same rules as intervals() in batch; the day that the open one began is a key's state. Rows of
    one batch go by day, leaves first, and n."""

    def run(key, frames, state):
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(frames))
        rows = rows.assign(r=(rows.change != "leave").astype(int)).sort_values(["at", "r", "n"])
        out = []
        for at, change in zip(rows["at"], rows.change):
            if change == "join" and since is None:
                since = at
            elif change == "leave" and since is not None:
                if since < at:
                    out.append((key[0], since, at))
                since = None
        state.update((since,))
        yield pd.DataFrame(out, columns=["key", "valid_from", "valid_to"])

    return stream.groupBy("key").applyInPandasWithState(run, "key string, valid_from date, valid_to date", "since date", "append", GroupStateTimeout.NoTimeout)


def fill_sink(path: str, key: str, date: str):
    """A foreachBatch function for an incremental fill: of each key only rows after the last that is stored are
    added, one a date. A batch's rows go to a folder of its number, so that one that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key, date])
        if epoch > 0:
            # earlier batches only: a rerun does not see what it wrote itself
            before = spark.read.parquet(path).where(F.col("batch") < epoch)
            cursor = before.groupBy(key).agg(F.max(date).alias("__cursor"))
            fresh = fresh.join(cursor, key, "left").where(F.col("__cursor").isNull() | (F.col(date) > F.col("__cursor"))).drop("__cursor")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def vintage_sink(path: str, key: list[str]):
    """A foreachBatch function that keeps (key, value, first_value) at path: late rows are applied, never dropped.
    A batch's result is written beside the last and then named by its number, so that a batch that runs again
    reads what its predecessor left."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(*key).agg(F.max_by("value", "arrived").alias("value"))
        if epoch > 0:
            stored = spark.read.parquet(f"{path}/batch={epoch - 1}")
        else:
            stored = fresh.limit(0).withColumn("first_value", F.col("value"))
        vintages(stored, fresh, key).drop("action").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def counts(stream: DataFrame, at: str, by: list[str], size: str, late: str) -> DataFrame:
    """Rows in event-time windows, closed once the watermark passes them."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Rows in sessions that end after a gap."""
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
