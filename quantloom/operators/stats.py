"""Over-fitting statistics of backtests: moments, probabilistic and deflated Sharpe ratios, CSCV."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329
NORMAL = NormalDist()


def moments(daily: DataFrame, value: str = "ret", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, population sd, skewness, and kurtosis (3 for a normal)."""
    return daily.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))


def psr(sharpe: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float | None:
    """The probability that the true Sharpe ratio (per period) is over the benchmark."""
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if n < 2 or spread <= 0:
        return None
    return NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Of that many trials without skill."""
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(trials: DataFrame) -> dict:
    """trials(trial, session_date, ret) -> the best trial, its Sharpe ratio, and the deflated one."""
    rows = moments(trials, by=("trial",)).where("sd > 0").collect()  # a row for each trial
    sharpes = {r.trial: r["mean"] / r.sd for r in rows}
    if not sharpes:
        return {"best": None, "sharpe": None, "dsr": None}
    best = max(sharpes, key=lambda t: (sharpes[t], -t))
    r = next(x for x in rows if x.trial == best)
    variance = float(np.var(list(sharpes.values()), ddof=1)) if len(sharpes) > 1 else 0.0
    return {"best": best, "sharpe": sharpes[best], "dsr": psr(sharpes[best], r.n, r["skew"], r["kurt"], expected_max_sharpe(variance, len(sharpes)))}


def min_track_years(trials: int, target: float = 1.0) -> float:
    """Years below which the best of that many trials without skill is expected to reach the target."""
    return (expected_max_sharpe(1.0, trials) / target) ** 2


def pbo(trials: DataFrame, blocks: int = 16) -> DataFrame:
    """(split, best, logit) for every way to halve the blocks: where the best trial in one half ranks in the other.

    Blocks are summed once; each split is then a handful of sums, dealt out over the executors. The probability of
    overfitting is the share of logits of zero or less.
    """
    if blocks % 2 or blocks < 2:
        raise ValueError("blocks must be even")
    spark = trials.sparkSession
    from pyspark.sql import Window as W

    days = trials.select("session_date").distinct().withColumn("block", F.ntile(blocks).over(W.orderBy("session_date")) - 1)
    sums = trials.join(F.broadcast(days), "session_date").groupBy("trial", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    table = sums.toPandas()  # trials by blocks
    names = sorted(table.trial.unique())
    cube = np.zeros((3, len(names), blocks))
    for i, c in enumerate(("n", "s", "q")):
        cube[i] = table.pivot(index="trial", columns="block", values=c).reindex(index=names, columns=range(blocks)).fillna(0).to_numpy(float)

    def sharpe(x):
        n, s, q = x
        mean = s / np.maximum(n, 1)
        var = q / np.maximum(n, 1) - mean**2
        return np.where(var > 1e-24, mean / np.sqrt(np.maximum(var, 1e-24)), 0.0)

    def run(frames):
        for pdf in frames:
            out = []
            for split, text in zip(pdf.split, pdf.chosen):
                mask = np.zeros(blocks, bool)
                mask[[int(x) for x in text.split(",")]] = True
                inside, outside = sharpe(cube[:, :, mask].sum(axis=2)), sharpe(cube[:, :, ~mask].sum(axis=2))
                best = int(inside.argmax())
                rank = (outside < outside[best]).sum() + (1 + (outside == outside[best]).sum()) / 2  # ties share the middle
                w = rank / (len(names) + 1)
                out.append((int(split), int(names[best]), math.log(w / (1 - w))))
            yield pd.DataFrame(out, columns=["split", "best", "logit"])

    halves = [(i, ",".join(map(str, c))) for i, c in enumerate(itertools.combinations(range(blocks), blocks // 2))]
    return spark.createDataFrame(halves, "split int, chosen string").repartition(8).mapInPandas(run, "split int, best int, logit double")


def verdict(dsr: float | None, share: float) -> bool:
    return dsr is not None and dsr > 0.95 and share <= 0.05
