"""Portfolio optimisation over some dozens of names: shrunk covariance, projected gradient, long and short legs.

The covariance comes from aligned daily returns by aggregation; what follows is a few dozen numbers squared, and
runs in numpy: on the driver for one problem, in grouped tasks for one problem a date.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_NAMES = 60
MIN_DATES = 30
STEPS = 800


class OptimiserError(ValueError):
    """A problem without a sound answer: too few names or dates, or limits that contradict."""


def aligned(daily: DataFrame, names: list, least: int = MIN_DATES) -> DataFrame:
    """Returns of dates on which every name has one."""
    rows = daily.where(F.col("entity").isin(names))
    days = rows.groupBy("session_date").agg(F.countDistinct("entity").alias("n")).where(F.col("n") == len(names)).select("session_date")
    return rows.join(F.broadcast(days), "session_date", "left_semi")


def covariance(daily: DataFrame, most: int = 2000) -> DataFrame:
    """(a, b, cov, n): sample covariances of all pairs of names on their common dates; over most names are refused,
    for the result has a row for each two of them."""
    n = daily.agg(F.countDistinct("entity").alias("n")).first().n
    if n > most:
        raise OptimiserError(f"{n} names; at most {most}")
    x = daily.select("session_date", F.col("entity").alias("a"), F.col("ret").alias("x"))
    y = daily.select("session_date", F.col("entity").alias("b"), F.col("ret").alias("y"))
    return x.join(y, "session_date").where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.count("x").alias("n"))


def shrunk(returns: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk to constant correlation, by the intensity that Ledoit and Wolf (2004) derive: rows are dates."""
    t, n = returns.shape
    x = returns - returns.mean(axis=0)
    s = x.T @ x / t
    sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
    if n < 2:
        return s, 0.0
    corr = s / np.outer(sd, sd)
    rbar = (corr.sum() - n) / (n * (n - 1))
    target = rbar * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    x2 = x**2
    pi_matrix = x2.T @ x2 / t - s**2
    third = (x**3).T @ x / t - np.diag(s)[:, None] * s
    np.fill_diagonal(third, 0)
    rho = np.trace(pi_matrix) + rbar * (third * np.outer(1 / sd, sd)).sum()
    gamma = ((s - target) ** 2).sum()
    delta = 0.0 if gamma <= 0 else min(1.0, max(0.0, (pi_matrix.sum() - rho) / gamma / t))
    return delta * target + (1 - delta) * s, delta


def to_simplex(v: np.ndarray, total: float = 1.0, cap: float | None = None) -> np.ndarray:
    """The nearest point with entries from 0 to cap that add up to total, by bisection on the shift."""
    if cap is not None and cap * len(v) < total - 1e-12:
        raise OptimiserError(f"{len(v)} names of at most {cap} cannot hold {total}")
    top = np.inf if cap is None else cap
    low, high = v.min() - total - 1, v.max() + 1
    for _ in range(100):
        mid = (low + high) / 2
        if np.clip(v - mid, 0, top).sum() > total:
            low = mid
        else:
            high = mid
    w = np.clip(v - (low + high) / 2, 0, top)
    return w * (total / w.sum()) if w.sum() > 0 and cap is None else w


def to_legs(v: np.ndarray, is_long: np.ndarray, gross: float = 1.0, cap: float | None = None) -> np.ndarray:
    """Long names on a simplex of half the gross, short ones on its negative."""
    out = np.zeros(len(v))
    out[is_long] = to_simplex(v[is_long], gross / 2, cap)
    out[~is_long] = -to_simplex(-v[~is_long], gross / 2, cap)
    return out


def descend(cov: np.ndarray, mean: np.ndarray, risk: float, project, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Minimises risk / 2 w'Cw - m'w over project's set; the step is from Gershgorin's bound on the curvature."""
    bound = risk * np.abs(cov).sum(axis=1).max()
    w = project(start)
    for _ in range(steps):
        w = project(w - (risk * cov @ w - mean) / max(bound, 1e-12))
    return w


def min_variance(cov: np.ndarray, cap: float | None = None) -> np.ndarray:
    n = len(cov)
    return descend(cov, np.zeros(n), 1.0, lambda v: to_simplex(v, 1.0, cap), np.full(n, 1 / n))


def max_sharpe(cov: np.ndarray, mean: np.ndarray, cap: float | None = None) -> np.ndarray:
    """The best ratio of mean to risk along a path of risk aversions."""
    n, best = len(cov), None
    for risk in np.geomspace(0.5, 500, 25):
        w = descend(cov, mean, float(risk), lambda v: to_simplex(v, 1.0, cap), np.full(n, 1 / n), 300)
        sd = math.sqrt(max(w @ cov @ w, 1e-300))
        if best is None or mean @ w / sd > best[0]:
            best = (mean @ w / sd, w)
    return best[1]


def tilt(cov: np.ndarray, score: np.ndarray, base: np.ndarray, strength: float, cap: float | None = None) -> np.ndarray:
    """Weights near base that lean to high scores."""
    return descend(np.eye(len(base)) + cov, base + strength * score, 1.0, lambda v: to_simplex(v, 1.0, cap), base, 200)


def matrix(daily: DataFrame, names: list) -> tuple[np.ndarray, list]:
    """Aligned returns as dates by names; names are bounded by MAX_NAMES."""
    if not 2 <= len(names) <= MAX_NAMES:
        raise OptimiserError(f"from 2 to {MAX_NAMES} names, not {len(names)}")
    table = aligned(daily, names).select("session_date", "entity", "ret").toPandas()
    if table.session_date.nunique() < MIN_DATES:
        raise OptimiserError(f"{table.session_date.nunique()} common dates; {MIN_DATES} are needed")
    wide = table.pivot(index="session_date", columns="entity", values="ret").sort_index()
    return wide.to_numpy(float), wide.columns.tolist()


def solve(daily: DataFrame, names: list, objective: str = "min_variance", cap: float | None = None, holdout: float = 0.25, long_names: list | None = None) -> DataFrame:
    """(entity, weight, in_sample_vol, out_of_sample_vol): weights from the earlier dates, checked on the later."""
    x, order = matrix(daily, names)
    cut = max(MIN_DATES // 2, int(len(x) * (1 - holdout)))
    cov, _ = shrunk(x[:cut])
    if objective == "min_variance":
        w = min_variance(cov, cap)
    elif objective == "max_sharpe":
        w = max_sharpe(cov, x[:cut].mean(axis=0), cap)
    elif objective == "long_short":
        is_long = np.isin(order, long_names or [])
        if is_long.all() or not is_long.any():
            raise OptimiserError("both legs need names")
        w = descend(cov, np.zeros(len(order)), 1.0, lambda v: to_legs(v, is_long, 1.0, cap), np.where(is_long, 0.5 / is_long.sum(), -0.5 / (~is_long).sum()))
    else:
        raise OptimiserError(f"objective {objective!r}")
    year = math.sqrt(252)
    inside, outside = ((x[:cut] @ w).std(ddof=1) * year, (x[cut:] @ w).std(ddof=1) * year if len(x) - cut > 1 else None)
    rows = [(int(e), float(v), float(inside), None if outside is None else float(outside)) for e, v in zip(order, w)]
    return daily.sparkSession.createDataFrame(rows, "entity long, weight double, in_sample_vol double, out_of_sample_vol double")


def covered(wide: pd.DataFrame, least: int = MIN_DATES) -> pd.DataFrame:
    """Dates by names without a gap: the worst covered names go until so many dates have all the others; empty if
    two names have not as many."""
    kept = wide.notna().sum().sort_values(ascending=False, kind="stable").index.tolist()
    while len(kept) >= 2:
        full = wide[kept].dropna()
        if len(full) >= least:
            return full
        kept.pop()
    return wide.iloc[:0, :0]


def min_variance_by_date(held: DataFrame, daily: DataFrame, days: int = 365, cap: float | None = None, leg_cap: int = MAX_NAMES // 2, steps: int = STEPS) -> DataFrame:
    """held(rebalance_date, entity, rank, and leg, long or short, if there are two) -> (rebalance_date, entity,
    weight, dropped): a problem for each rebalance date, from the returns of the days before it.

    Of each leg the leg_cap best by rank take part; a name that lacks history goes before a date does; dropped
    counts the selected names without a weight. A date that cannot be solved, as too few names or dates are
    left or a leg is empty, has no rows. Legs hold half of the gross each.
    """
    two = "leg" in held.columns
    names = held.select("rebalance_date", "entity", "rank", *([F.col("leg")] if two else [F.lit("long").alias("leg")]))
    nth = F.row_number().over(W.partitionBy("rebalance_date", "leg").orderBy("rank", "entity"))
    chosen = F.count(F.lit(1)).over(W.partitionBy("rebalance_date"))
    legs = names.withColumns({"nth": nth, "selected": chosen}).where(F.col("nth") <= leg_cap).select("rebalance_date", "entity", "leg", "selected")
    spans = held.select("rebalance_date").distinct()
    near = spans.select("rebalance_date", F.explode(F.sequence(F.date_sub("rebalance_date", days - 1), F.col("rebalance_date"), F.expr("interval 1 day"))).alias("session_date"))
    rows = legs.join(near, "rebalance_date").join(daily.select("entity", "session_date", "ret"), ["entity", "session_date"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pdf[["rebalance_date", "entity"]].iloc[:0].assign(weight=0.0, dropped=0)
        wide = covered(pdf.pivot_table(index="session_date", columns="entity", values="ret"))
        if len(wide.columns) < 2:
            return none
        is_long = (pdf.drop_duplicates("entity").set_index("entity").leg == "long")[wide.columns].to_numpy()
        if two and (is_long.all() or not is_long.any()):
            return none
        cov = shrunk(wide.to_numpy(float))[0]
        try:
            if two:
                w = descend(cov, np.zeros(len(cov)), 1.0, lambda v: to_legs(v, is_long, 1.0, cap), np.where(is_long, 0.5 / is_long.sum(), -0.5 / (~is_long).sum()), steps)
            else:
                w = descend(cov, np.zeros(len(cov)), 1.0, lambda v: to_simplex(v, 1.0, cap), np.full(len(cov), 1 / len(cov)), steps)
        except OptimiserError:
            return none
        out = pd.DataFrame({"rebalance_date": pdf.rebalance_date.iloc[0], "entity": wide.columns, "weight": w})
        out = out[out.weight.abs() > 1e-9]
        return out.assign(dropped=int(pdf.selected.iloc[0]) - len(out))

    kinds = dict(held.dtypes)
    return rows.groupBy("rebalance_date").applyInPandas(run, f"rebalance_date date, entity {kinds['entity']}, weight double, dropped long")
