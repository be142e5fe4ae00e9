import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import factors as Q
from quantloom.operators import fx as X
from quantloom.operators import lineage as L
from quantloom.operators import optimiser as O
from quantloom.operators import portfolio as PF
from quantloom.operators import quality as V
from quantloom.operators import rates as RT
from quantloom.operators import stats as ST
from quantloom.operators import universe as U

D = dt.date.fromisoformat


def test_conversion(spark):
    rates = spark.createDataFrame([("BRL", D("2024-01-10"), 5.0, "a"), ("JPY", D("2024-01-09"), 160.0, "a"), ("CHF", D("2024-01-04"), 0.9, "a"), ("OLD", D("2023-01-01"), 2.0, "a")], "ccy string, as_of_date date, rate double, source string")
    asks = [(100.0, "USD", "BRL"), (100.0, "BRL", "JPY"), (100.0, "BRL", "OLD"), (100.0, "BRL", "NIX"), (100.0, "BRL", "CHF"), (7.0, "NIX", "NIX"), (100.0, "JPY", "USD")]
    df = spark.createDataFrame([(*a, D("2024-01-10")) for a in asks], "amount double, from_ccy string, to_ccy string, as_of_date date")
    got = {(r.from_ccy, r.to_ccy): r.converted for r in X.convert(df, rates).collect()}
    assert got == {("USD", "BRL"): 500, ("BRL", "JPY"): pytest.approx(3200), ("BRL", "OLD"): None, ("BRL", "NIX"): None, ("BRL", "CHF"): None, ("NIX", "NIX"): 7, ("JPY", "USD"): 0.625}


def test_curves(spark):
    at = lambda points, *exprs: tuple(RT.as_arrays(spark.createDataFrame([("k", float(t), float(v)) for t, v in points.items()], "k string, tenor double, value double"), ["k"]).select(*exprs).first())
    c = F.col("curve")
    assert at({1: 2, 2: 4}, *(RT.at_tenor(c, F.lit(t)) for t in (1.5, 0.5, 2.5, 2.0))) == (3, None, None, 4)
    assert at({2: 4, 10: 4.5}, RT.spread_bp(c, 2, 10)) == (pytest.approx(50),)
    assert at({2: 4, 5: 4.3, 10: 4.5}, RT.butterfly_bp(c, 2, 5, 10)) == (pytest.approx(10),)
    assert at({7: 4, 10: 4.4}, RT.roll_down_bp(c, 10, 3)) == (pytest.approx(40),)
    flat = RT.as_arrays(spark.createDataFrame([("k", 1.0, 5.0), ("k", 10.0, 5.0)], "k string, tenor double, value double"), ["k"])
    row = RT.dv01(spark.createDataFrame([("x", 10.0, 100.0)], "leg string, tenor double, amount double"), flat, ["k"]).first()
    assert row.pv == pytest.approx(60.653, abs=1e-3) and row.dv01 == pytest.approx(0.0607, abs=1e-4)


def log(spark, *rows):
    schema = "event_id long, figi string, change string, effective_date date, raw_identifier string, universe_id string, reverses string"
    return spark.createDataFrame([(i, f, c, D(f"2024-01-{d:02d}"), raw, "u", rev) for i, (f, c, d, raw, rev) in enumerate(rows, 1)], schema)


def spans(df):
    return sorted((r.figi, r.raw_identifier, r.valid_from.day, r.valid_to and r.valid_to.day) for r in df.collect())


def test_membership_projection(spark):
    iv = lambda *rows: spans(U.intervals(log(spark, *rows)))
    assert iv(("A", "join", 2, "A", None), ("A", "leave", 10, "A", None)) == [("A", "A", 2, 10)]
    assert iv(("A", "join", 2, "A", None)) == [("A", "A", 2, None)]
    assert iv(("F", "join", 2, "FB", None), ("F", "leave", 5, "FB", None), ("F", "join", 5, "META", None)) == [("F", "META", 2, None)]
    assert iv(("A", "join", 2, "A", None), ("A", "correct", 8, "A", None)) == [("A", "A", 2, 8)]
    assert iv(("A", "leave", 10, "A", None), ("A", "join", 2, "A", None)) == [("A", "A", 2, 10)]
    assert iv(("A", "join", 2, "A", None), ("A", "join", 9, "A", None), ("A", "correct", 3, "A", "A|join|2024-01-02")) == [("A", "A", 9, None)]
    assert iv(("A", "join", 2, "A", None), ("A", "correct", 3, "A", "nothing|join|2024-01-02")) == [("A", "A", 2, None)]
    once = U.intervals(log(spark, ("A", "join", 2, "A", None), ("A", "leave", 4, "A", None), ("A", "join", 6, "A", None), ("B", "join", 3, "B", None)))
    again = U.events_of(once).withColumns({"event_id": F.monotonically_increasing_id(), "reverses": F.lit(None).cast("string")})
    assert spans(U.intervals(again)) == spans(once)
    with pytest.raises(U.PitBoundaryError):
        U.refuse_before("2020-01-01", "2021-01-01")


def raws(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "entity string, raw double")


def test_scores(spark):
    w = {r.entity: r.raw for r in Q.winsorised(raws(spark, {f"F{i}": i for i in range(100)} | {"X": 1e9})).collect()}
    assert max(w.values()) <= 99 and w["F50"] == 50
    s = {r.entity: r for r in Q.scores(raws(spark, {"A": 0.1, "B": 0.3, "C": 0.2}), "low").collect()}
    assert [s[k]["rank"] for k in "ACB"] == [1, 2, 3] and s["A"].zscore > 0 and s["A"].pctile == pytest.approx(2 / 3)
    assert all(r.zscore == 0 for r in Q.scores(raws(spark, {"A": 1, "B": 1}), "high").collect())
    out, skipped = Q.run(["size", "nothing", "vol_1y"], "2024-01-01", raws(spark, {"A": 1}), {"caps": spark.createDataFrame([("A", D("2023-01-01"), 5.0)], "entity string, as_of_date date, market_cap_usd double")})
    assert out.count() == 1 and skipped == {"nothing": "unknown factor", "vol_1y": "no daily"}


def test_selection_and_weights(spark):
    f = spark.createDataFrame([(D("2024-01-02"), e, float(v)) for e, v in {"A": 3, "B": 2, "C": 1, "D": 0.5, "E": 0.1}.items()], "rebalance_date date, entity string, value double")
    pick = lambda **k: sorted(r.entity for r in B.selected(f, **k).collect())
    assert pick(top_n=2) == ["A", "B"] and pick(direction="low", top_n=2) == ["D", "E"] and pick(pct=0.4) == ["A", "B"] and pick(pct=0.01) == ["A"]
    g = spark.createDataFrame([(D(d), e, float(v)) for d, x in {"2024-01-02": {"A": 9, "B": 8, "C": 7, "D": 1, "E": 0}, "2024-02-02": {"A": 5, "D": 4, "C": 3, "B": 2.5, "E": 1}}.items() for e, v in x.items()], "rebalance_date date, entity string, value double")
    legs = lambda k: sorted(r.entity for r in B.sticky_legs(g, 3, 0, k).where("rebalance_date = '2024-02-02' and leg = 'long'").collect())
    assert legs(1.5) == ["A", "B", "C"] and legs(1.0) == ["A", "C", "D"]
    held = spark.createDataFrame([(D("2024-01-02"), "A", 0.75), (D("2024-01-02"), "B", 0.25)], "rebalance_date date, entity string, weight double")
    daily = spark.createDataFrame([(D("2024-01-03"), "A", 0.01), (D("2024-01-03"), "B", 0.03), (D("2024-01-04"), "A", 0.02)], "session_date date, entity string, ret double")
    ret = [r.ret for r in B.holding_returns(held, daily).orderBy("session_date").collect()]
    assert ret == pytest.approx([0.015, 0.02])
    assert B.turnover(held).first().turnover == pytest.approx(0.5)
    neutral = B.weights(B.sticky_legs(g, 2, 2), "neutral").where("rebalance_date = '2024-01-02'").collect()
    assert sum(r.weight for r in neutral) == pytest.approx(0) and sum(abs(r.weight) for r in neutral) == pytest.approx(1)
    for bad in ({"top_n": 1, "pct": 0.1}, {}, {"top_n": 0}, {"top_n": 1, "direction": "up"}, {"top_n": 1, "borrow_bps": 5}, {"top_n": 1, "scheme": "neutral"}):
        with pytest.raises(B.SpecError):
            B.checked(bad)


def test_net_returns_and_statistics(spark):
    held = spark.createDataFrame([(D("2024-01-02"), "A", 0.5), (D("2024-01-02"), "B", -0.5), (D("2024-01-04"), "A", 0.5), (D("2024-01-04"), "C", -0.5)], "rebalance_date date, entity string, weight double")
    gross = spark.createDataFrame([(D("2024-01-03"), 0.01), (D("2024-01-04"), -0.02), (D("2024-01-05"), 0.03)], "session_date date, ret double")
    net = [r.net for r in B.net_returns(gross, held, 100, 252).orderBy("session_date").collect()]
    accrual = 0.5 * 252 / 1e4 / 252
    assert net == pytest.approx([0.01 - 0.5 * 0.01 - accrual, -0.02 - 0.5 * 0.01 - accrual, 0.03 - accrual])
    s = B.statistics(gross).first()
    assert s.n == 3 and s.total == pytest.approx(1.01 * 0.98 * 1.03 - 1) and s.max_drawdown == pytest.approx(-0.02)


def test_portfolio_steps(spark):
    w = spark.createDataFrame([("p", D("2026-01-01"), "A", 1.0), ("p", D("2026-01-03"), "B", 1.0)], "portfolio_id string, as_of_date date, entity string, weight double")
    rows = {"A": {2: 0.02, 3: 0.10, 4: 0.70}, "B": {2: 0.50, 3: 0.03, 4: 0.04}}
    daily = spark.createDataFrame([(D(f"2026-01-0{d}"), e, r) for e, x in rows.items() for d, r in x.items()], "session_date date, entity string, ret double")
    out = PF.daily_series(w, daily).orderBy("session_date").collect()
    assert [r.ret for r in out] == pytest.approx([0.02, 0.10, 0.04])
    assert PF.performance(PF.daily_series(w, daily), daily.where("entity = 'B'").select("session_date", "ret")).first().sharpe is None


def test_overfitting(spark):
    assert ST.NORMAL.inv_cdf(ST.NORMAL.cdf(0.7)) == pytest.approx(0.7)
    assert ST.psr(0.1, 250, 0.0, 3.0) == pytest.approx(ST.NORMAL.cdf(0.1 * math.sqrt(249) / math.sqrt(1 + 0.5 * 0.01)))
    assert ST.expected_max_sharpe(1.0, 100) == pytest.approx(2.53, abs=0.02) and ST.min_track_years(1) == 0
    rng = np.random.default_rng(0)
    days = [D("2020-01-01") + dt.timedelta(i) for i in range(160)]
    noise = rng.normal(size=(12, 160)) * 0.01
    df = lambda x: spark.createDataFrame([(t, d, float(x[t, i])) for t in range(len(x)) for i, d in enumerate(days)], "trial int, session_date date, ret double")
    out = ST.pbo(df(noise), 8).collect()
    assert len(out) == math.comb(8, 4)
    blocks = np.array_split(np.arange(160), 8)
    for r, half in zip(sorted(out, key=lambda r: r.split), itertools.combinations(range(8), 4)):
        inside = np.concatenate([blocks[b] for b in half])
        best = int((noise[:, inside].mean(axis=1) / noise[:, inside].std(axis=1)).argmax())
        assert r.best == best
    skilled = noise.copy()
    skilled[3] += 0.02
    assert all(r.logit > 0 for r in ST.pbo(df(skilled), 8).collect())
    found = ST.deflated_sharpe(df(skilled))
    assert found["best"] == 3 and found["dsr"] > 0.95 and ST.verdict(found["dsr"], 0.0)


def test_optimiser(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=7)
    for cap in (None, 0.3):
        w = O.to_simplex(v, 1.0, cap)
        assert w.sum() == pytest.approx(1) and w.min() >= 0 and (cap is None or w.max() <= cap + 1e-9)
        for _ in range(200):  # no feasible point is nearer
            z = O.to_simplex(rng.normal(size=7), 1.0, cap)
            assert ((v - w) ** 2).sum() <= ((v - z) ** 2).sum() + 1e-9
    with pytest.raises(O.OptimiserError):
        O.to_simplex(v, 1.0, 0.1)
    x = rng.normal(size=(200, 3)) * [0.01, 0.02, 0.04]
    cov, delta = O.shrunk(x)
    assert 0 <= delta <= 1 and np.linalg.eigvalsh(cov).min() > 0
    assert O.min_variance(np.diag([1.0, 4.0])) == pytest.approx([0.8, 0.2], abs=1e-3)
    legs = O.to_legs(v, np.array([True, True, True, False, False, False, False]))
    assert legs.sum() == pytest.approx(0) and np.abs(legs).sum() == pytest.approx(1)
    days = [D("2020-01-01") + dt.timedelta(i) for i in range(200)]
    daily = spark.createDataFrame([(d, e, float(x[i, e])) for i, d in enumerate(days) for e in range(3)], "session_date date, entity long, ret double")
    c = {(r.a, r.b): r.cov for r in O.covariance(daily).collect()}
    assert c[0, 1] == pytest.approx(np.cov(x.T)[0, 1]) and len(c) == 6
    for objective in ("min_variance", "max_sharpe", "long_short"):
        out = O.solve(daily, [0, 1, 2], objective, long_names=[0]).collect()
        assert sum(abs(r.weight) for r in out) == pytest.approx(1, abs=1e-6)
    held = spark.createDataFrame([(D("2020-06-01"), e) for e in range(3)], "rebalance_date date, entity long")
    by_date = {r.entity: r.weight for r in O.min_variance_by_date(held.withColumn("rank", F.col("entity")), daily).collect()}
    assert sum(by_date.values()) == pytest.approx(1) and by_date[0] > by_date[2]
    with pytest.raises(O.OptimiserError):
        O.solve(daily.where("session_date < '2020-01-10'"), [0, 1, 2])


def test_quality_runner(spark):
    a, b = spark.range(5), spark.range(3)
    key = lambda df: df.withColumnRenamed("id", "k")

    def broken():
        raise RuntimeError("no")

    checks = {"ok": lambda: (a, V.orphans(key(b), key(a), ["k"])), "bad": lambda: (a, V.orphans(key(a), key(b), ["k"])), "crash": broken}
    got = {r.name: (r.status, r.checked, r.failures) for r in V.run(spark, checks).collect()}
    assert got == {"ok": ("pass", 5, 0), "bad": ("fail", 5, 2), "crash": ("fail", 0, 0)}
    assert V.worst(["pass", "warn"]) == "warn" and V.worst([]) == "pass"


def test_lineage(spark):
    s = ["select * from raw.a join raw.b using (x)", "insert into mart.c values (1)", "with q as (select * from raw.d) insert into mart.e select * from q join mart.f using (x)"]
    assert L.classify(spark, s[0]) == {"kind": "read", "target": None, "sources": ["raw.a", "raw.b"]}
    assert L.edges(spark, s[:2]) == [("raw.a", "mart.c", "correlated"), ("raw.b", "mart.c", "correlated")]
    assert ("mart.f", "mart.e", "direct") in L.edges(spark, s)
    assert "raw_a[raw.a] -.-> mart_c[mart.c]" in L.mermaid(L.edges(spark, s))


def test_registry_and_contract(spark):
    from quantloom.operators import identity as I

    assert I.universe_spec("ftse-100", "index")["kind"] == "index"
    assert I.universe_spec("top", "criteria", {"top_n": 5})["config"] == {"top_n": 5}
    for bad in (("", "index"), ("Bad Id", "index"), ("x1", "nothing"), ("top", "criteria")):
        with pytest.raises(I.RegistryError):
            I.universe_spec(*bad)
    bars = spark.createDataFrame([(1, 2.0)], "entity long, close double")
    assert I.conformance(bars, {"entity": "bigint", "close": "double"}) == []
    assert I.conformance(bars, {"entity": "string", "volume": "double"}) == ["no column volume", "entity is bigint, not string"]


def test_finite_values_only(spark):
    from quantloom.functions.scalars import finite

    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r.x for r in rows.where(finite(F.col("x"))).collect()] == [1.0]


def test_delisted_names_keep_their_history(spark):
    """Survivorship: transforms look at no status, so that names which have gone still have returns."""
    from quantloom.operators import prices as P

    bars = spark.createDataFrame([(e, D("2020-01-01") + dt.timedelta(i), 10.0 + i, "delisted" if e else "active") for e in range(2) for i in range(3)], "entity long, session_date date, close double, status string")
    assert {r.entity: r.n for r in P.daily_returns(bars).groupBy("entity").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 2}


def test_tilt_and_trimmed_legs(spark):
    cov = np.diag([0.04, 0.04, 0.04])
    w = O.tilt(cov, np.array([1.0, 0.0, -1.0]), np.full(3, 1 / 3), 0.2)
    assert w.sum() == pytest.approx(1) and w[0] > w[1] > w[2] >= 0
    rng = np.random.default_rng(8)
    days = [D("2020-01-01") + dt.timedelta(i) for i in range(120)]
    daily = [(d, e, float(x)) for e, sd in enumerate((0.01, 0.02, 0.01, 0.03, 0.02)) for d, x in zip(days, rng.normal(size=120) * sd)]
    daily = [r for r in daily if r[1] != 4 or r[0] >= days[110]]  # the last name has hardly a history
    daily = spark.createDataFrame(daily, "session_date date, entity long, ret double")
    legs = [(D("2020-04-29"), e, leg, r) for e, leg, r in ((0, "long", 1), (1, "long", 2), (4, "long", 3), (2, "short", 1), (3, "short", 2))]
    held = spark.createDataFrame(legs + [(D("2020-01-05"), 0, "long", 1), (D("2020-01-05"), 2, "short", 1)], "rebalance_date date, entity long, leg string, rank int")
    out = {r.entity: r for r in O.min_variance_by_date(held, daily).collect()}  # the early date has too few days
    assert set(out) == {0, 1, 2, 3} and all(r.dropped == 1 for r in out.values())
    assert out[0].weight + out[1].weight == pytest.approx(0.5) and out[2].weight + out[3].weight == pytest.approx(-0.5)
    assert out[0].weight > out[1].weight > 0 > out[3].weight > out[2].weight
    one = {r.entity for r in O.min_variance_by_date(held, daily, leg_cap=1).collect()}
    assert one == {0, 2}
