import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import asof as A
from quantloom.operators import calendar as C
from quantloom.operators import prices as P
from quantloom.operators import returns as R

D = dt.date.fromisoformat


def weekdays(first, last):
    day, out = D(first), []
    while day <= D(last):
        if day.weekday() < 5:
            out.append((day,))
        day += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def ends(spark):
    cal = spark.createDataFrame(weekdays("2020-01-01", "2024-12-31"), "session_date date")
    return C.endpoints(cal, C.windows(spark)).cache()


@pytest.mark.parametrize(
    "as_of, code, base",
    [
        ("2024-06-14", "1D", "2024-06-13"), ("2024-06-14", "WTD", "2024-06-07"), ("2024-06-14", "MTD", "2024-05-31"), ("2024-06-14", "QTD", "2024-03-29"),
        ("2024-06-14", "YTD", "2023-12-29"), ("2024-06-14", "5D", "2024-06-07"), ("2024-06-14", "10D", "2024-05-31"), ("2024-06-14", "1M", "2024-05-14"),
        ("2024-06-14", "1Y", "2023-06-14"), ("2024-06-14", "2Y_ANN", "2022-06-14"), ("2024-06-14", "SI_ANN", "2020-01-01"), ("2024-06-10", "3M", "2024-03-08"),
        ("2024-06-12", "1W", "2024-06-05"), ("2024-06-12", "WTD", "2024-06-07"), ("2024-11-15", "PQ", "2024-06-28"), ("2024-11-15", "QTD", "2024-09-30"),
        ("2020-06-15", "5Y_ANN", None), ("2020-01-01", "1D", None),
    ],
)
def test_base_dates(ends, as_of, code, base):
    row = ends.where((F.col("as_of_date") == as_of) & (F.col("code") == code)).first()
    assert row.base_date == (base and D(base))


def test_period_ends_in_the_past(ends):
    assert ends.where("as_of_date = '2024-11-15' and code = 'PQ'").first().end_date == D("2024-09-30")
    assert ends.where("as_of_date = '2024-11-15'").count() == 28


def bars(spark, rows):
    return spark.createDataFrame([("x", D(d), float(c), float(a)) for d, c, a in rows], "entity string, session_date date, close double, adj_close double")


THREE = [("2024-01-02", 100, 100), ("2024-01-03", 110, 110), ("2024-01-04", 121, 121)]
DIVIDEND = "entity string, ex_date date, amount double"


def test_total_return_index(spark):
    b = bars(spark, THREE)
    none = spark.createDataFrame([], DIVIDEND)
    assert [r.tri for r in P.total_return_index(b, none).orderBy("session_date").collect()] == [100.0, 110.0, 121.0]
    flat = bars(spark, [("2024-01-02", 100, 100), ("2024-01-03", 100, 100)])
    tri = P.total_return_index(flat, spark.createDataFrame([("x", D("2024-01-03"), 2.0)], DIVIDEND)).orderBy("session_date").collect()
    assert tri[1].tri / tri[0].tri == pytest.approx(1.02)
    one = bars(spark, [("2024-01-02", 10, 20)])
    assert P.total_return_index(one, spark.createDataFrame([("x", D("2024-01-02"), 2.0)], DIVIDEND)).first().tri == pytest.approx(22)
    early = spark.createDataFrame([("x", D("2023-12-31"), 2.0)], DIVIDEND)
    assert P.total_return_index(one, early).first().tri == 20


def test_matrix_and_gates(spark):
    b = bars(spark, THREE).withColumn("tri", F.col("adj_close"))
    cal = b.select("session_date")
    m = {(r.as_of_date, r.code): r for r in R.return_matrix(b, cal, C.windows(spark)).collect()}
    assert len(m) == 3 * 28
    assert m[D("2024-01-04"), "1D"].pr == pytest.approx(0.1)
    assert m[D("2024-01-04"), "1Y"].pr is None and m[D("2024-01-04"), "1Y"].tr is None
    flag = lambda d: spark.createDataFrame([("x", D(d))], "entity string, session_date date")
    g = [r for r in R.return_matrix(b, cal, C.windows(spark), flag("2024-01-04")).collect() if r.as_of_date == D("2024-01-04")]
    assert len(g) == 28 and all(r.gated and r.pr is None for r in g)
    g = {(r.as_of_date, r.code): r for r in R.return_matrix(b, cal, C.windows(spark), flag("2024-01-03")).collect()}
    assert g[D("2024-01-04"), "1D"].gated
    hashes = {r.input_hash for r in R.with_hash(R.return_matrix(b, cal, C.windows(spark))).collect()}
    assert len(hashes) == 3 * 28


def test_daily_returns_break_at_zero(spark):
    ret = [r.ret for r in P.daily_returns(bars(spark, [("2024-01-02", 100, 1), ("2024-01-03", 110, 1), ("2024-01-04", 99, 1)])).orderBy("session_date").collect()]
    assert ret == pytest.approx([0.1, 99 / 110 - 1])
    assert P.daily_returns(bars(spark, [("2024-01-02", 100, 1), ("2024-01-03", 0, 1), ("2024-01-04", 105, 1)])).count() == 0


def test_risk_metrics(spark):
    b = bars(spark, [("2024-01-02", 1, 100), ("2024-01-03", 1, 102), ("2024-01-04", 1, 102 * 0.99)])
    m = R.risk_metrics(b, b.select("session_date"), C.windows(spark, ["SI", "1D"])).where("as_of_date = '2024-01-04'").collect()
    si = next(r for r in m if r.window_id == 27)
    mean, sd = 0.005, math.sqrt(((0.02 - 0.005) ** 2 + (-0.01 - 0.005) ** 2))
    assert si.vol == pytest.approx(sd * math.sqrt(252)) and si.sharpe == pytest.approx(mean / sd * math.sqrt(252)) and si.n_obs == 2
    day = next(r for r in m if r.window_id == 1)
    assert day.vol is None and day.n_obs == 1


def test_extremes(spark):
    row = R.extremes(bars(spark, [("2024-01-02", 1, 100), ("2024-01-03", 1, 120), ("2024-01-04", 1, 90)])).where("as_of_date = '2024-01-04'").first()
    assert (row.high_52w, row.high_date, row.low_52w, row.low_date) == (120, D("2024-01-03"), 90, D("2024-01-04"))
    tie = R.extremes(bars(spark, [("2024-01-02", 1, 110), ("2024-01-03", 1, 50), ("2024-01-04", 1, 110), ("2024-01-05", 1, 60)])).where("as_of_date = '2024-01-05'").first()
    assert tie.high_date == D("2024-01-04")
    for back, high in ((365, 200), (366, 10)):
        first = str(D("2024-06-03") - dt.timedelta(back))
        assert R.extremes(bars(spark, [(first, 1, 200), ("2024-06-03", 1, 10)])).where("as_of_date = '2024-06-03'").first().high_52w == high


def test_split_day_is_no_anomaly(spark):
    rows = bars(spark, [("2024-01-02", 400, 0), ("2024-01-03", 101, 0), ("2024-01-04", 160, 0)])
    splits = spark.createDataFrame([("x", D("2024-01-03"), 4)], "entity string, ex_date date, ratio int").withColumn("ratio", F.col("ratio").cast("decimal(20,8)"))
    out = P.anomalies(rows.drop("adj_close"), splits).collect()
    assert [(r.session_date, r.flag) for r in out] == [(D("2024-01-04"), "price jump")]
    factor = {r.session_date: float(r.factor) for r in P.split_adjusted(rows.drop("adj_close"), splits).collect()}
    assert factor == {D("2024-01-02"): 4.0, D("2024-01-03"): 1.0, D("2024-01-04"): 1.0}


def test_forward_equals_trailing(spark):
    b = bars(spark, [("2024-01-02", 1, 100), ("2024-01-09", 1, 107), ("2024-03-25", 1, 90)])
    out = {r.horizon: r for r in R.forward_returns(b).where("as_of_date = '2024-01-02'").collect()}
    assert out["1W"].fwd_ret == pytest.approx(0.07)
    assert "1M" not in out  # the next bar is more than 14 days late
    assert "1Y" not in out


def test_band_does_not_move_on_rejection(spark):
    rows = spark.createDataFrame([("k", D(f"2024-01-0{i}"), float(v)) for i, v in enumerate([100, 130, 250, 140, 141], 1)], "key string, d date, v double")
    out = P.plausible(rows, "key", "d", "v", 0.5).orderBy("d").collect()
    assert [r.accepted for r in out] == [True, True, False, True, True]


def test_asof_strict_cap_and_preference(spark):
    left = spark.createDataFrame([("a", D("2024-01-05"), 1), ("a", D("2024-01-05"), 2), ("b", D("2024-01-05"), 3), (None, D("2024-01-05"), 4)], "k string, d date, n int")
    right = spark.createDataFrame([("a", D("2024-01-05"), 9.0, 2), ("a", D("2024-01-05"), 8.0, 1), ("a", D("2024-01-03"), 7.0, 1), ("b", D("2023-01-01"), 1.0, 1)], "k string, e date, v double, p int")
    get = lambda df: {r.n: r.v for r in df.collect()}
    assert get(A.asof_backward(left, right, ["k"], "d", "e", ["v"], prefer=[F.col("p")])) == {1: 8.0, 2: 8.0, 3: 1.0, 4: None}
    assert get(A.asof_backward(left, right, ["k"], "d", "e", ["v"], strict=True)) == {1: 7.0, 2: 7.0, 3: 1.0, 4: None}
    assert get(A.asof_backward(left, right, ["k"], "d", "e", ["v"], cap_days=30, prefer=[F.col("p")]))[3] is None
    assert get(A.asof_forward(left, right, ["k"], "d", "e", ["v"], strict=True)) == {1: None, 2: None, 3: None, 4: None}


def test_scalars(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    text = lambda x: S.period_date(F.lit(x))
    assert row(text("2023"), text("2023-04"), text("2023-Q3"), text("2023-04-05"), text("x")) == (D("2023-12-31"), D("2023-04-01"), D("2023-07-01"), D("2023-04-05"), None)
    assert row(S.ticker(F.lit(" brk-b ")), S.quote_symbol(F.lit("BRK.B"), F.lit(".DE"))) == ("BRK.B", "BRK-B.DE")
    token = S.identifier_token(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("brk b"), F.lit("XNYS"))
    assert row(token) == ("ticker:BRK.B@XNYS",)
    assert tuple(row(S.token_parts(token))[0]) == ("ticker", "BRK.B", "XNYS")
    assert row(S.normal_cdf(F.lit(1.96)), S.normal_cdf(F.lit(-1.0))) == pytest.approx((0.9750021, 0.1586553), abs=2e-7)
    r = lambda *x: S.window_return(*(F.lit(v) for v in x))
    assert row(r(100.0, 121.0, True, 730.5), r(100.0, 121.0, False, 1.0), r(0.0, 1.0, False, 1.0), r(1.0, 2.0, True, 0.0)) == (pytest.approx(0.1), pytest.approx(0.21), None, None)
