"""Domain frames derived from the driver's relational tables, in SQL that Spark and DuckDB both read.

Entities are nations, exchanges regions; a nation's daily price is its expanding Σprice/Σquantity. Sums are of
decimals, so that both engines get the same doubles. Only the frames share their text with the oracle: what
is computed from them is DataFrame code here and plain SQL there.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FRAMES: dict[str, tuple[tuple[str, ...], str]] = {
    "daily": (
        (),
        """SELECT s.s_nationkey AS entity, CAST(l.l_shipdate AS DATE) AS session_date,
             SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS ext, SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS qty
           FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
           GROUP BY s.s_nationkey, CAST(l.l_shipdate AS DATE)""",
    ),
    "closes": (
        ("daily",),
        """SELECT entity, session_date, CAST(qty AS DOUBLE) AS volume,
             CAST(SUM(ext) OVER (PARTITION BY entity ORDER BY session_date) AS DOUBLE)
               / CAST(SUM(qty) OVER (PARTITION BY entity ORDER BY session_date) AS DOUBLE) AS close
           FROM daily""",
    ),
    "prices": (
        ("closes",),
        """SELECT entity, session_date, COALESCE(prev, close) AS open, GREATEST(COALESCE(prev, close), close) AS high,
             LEAST(COALESCE(prev, close), close) AS low, close, volume
           FROM (SELECT *, LAG(close) OVER (PARTITION BY entity ORDER BY session_date) AS prev FROM closes) x""",
    ),
    "calendar": (("daily",), "SELECT DISTINCT session_date FROM daily"),
    "splits": (
        ("daily",),
        """SELECT entity, MIN(session_date) AS ex_date, CAST(2 AS DECIMAL(20,8)) AS ratio FROM daily
           WHERE year(session_date) % 3 = 0 GROUP BY entity, year(session_date)""",
    ),
    "dividends": (
        ("closes",),
        """SELECT entity, session_date AS ex_date, ROUND(close * 0.01, 4) AS amount FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY entity, year(session_date), quarter(session_date) ORDER BY session_date) AS nth
             FROM closes) x WHERE nth = 1 AND entity % 2 = 0""",
    ),
    "flags": (
        ("closes",),
        """SELECT entity, session_date FROM (
             SELECT *, LAG(close) OVER (PARTITION BY entity ORDER BY session_date) AS prev FROM closes) x
           WHERE ABS(close / prev - 1) > 0.2""",
    ),
    "index_levels": (
        ("daily",),
        """SELECT region, session_date, CAST(SUM(ext) OVER (PARTITION BY region ORDER BY session_date) AS DOUBLE)
               / CAST(SUM(qty) OVER (PARTITION BY region ORDER BY session_date) AS DOUBLE) AS level
           FROM (SELECT n.n_regionkey AS region, d.session_date, SUM(d.ext) AS ext, SUM(d.qty) AS qty
                 FROM daily d JOIN {nation} n ON d.entity = n.n_nationkey GROUP BY n.n_regionkey, d.session_date) x""",
    ),
    "fx_rate": (
        (),
        """SELECT r.r_name AS ccy, CAST(o.o_orderdate AS DATE) AS as_of_date,
             CASE WHEN o.o_orderpriority < '3' THEN 'first' ELSE 'second' END AS source,
             CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) / 250000 AS rate
           FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
             JOIN {region} r ON n.n_regionkey = r.r_regionkey
           WHERE r.r_regionkey > 0 AND day(o.o_orderdate) % 10 > 0 AND month(o.o_orderdate) <> 6
           GROUP BY r.r_name, CAST(o.o_orderdate AS DATE), CASE WHEN o.o_orderpriority < '3' THEN 'first' ELSE 'second' END""",
    ),
    "currency_of": (
        (),
        """SELECT n.n_nationkey AS entity, CASE WHEN r.r_regionkey = 0 THEN 'USD' ELSE r.r_name END AS ccy
           FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    ),
    "fundamentals": (
        (),
        """SELECT c.c_nationkey AS entity, CAST(CONCAT(CAST(y.yr AS VARCHAR(4)), '-01-15') AS DATE) AS as_of_date,
             CAST(SUM(CASE WHEN c.c_custkey % 7 <= y.yr - 1995 THEN 1 ELSE 0 END) * 1000 AS DOUBLE) AS shares
           FROM {customer} c CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS yr FROM {orders}) y
           GROUP BY c.c_nationkey, y.yr""",
    ),
    "membership_event": (
        (),
        """SELECT event_id, CONCAT('F', CAST(user_id % 40 AS VARCHAR(8))) AS figi, CAST(ts AS DATE) AS effective_date,
             CASE event_type WHEN 'signup' THEN 'join' ELSE 'leave' END AS change,
             CONCAT('raw', CAST(user_id AS VARCHAR(12))) AS raw_identifier,
             CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS universe_id
           FROM {events} WHERE event_type IN ('signup', 'error')""",
    ),
    "curve_point": (
        (),
        """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of_date, CAST(l_linenumber AS DOUBLE) AS tenor,
             CAST(SUM(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS nominal,
             CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS real_rate
           FROM {lineitem} GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE), l_linenumber""",
    ),
    "rate_point": (
        (),
        """SELECT country, curve_set, basis, rate_type, as_of_date, tenor, CASE WHEN rate_type = 'forward' THEN nominal * 1.1 WHEN curve_set = 'ois' THEN nominal - real_rate / 10 WHEN basis = 'real' THEN real_rate ELSE nominal END AS value
           FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'GB' WHEN 'N' THEN 'US' ELSE 'BR' END AS country, CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of_date,
               CAST(CASE l_linenumber WHEN 3 THEN 5 WHEN 4 THEN 10 WHEN 5 THEN 30 WHEN 6 THEN 9 WHEN 7 THEN 12 ELSE l_linenumber END AS DOUBLE) AS tenor,
               CAST(SUM(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS nominal, CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS real_rate
             FROM {lineitem} GROUP BY 1, 2, 3) p
           CROSS JOIN (SELECT 'glc' AS curve_set, 'nominal' AS basis, 'spot' AS rate_type, 'GBUSBR' AS whose UNION ALL SELECT 'glc', 'nominal', 'forward', 'GBUSBR' UNION ALL SELECT 'glc', 'real', 'spot', 'GBBR' UNION ALL SELECT 'ois', 'nominal', 'spot', 'GB') s
           WHERE s.whose LIKE CONCAT('%', p.country, '%')""",
    ),
    "observation": (
        (),
        """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date,
             CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
           FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)""",
    ),
    "attention": (
        (),
        """SELECT user_id % 25 AS entity, CAST(ts AS DATE) AS obs_date, CAST(COUNT(*) AS DOUBLE) AS value
           FROM {events} WHERE (user_id + day(ts)) % 9 <> 0 GROUP BY user_id % 25, CAST(ts AS DATE)""",
    ),
    "portfolio_weight": (
        (),
        """SELECT portfolio_id, as_of_date, entity, v / SUM(v) OVER (PARTITION BY portfolio_id, as_of_date) AS weight FROM (
             SELECT o.o_orderpriority AS portfolio_id, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS as_of_date,
               c.c_nationkey AS entity, ROUND(CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 100000) AS v
             FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
             GROUP BY o.o_orderpriority, CAST(date_trunc('quarter', o.o_orderdate) AS DATE), c.c_nationkey) x WHERE v > 0""",
    ),
    "label": (
        (),
        """SELECT entity, quarter_start, label FROM (
             SELECT entity, quarter_start, label, ROW_NUMBER() OVER (PARTITION BY entity, quarter_start ORDER BY n DESC, label) AS nth FROM (
               SELECT c.c_nationkey AS entity, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS quarter_start,
                 o.o_orderpriority AS label, COUNT(*) AS n
               FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
               GROUP BY c.c_nationkey, CAST(date_trunc('quarter', o.o_orderdate) AS DATE), o.o_orderpriority) x) y WHERE nth = 1""",
    ),
}


def _needed(names) -> list[str]:
    out: list[str] = []

    def add(name: str):
        for before in FRAMES[name][0]:
            add(before)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def with_frames(names, query: str, base=lambda t: t) -> str:
    parts = [f"{n} AS ({FRAMES[n][1].format(**{t: base(t) for t in BASE})})" for n in _needed(names)]
    return f"WITH {'RECURSIVE ' if 'fold AS' in query else ''}{', '.join(parts)} {query}"


_STORED: dict = {}


def _folder(spark: SparkSession) -> str | None:
    """Where frames are written: spark.checkpoint.dir, or a temporary folder in a local session; else nowhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return None
    key = (spark.sparkContext.applicationId, "folder")
    if key not in _STORED:
        _STORED[key] = tempfile.mkdtemp(prefix="quantloom-frames-")
        atexit.register(shutil.rmtree, _STORED[key], ignore_errors=True)
    return f"file://{_STORED[key]}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A frame. It stands for a stored table, and is one: written as Parquet when an application first asks for
    it, and read from there by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        before, text = FRAMES[name]
        text = text.format(**{t: "{" + t + "}" for t in BASE})
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in text}
        used |= {f"f_{b}": frame(spark, sf_dir, b) for b in before}
        for b in before:
            text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{f_{b}}}", text)
        rows, folder = spark.sql(text, **used), _folder(spark)
        if folder is None:
            return rows
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        _STORED[key] = (path, rows.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def store_all(spark: SparkSession, sf_dir: str) -> None:
    for name in FRAMES:
        frame(spark, sf_dir, name)


def oracle(names, query: str) -> str:
    """SQL for DuckDB: the frames, then the query; one that begins with a comma adds CTEs of its own."""
    return with_frames(names.split(), query)
