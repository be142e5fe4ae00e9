import datetime as dt
import random
import time

from pyspark.sql import functions as F

from quantloom.sources import parsers as P
from quantloom.streaming import bands as S

D = dt.date.fromisoformat


def text(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string")


def test_sdmx(spark):
    csv = 'KEY,"TIME_PERIOD",REF_AREA,OBS_VALUE\na,2023,US,1.5\nb,2023-04,US,x\nc,2023-05,DE,2\nshort,row\nd,2023-06,US,3\r\ne,bad,US,4\nf,2023-07,US,NaN\n'
    got = [tuple(r) for r in P.sdmx_csv(text(spark, csv), ref_area="US").collect()]
    assert got == [(D("2023-12-31"), 1.5, "US"), (D("2023-06-01"), 3.0, "US")]
    assert P.sdmx_csv(text(spark, "", None)).count() == 0


def test_atom(spark):
    xml = "<feed><entry><d:NEW_DATE m:type='x'>2024-01-02T00:00:00</d:NEW_DATE><d:BC_1YEAR>4.8</d:BC_1YEAR><d:BC_2YEAR></d:BC_2YEAR></entry><entry><d:NEW_DATE>2024-01-03</d:NEW_DATE><d:BC_2YEAR>4.3</d:BC_2YEAR></entry></feed>"
    got = sorted(tuple(r) for r in P.atom_curve(text(spark, xml), {"BC_1YEAR": 1, "BC_2YEAR": 2}).collect())
    assert got == [(D("2024-01-02"), 1.0, 4.8), (D("2024-01-03"), 2.0, 4.3)]


def test_json_pages(spark):
    pages = ('{"data": [{"d": "2024-01-01", "v": "1"}], "meta": {"total-pages": 2}}', '{"data": [{"d": "2024-01-02", "v": "2"}], "meta": {"total-pages": 2}}')
    assert sorted(map(tuple, P.json_pages(text(spark, *pages), "d: string, v: string").collect())) == [(2, "2024-01-01", "1"), (2, "2024-01-02", "2")]


def test_wide_csv(spark):
    got = sorted(map(tuple, P.wide_csv(text(spark, "date;R01XX;R10,5\n2024-01-02;2,5;.\n2024-01-03;;3,25\nnote;1;2\n")).collect()))
    assert got == [(D("2024-01-02"), 1.0, 2.5), (D("2024-01-03"), 10.5, 3.25)]


HTML = "<table><tr><th>Symbol<sup>1</sup><th>Name</tr><tr><td>BRK.B<td>Berk&amp;shire<br>Inc</table><table><tr><th>Ticker</th></tr></table><p>no</p><table><tr><td>x<table><tr><td>inner</td></tr></table>y</td></tr></table>"


def test_html_tables(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>none</p>")], "page long, html string")
    pages.createOrReplaceTempView("html_pages")
    spark.udtf.register("html_tables", P.html_tables(spark))
    got = sorted(tuple(r) for r in spark.sql("select page, t.table_no, t.row_no, t.cells from html_pages, lateral html_tables(html) t").collect())
    assert got[:2] == [(1, 0, 0, ["Symbol", "Name"]), (1, 0, 1, ["BRK.B", "Berk&shire Inc"])]
    assert (1, 3, 0, ["inner"]) in got and all(r[0] == 1 for r in got)
    assert P.constituents(HTML) == [{"Symbol": "BRK.B", "Name": "Berk&shire Inc"}]


def run(query):
    query.processAllAvailable()
    query.stop()


def test_streaming_band_and_vintages(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "key string, at timestamp, value double"
    at = lambda d: dt.datetime(2024, 1, d)
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("a", at(1), 100.0), ("a", at(2), 130.0), ("b", at(1), 5.0)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    start = lambda: S.banded(stream, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    run(start())
    time.sleep(1)
    write([("a", at(3), 250.0), ("a", at(4), 140.0)])
    run(start())  # goes on from its checkpoint
    got = {(r.key, r.at.day): r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("b", 1): True, ("a", 3): False, ("a", 4): True}
    path = str(tmp_path / "v")
    sink = S.vintage_sink(path, ["key"])
    batch = lambda *rows: spark.createDataFrame([(k, v, at(d)) for k, v, d in rows], "key string, value double, arrived timestamp")
    sink(batch(("a", 1.0, 1), ("b", 2.0, 1)), 0)
    for _ in range(2):  # a batch that runs again changes nothing
        sink(batch(("a", 3.0, 2), ("a", 2.0, 1), ("c", 4.0, 2)), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/batch=1").select("key", "value", "first_value").collect())) == [("a", 3.0, 1.0), ("b", 2.0, 2.0), ("c", 4.0, 4.0)]


def test_event_time_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(t(1), "x"), (t(2), "x"), (t(14), "y"), (t(50), "x")], "ts timestamp, kind string").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    run(S.counts(stream, "ts", ["kind"], "10 minutes", "5 minutes").writeStream.format("memory").queryName("counted").outputMode("append").start())
    assert sorted((r.start.minute, r.kind, r.n) for r in spark.table("counted").collect()) == [(0, "x", 2), (10, "y", 1)]
    run(S.sessions(stream, "ts", ["kind"], "5 minutes", "1 minutes").writeStream.format("memory").queryName("sess").outputMode("append").start())
    assert {(r.kind, r.n) for r in spark.table("sess").collect()} == {("x", 2), ("y", 1)}


def test_streams_with_state(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(60)]
    rng = random.Random(3)
    values = {k: [round(rng.uniform(1, 9), 2) for _ in days] for k in "ab"}
    src = str(tmp_path / "in")
    for n in range(3):
        rows = [(k, days[i], values[k][i]) for k in "ab" for i in range(20 * n, 20 * n + 20)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "key string, at date, value double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, at date, value double").option("maxFilesPerTrigger", 1).parquet(src)

    def run(writer):
        q = writer.start()
        q.processAllAvailable()
        q.stop()

    run(S.extremes(stream, 7).writeStream.format("memory").queryName("extremes"))
    got = {(r.key, r.at): (r.high, r.low) for r in spark.table("extremes").collect()}
    for k in "ab":
        for i, d in enumerate(days):
            window = values[k][max(0, i - 7) : i + 1]
            assert got[k, d] == (max(window), min(window))
    run(stream.writeStream.foreachBatch(S.fill_sink(str(tmp_path / "fill"), "key", "at")).option("checkpointLocation", str(tmp_path / "cp1")))
    assert spark.read.parquet(str(tmp_path / "fill")).count() == 120
    write = S.fill_sink(str(tmp_path / "fill"), "key", "at")
    again = spark.createDataFrame([("a", days[3], 0.0), ("a", days[-1] + dt.timedelta(1), 5.0), ("c", days[0], 1.0)], "key string, at date, value double")
    for _ in range(2):  # a batch that runs again replaces itself
        write(again, 9)
    assert spark.read.parquet(str(tmp_path / "fill")).count() == 122


def test_membership_stream(spark, tmp_path):
    rng, src = random.Random(4), str(tmp_path / "in")
    events = [(f"F{rng.randint(1, 4)}", dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 40)), rng.choice(["join", "leave"]), n) for n in range(150)]
    events.sort(key=lambda e: e[1])
    cuts = [0, 50, 100, 150]
    for a, b in zip(cuts, cuts[1:]):
        while 0 < a < 150 and events[a - 1][1] == events[a][1]:
            a += 1
        while b < 150 and events[b - 1][1] == events[b][1]:
            b += 1
        spark.createDataFrame(events[a:b], "key string, at date, change string, n long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, at date, change string, n long").option("maxFilesPerTrigger", 1).parquet(src)
    q = S.memberships(stream).writeStream.format("memory").queryName("members").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("members").collect())
    want, since = [], {}
    for key, at, change, _ in sorted(events, key=lambda e: (e[1], e[2] != "leave", e[3])):
        if change == "join":
            since.setdefault(key, at)
        elif key in since:
            if since[key] < at:
                want.append((key, since[key], at))
            del since[key]
    assert got == sorted(want)


def test_sdmx_csv_keeps_quoted_commas_and_texts_without_areas(spark):
    texts = spark.createDataFrame([('REF_AREA,TITLE,TIME_PERIOD,OBS_VALUE\r\nUS,"Rate, ten ""y""",2024-01,1.5\r\nFR,x,2024-02,2\nUS,short\nUS,x,2024-03,\n',), ("TIME_PERIOD,OBS_VALUE\n2024-05,7\n",)], "text string")
    got = {(str(r.obs_date), r.value) for r in P.sdmx_csv(texts, ref_area="US").collect()}
    assert got == {("2024-01-01", 1.5), ("2024-05-01", 7.0)}


def test_changes_seeds_and_errors(spark):
    html = "<table><tr><th>Date<th colspan=2>Added<th colspan=2>Removed<th>Reason<tr><th><th>Ticker<th>Security<th>Ticker<th>Security<th><tr><td>March 3, 2020<td>AAA<td>A Co<td>BBB<td>B Co<td>x<tr><td>May 1, 2021<td><td><td>CCC</table><table><tr><th>Symbol<tr><td>D</table>"
    assert P.constituent_changes(html) == [("March 3, 2020", "join", "AAA"), ("March 3, 2020", "leave", "BBB"), ("May 1, 2021", "leave", "CCC")]
    entries = P.seeds('[[universe]]\nid = "a"\nkind = "index"\n[[universe]]\nid = "b"\n', "universe")
    assert [tuple(r) for r in P.roster(spark, entries, ["id", "kind"]).collect()] == [("a", "index"), ("b", None)]
    bad = spark.createDataFrame([('{"error_code": " 100", "error_message": "none"}',), ('{"error_code": "0", "indexes": {"INDEX_LEVELS": [{"calc_date": 20200102, "level_eod": 1.5}, {"calc_date": 7, "level_eod": 2}, {"calc_date": 20200103, "level_eod": -1}]}}',)], "text string")
    assert [tuple(r) for r in P.index_graph_errors(bad).collect()] == [(" 100", "none")]
    assert [(str(r.session_date), r.level) for r in P.index_graph(bad).collect()] == [("2020-01-02", 1.5)]
