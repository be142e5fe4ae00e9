"""Queries on universes, interval tables and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import scd as S
from ..operators import universe as U
from . import market
from .market import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = market.registry(QUERIES, ORACLE)

#: joins and leaves as islands: on one day leaves come first, then the last state of the day holds
INTERVALS = """
, d AS (SELECT universe_id, figi, effective_date, max(CASE WHEN change = 'join' THEN 1 ELSE 0 END) AS on_,
    max_by(raw_identifier, event_id) FILTER (change = 'join') AS raw FROM membership_event GROUP BY ALL),
s AS (SELECT *, lag(on_, 1, 0) OVER w AS was FROM d WINDOW w AS (PARTITION BY universe_id, figi ORDER BY effective_date)),
g AS (SELECT *, sum(CASE WHEN on_ = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY universe_id, figi ORDER BY effective_date) AS island FROM s),
iv AS (SELECT universe_id, figi, min(effective_date) AS valid_from, max(CASE WHEN on_ = 0 THEN effective_date END) AS valid_to, max_by(raw, effective_date) FILTER (on_ = 1) AS raw_identifier
  FROM g WHERE island > 0 AND (on_ = 1 OR was = 1) GROUP BY universe_id, figi, island)"""


def _events(events):
    return events.withColumn("reverses", F.lit(None).cast("string"))


@query("membership_intervals", "membership_event", INTERVALS + " SELECT universe_id, figi, raw_identifier, valid_from, valid_to FROM iv")
def membership_intervals(events):
    return U.intervals(_events(events))


@query("membership_pinned", "membership_event", INTERVALS.replace("FROM membership_event GROUP", "FROM membership_event WHERE event_id <= 4000 GROUP") + " SELECT universe_id, figi, valid_from, valid_to FROM iv")
def membership_pinned(events):
    return U.pinned(_events(events), 4000).drop("raw_identifier")


CORRECTED = """
, k AS (SELECT *, concat_ws('|', raw_identifier, change, CAST(effective_date AS VARCHAR)) AS key FROM membership_event),
n AS (SELECT *, row_number() OVER (PARTITION BY universe_id, key ORDER BY event_id) AS nth FROM k),
voided AS (SELECT universe_id, key, row_number() OVER (PARTITION BY universe_id, key ORDER BY event_id) AS nth FROM k WHERE event_id % 35 = 0),
corrected AS (SELECT n.* FROM n ANTI JOIN voided v ON v.universe_id = n.universe_id AND v.key = n.key AND v.nth = n.nth)"""


@query("membership_corrected", "membership_event", CORRECTED + INTERVALS.replace("FROM membership_event GROUP", "FROM corrected GROUP") + " SELECT universe_id, figi, raw_identifier, valid_from, valid_to FROM iv")
def membership_corrected(events):
    fixes = events.where("event_id % 35 = 0").select(
        (F.col("event_id") + 1_000_000).alias("event_id"), "figi", "effective_date", F.lit("correct").alias("change"), "raw_identifier", "universe_id",
        F.concat_ws("|", "raw_identifier", "change", F.col("effective_date").cast("string")).alias("reverses"),
    )
    return U.intervals(_events(events).unionByName(fixes))


_AT = "SELECT figi FROM iv WHERE universe_id = '{}' AND valid_from <= DATE '2024-01-20' AND (valid_to IS NULL OR valid_to > DATE '2024-01-20')"
for _name, _sql, _f in (("overlap", "INTERSECT", U.overlap), ("minus", "EXCEPT", U.minus), ("union", "UNION", U.union)):

    @query(f"members_{_name}", "membership_event", INTERVALS + f" {_AT.format('even')} {_sql} {_AT.format('odd')}")
    def members_of(events, f=_f):
        iv = U.intervals(_events(events))
        return f(U.of(iv, "even", "2024-01-20"), U.of(iv, "odd", "2024-01-20"))


@query("snapshot_diff", "membership_event", INTERVALS + f", a AS ({_AT.format('even')}), b AS ({_AT.format('even').replace('01-20', '01-25')}) SELECT figi, 'join' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT figi, 'leave' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def snapshot_diff(events):
    iv = U.intervals(_events(events))
    return U.snapshot_diff(U.of(iv, "even", "2024-01-20"), U.of(iv, "even", "2024-01-25"))


@query(
    "revision_diff",
    "attention",
    """, d AS (SELECT obs_date AS as_of_date, row_number() OVER (ORDER BY obs_date) AS i FROM (SELECT DISTINCT obs_date FROM attention)), r AS (SELECT a.entity, d.* FROM attention a JOIN d ON a.obs_date = d.as_of_date)
    SELECT r.as_of_date, r.entity, 'join' AS change FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.entity = r.entity AND q.i = r.i - 1)
    UNION ALL SELECT n.as_of_date, r.entity, 'leave' FROM r JOIN d n ON n.i = r.i + 1 WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.entity = r.entity AND q.i = r.i + 1)""",
)
def revision_diff(attention):
    return U.revision_diff(attention.withColumnRenamed("obs_date", "as_of_date"), "entity")


@query(
    "members_jaccard",
    "membership_event",
    INTERVALS
    + """, t(as_of_date) AS (VALUES (DATE '2024-01-10'), (DATE '2024-01-20')), m AS (SELECT t.as_of_date, iv.universe_id, iv.figi FROM iv JOIN t ON iv.valid_from <= t.as_of_date AND (iv.valid_to IS NULL OR iv.valid_to > t.as_of_date)),
    x AS (SELECT coalesce(a.as_of_date, b.as_of_date) AS as_of_date, a.figi AS a, b.figi AS b FROM (SELECT * FROM m WHERE universe_id = 'even') a FULL JOIN (SELECT * FROM m WHERE universe_id = 'odd') b ON a.as_of_date = b.as_of_date AND a.figi = b.figi)
    SELECT as_of_date, count(a) AS n_ours, count(b) AS n_theirs, count(a || b) AS n_both, round(count(a || b) / count(*), 6) AS similarity FROM x GROUP BY as_of_date""",
)
def members_jaccard(events):
    iv = U.intervals(_events(events))
    days = iv.sparkSession.sql("select explode(array(date'2024-01-10', date'2024-01-20')) as as_of_date")
    m = iv.join(F.broadcast(days), (F.col("valid_from") <= F.col("as_of_date")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("as_of_date"))))
    out = U.jaccard(m.where("universe_id = 'even'"), m.where("universe_id = 'odd'"), ["as_of_date"], "figi")
    return rounded(out.drop("distance"))


@query(
    "membership_proposals",
    "membership_event",
    """, s AS (SELECT universe_id, figi, change, min(effective_date) AS first_seen, max(effective_date) AS last_seen, count(DISTINCT raw_identifier) AS n_sources FROM membership_event WHERE effective_date <= DATE '2024-01-15' GROUP BY ALL),
    n AS (SELECT *, count(*) OVER (PARTITION BY universe_id) AS n_changes FROM s),
    r AS (SELECT *, CASE WHEN change = 'leave' AND figi IN ('F1', 'F2', 'F3') THEN 'cooldown' WHEN universe_id = 'odd' AND n_changes > 0.1 * 40 THEN 'churn' WHEN datediff('day', first_seen, last_seen) < 2 THEN 'persistence' WHEN n_sources < 2 THEN 'corroboration' END AS reason FROM n)
    SELECT universe_id, figi, change, first_seen, reason, reason IS NULL AS promotable FROM r""",
)
def membership_proposals(events):
    spark = events.sparkSession
    sightings = events.select("universe_id", "figi", "change", F.col("effective_date").alias("seen_on"), F.col("raw_identifier").alias("source"))
    sizes = spark.createDataFrame([("even", 4000), ("odd", 40)], "universe_id string, n_members int")
    rejected = spark.sql("select explode(array('F1', 'F2', 'F3')) as figi").crossJoin(F.broadcast(sizes.select("universe_id"))).select("universe_id", "figi", F.lit("leave").alias("change"), F.lit("2024-01-01").cast("date").alias("rejected_on"))
    return U.proposals(sightings, sizes, "2024-01-15", rejected).select("universe_id", "figi", "change", "first_seen", "reason", "promotable")


SCD = """, c AS (SELECT *, lag(label) OVER w AS p FROM label WINDOW w AS (PARTITION BY entity ORDER BY quarter_start)),
h AS (SELECT entity, label, quarter_start AS valid_from, lead(quarter_start) OVER (PARTITION BY entity ORDER BY quarter_start) AS valid_to FROM c WHERE p IS DISTINCT FROM label)"""


@query("scd_history", "label", SCD + " SELECT * FROM h")
def scd_history(label):
    return S.from_history(label, "entity", "quarter_start", "label")


@query("scd_current", "label", SCD + " SELECT entity, label, valid_from FROM h WHERE valid_to IS NULL")
def scd_current(label):
    return S.current_or_latest(S.from_history(label, "entity", "quarter_start", "label"), "entity").drop("valid_to")


@query("scd_overlaps", "label", SCD + ", o AS (SELECT entity, label, valid_from, CASE WHEN entity % 4 = 0 THEN valid_to + 40 ELSE valid_to END AS valid_to FROM h) SELECT DISTINCT b.entity, b.label, b.valid_from FROM o a JOIN o b ON a.entity = b.entity AND a.valid_from < b.valid_from AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')")
def scd_overlaps(label):
    rows = S.from_history(label, "entity", "quarter_start", "label")
    rows = rows.withColumn("valid_to", F.when(F.col("entity") % 4 == 0, F.date_add("valid_to", 40)).otherwise(F.col("valid_to")))
    return S.overlaps(rows, ["entity"]).drop("valid_to")


def _opinions(label):
    """What another source says on the open rows, by rule: the same, later, on the same day, or earlier."""
    rows = S.from_history(label, "entity", "quarter_start", "label").withColumn("source", F.when(F.col("entity") % 2 == 0, "b").otherwise("c"))
    now = rows.where("valid_to is null")
    k = F.col("entity") % 5
    new = now.select("entity", F.when(k == 0, F.col("label")).otherwise("1-URGENT").alias("label"), F.when(F.col("entity") % 3 == 0, "a").otherwise("c").alias("source"), F.date_add("valid_from", (k - 2).cast("int")).alias("valid_from"))
    return rows, new


_DECIDE = SCD + """, t AS (SELECT *, CASE WHEN entity % 2 = 0 THEN 'b' ELSE 'c' END AS source FROM h),
n AS (SELECT entity, label, source, valid_from, CASE WHEN entity % 5 = 0 THEN label ELSE '1-URGENT' END AS new_label, CASE WHEN entity % 3 = 0 THEN 'a' ELSE 'c' END AS new_source, CAST(valid_from + CAST(entity % 5 - 2 AS INTEGER) AS DATE) AS new_from FROM t WHERE valid_to IS NULL),
a AS (SELECT *, CASE WHEN new_label = label AND new_source < source THEN 'upgrade' WHEN new_label = label THEN 'unchanged' WHEN new_source > source THEN 'refused_outranked'
  WHEN new_from < valid_from THEN 'refused_backdated' WHEN new_from = valid_from THEN 'update' ELSE 'close_insert' END AS action FROM n)"""


@query("scd_decisions", "label", _DECIDE + " SELECT entity, new_label AS new_value, new_source, new_from, action FROM a")
def scd_decisions(label):
    rows, new = _opinions(label)
    return S.apply(rows, new, ["entity"], "label", lambda s: F.ascii(s)).select("entity", "new_value", "new_source", "new_from", "action")


@query(
    "scd_applied",
    "label",
    _DECIDE
    + """ SELECT t.entity, CASE WHEN t.valid_to IS NULL AND a.action = 'update' THEN a.new_label ELSE t.label END AS label, CASE WHEN t.valid_to IS NULL AND a.action IN ('update', 'upgrade') THEN a.new_source ELSE t.source END AS source,
      t.valid_from, CASE WHEN t.valid_to IS NULL AND a.action = 'close_insert' THEN a.new_from ELSE t.valid_to END AS valid_to FROM t LEFT JOIN a USING (entity)
    UNION ALL SELECT entity, new_label, new_source, new_from, NULL FROM a WHERE action = 'close_insert'""",
)
def scd_applied(label):
    rows, new = _opinions(label)
    return S.applied(rows, S.apply(rows, new, ["entity"], "label", lambda s: F.ascii(s)), ["entity"], "label")


@query(
    "dirty_merge",
    "closes",
    """, o AS (SELECT entity, session_date, close FROM closes WHERE (entity + day(session_date)) % 11 <> 0), n AS (SELECT entity, session_date, CASE WHEN day(session_date) = 7 THEN close + 1 ELSE close END AS close FROM closes WHERE (entity + day(session_date)) % 13 <> 0)
    SELECT entity, session_date, CASE WHEN o.close IS NULL THEN 'insert' WHEN n.close IS NULL THEN CASE WHEN entity % 2 = 0 THEN 'delete' ELSE 'keep' END WHEN o.close = n.close THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n USING (entity, session_date)""",
)
def dirty_merge(closes):
    mark = F.col("entity") + F.day("session_date")
    old = closes.where(mark % 11 != 0)
    new = closes.where(mark % 13 != 0).withColumn("close", F.when(F.day("session_date") == 7, F.col("close") + 1).otherwise(F.col("close")))
    return M.dirty(old, new, ["entity", "session_date"], ["close"], closes.where("entity % 2 = 0").select("entity").distinct())


@query(
    "vintage_upsert",
    "observation",
    """, o AS (SELECT * FROM observation WHERE day(obs_date) <= 20), n AS (SELECT series_id, obs_date, CASE WHEN day(obs_date) = 15 THEN value * 2 ELSE value END AS value FROM observation WHERE day(obs_date) >= 10)
    SELECT series_id, obs_date, round(coalesce(n.value, o.value), 2) AS value, round(coalesce(o.value, n.value), 2) AS first_value, CASE WHEN o.value IS NULL THEN 'inserted' WHEN n.value IS NULL THEN 'kept' WHEN o.value = n.value THEN 'unchanged' ELSE 'restated' END AS action
    FROM o FULL JOIN n USING (series_id, obs_date)""",
)
def vintage_upsert(observation):
    day = F.day("obs_date")
    old = observation.where(day <= 20).withColumn("first_value", F.col("value"))
    new = observation.where(day >= 10).withColumn("value", F.when(day == 15, F.col("value") * 2).otherwise(F.col("value")))
    return rounded(M.vintages(old, new, ["series_id", "obs_date"]), 2)


@query("immutable_insert", "observation", "SELECT series_id, obs_date, round(CASE WHEN day(obs_date) <= 20 THEN value ELSE -value END, 2) AS value FROM observation")
def immutable_insert(observation):
    out = M.insert_new(observation.where(F.day("obs_date") <= 20), observation.withColumn("value", -F.col("value")), ["series_id", "obs_date"])
    return rounded(out, 2)


@query("overwrite_span", "observation", "SELECT series_id, obs_date, round(value, 2) AS value FROM observation WHERE series_id = '5-LOW' OR NOT obs_date BETWEEN (SELECT min(obs_date) FROM observation o WHERE o.series_id = observation.series_id AND year(o.obs_date) = 1998 AND day(o.obs_date) > 3) AND (SELECT max(obs_date) FROM observation o WHERE o.series_id = observation.series_id AND year(o.obs_date) = 1998 AND day(o.obs_date) > 3) UNION ALL SELECT series_id, obs_date, 1 FROM observation WHERE series_id <> '5-LOW' AND year(obs_date) = 1998 AND day(obs_date) > 3")
def overwrite_span(observation):
    fresh = observation.where((F.year("obs_date") == 1998) & (F.day("obs_date") > 3) & (F.col("series_id") != "5-LOW")).withColumn("value", F.lit(1.0))
    return rounded(M.overwrite_span(observation, fresh, ["series_id"], "obs_date"), 2)
