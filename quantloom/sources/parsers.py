"""Vendor texts as rows: delimited statistics, Atom, paged JSON, wide tables, HTML tables. Nothing is fetched."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, period_date


def csv_cells(line: Column) -> Column:
    """The cells of a line: in quotes a cell may hold commas, and doubled quotes for one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*+"(?:[^"]++|"")*+"[^,]*+|[^,]*+)'), F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_extract(c, r'(?s)^\s*"(.*)"\s*$', 1), '""', '"')
    return F.transform(raw, lambda c: F.when(c.rlike(r'^\s*"'), bare(c)).otherwise(F.trim(c)))


def sdmx_csv(texts: DataFrame, text: str = "text", ref_area: str | None = None) -> DataFrame:
    """SDMX-CSV texts -> (obs_date, value, ref_area): columns are found by their header's names; rows that are
    garbled, of another area, or without a finite value are skipped. A text without a column of areas is all of
    the area that is asked for. Cells hold no line breaks."""
    lines = texts.select(F.split(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r", ""), "\n").alias("l"))
    head = F.transform(csv_cells(F.get("l", F.lit(0))), lambda c: F.upper(F.trim(c)))
    rows = lines.select(head.alias("h"), F.explode(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1)))).alias("line"))
    rows = rows.withColumn("c", csv_cells(F.col("line"))).where(F.size("c") == F.size("h"))
    cell = lambda name: F.get("c", F.array_position("h", name).cast("int") - 1)
    has_area = F.array_contains("h", "REF_AREA")
    out = rows.select(period_date(cell("TIME_PERIOD")).alias("obs_date"), cell("OBS_VALUE").try_cast("double").alias("value"), cell("REF_AREA").alias("ref_area"), has_area.alias("has_area"))
    out = out.where(F.col("obs_date").isNotNull() & finite(F.col("value")))
    out = out if ref_area is None else out.where(~F.col("has_area") | (F.col("ref_area") == ref_area))
    return out.drop("has_area")


def atom_curve(texts: DataFrame, tenors: dict[str, float], date_tag: str = "NEW_DATE", text: str = "text") -> DataFrame:
    """Atom entries with a date and a tag for each tenor -> (as_of_date, tenor, value); blanks are skipped."""
    entry = F.explode(F.regexp_extract_all(F.regexp_replace(text, r"<(/?)(?:\w+:)", "<$1"), F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1)))
    tag = lambda name: F.regexp_extract("e", rf"(?s)<{name}\b[^>]*>([^<]*)</{name}>", 1)
    points = F.array(*(F.struct(F.lit(float(t)).alias("tenor"), tag(name).try_cast("double").alias("value")) for name, t in tenors.items()))
    rows = texts.select(entry.alias("e")).select(F.try_to_date(F.substring(tag(date_tag), 1, 10)).alias("as_of_date"), F.explode(points).alias("p"))
    return rows.select("as_of_date", "p.tenor", "p.value").where("as_of_date is not null and value is not null")


def json_pages(pages: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """{"data": [rows], "meta": {"total-pages": n}} texts -> the rows, with the pages that are due and there."""
    kind = f"struct<data: array<struct<{schema}>>, meta: struct<`total-pages`: int>>"
    rows = pages.select(F.from_json(text, kind).alias("j"))
    return rows.select(F.col("j.meta")["total-pages"].alias("total_pages"), F.explode("j.data").alias("r")).select("total_pages", "r.*")


def wide_csv(texts: DataFrame, text: str = "text", separator: str = ";") -> DataFrame:
    """A date column and one for each tenor, decimal commas, a full stop for missing -> (as_of_date, tenor, value)."""
    lines = texts.select(F.split(F.regexp_replace(text, "\r", ""), "\n").alias("l"))
    head = F.split(F.get("l", F.lit(0)), separator)
    rows = lines.select(head.alias("h"), F.explode(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1)))).alias("line")).withColumn("c", F.split("line", separator))
    rows = rows.select(F.try_to_date(F.get("c", F.lit(0))).alias("as_of_date"), "h", F.posexplode("c").alias("i", "v")).where("i > 0")
    tenor = F.regexp_extract(F.get("h", F.col("i")), r"(\d+(?:[.,]\d+)?)", 1)
    number = lambda c: F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    out = rows.select("as_of_date", number(tenor).alias("tenor"), F.when(F.trim("v") != ".", number(F.col("v"))).alias("value"))
    return out.where("as_of_date is not null and tenor is not null and value is not null")


def index_graph(payloads: DataFrame, text: str = "text") -> DataFrame:
    """{"indexes": {"INDEX_LEVELS": [{"calc_date": 20200102, "level_eod": 1.5}]}} texts -> (session_date, level);
    levels of zero or less, and texts with an error code, give no rows; the codes are in index_graph_errors()."""
    levels = "indexes struct<INDEX_LEVELS: array<struct<calc_date: string, level_eod: string>>>, error_code string"
    rows = payloads.select(F.from_json(text, levels).alias("j")).where(F.trim(F.coalesce("j.error_code", F.lit("0"))).isin("", "0"))
    rows = rows.select(F.explode("j.indexes.INDEX_LEVELS").alias("r"))
    out = rows.select(F.try_to_date("r.calc_date", "yyyyMMdd").alias("session_date"), F.col("r.level_eod").try_cast("double").alias("level"))
    return out.where("session_date is not null and level > 0")


def index_graph_errors(payloads: DataFrame, text: str = "text") -> DataFrame:
    """(error_code, error_message) of the texts that say so."""
    rows = payloads.select(F.from_json(text, "error_code string, error_message string").alias("j")).select("j.*")
    return rows.where(~F.trim(F.coalesce("error_code", F.lit("0"))).isin("", "0"))


def index_sheet(texts: DataFrame, text: str = "text") -> DataFrame:
    """Exports with a preamble, a header that names the date, and notes at the end, as CSV -> (session_date, level):
    the first other cell that is a positive number, with thousands in commas or, before a decimal comma, in points."""
    lines = texts.select(F.split(F.regexp_replace(text, "\r", ""), "\n").alias("l"))
    cells = F.transform("l", csv_cells)
    is_date = lambda c: F.lower(F.trim(c)).isin("date", "as of date", "asofdate")
    heads = F.transform("c", lambda row: F.exists(row, is_date))
    rows = lines.select(cells.alias("c")).withColumn("at", F.array_position(heads, True).cast("int")).where("at > 0")
    place = F.array_position(F.transform(F.get("c", F.col("at") - 1), is_date), True).cast("int")
    rows = rows.select(place.alias("place"), F.explode(F.slice("c", F.col("at") + 1, F.size("c"))).alias("c"))
    day = F.regexp_extract(F.get("c", F.col("place") - 1), r"^\s*(\S+(?: [A-Za-z]{3,9},? \d{4})?)", 1)
    day = F.coalesce(*(F.try_to_date(day, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd MMM yyyy", "dd-MMM-yyyy")))
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    number = lambda c: F.when(bare(c).rlike(r"^\d{1,3}(\.\d{3})*,\d+$"), F.translate(F.translate(bare(c), ".", ""), ",", ".")).otherwise(F.translate(bare(c), ",", "")).try_cast("double")
    others = F.transform("c", lambda c, i: F.when(i != F.col("place") - 1, number(c)))
    out = rows.select(day.alias("session_date"), F.get(F.filter(others, lambda v: v > 0), 0).alias("level"))
    return out.where("session_date is not null and level is not null")


class _Tables(HTMLParser):
    """The cells of every table, nested ones apart, with white space made one blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None, "skip": 0})
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t["rows"].append([])
                t["cell"] = None
            elif tag in ("td", "th"):
                if not t["rows"]:
                    t["rows"].append([])
                t["rows"][-1].append("")
                t["cell"] = len(t["rows"][-1]) - 1
            elif tag in ("sup", "style", "script"):
                t["skip"] += 1
            elif tag == "br" and t["cell"] is not None:
                t["rows"][-1][t["cell"]] += " "

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "th", "tr"):
            t["cell"] = None
        elif tag in ("sup", "style", "script"):
            t["skip"] = max(0, t["skip"] - 1)

    def handle_data(self, data):
        if self.open and (t := self.open[-1])["cell"] is not None and not t["skip"]:
            t["rows"][-1][t["cell"]] += data


def tables_of(html: str | None) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [[[re.sub(r"\s+", " ", c).strip() for c in row] for row in t if row] for t in parser.tables]


class HtmlTables:
    """html -> (table_no, row_no, cells), for F.udtf."""

    def eval(self, html: str):
        for i, t in enumerate(tables_of(html)):
            for j, cells in enumerate(t):
                yield i, j, cells


TABLES_SCHEMA = "table_no int, row_no int, cells array<string>"


def html_tables(spark):
    return F.udtf(HtmlTables, returnType=TABLES_SCHEMA)


def constituents(html: str) -> list[dict[str, str]]:
    """The rows of the largest table whose header names a symbol or ticker, by the header's names."""
    best = max((t for t in tables_of(html) if t and any(h.lower() in ("symbol", "ticker", "ticker symbol") for h in t[0])), key=len, default=None)
    if not best:
        return []
    return [dict(zip(best[0], row)) for row in best[1:] if len(row) == len(best[0])]


def constituent_changes(html: str) -> list[tuple[str, str, str]]:
    """(date text, change, ticker) of the tables whose first two rows speak of what was added and removed: the date,
    what joined and its name, what left and its name, by place; rows that are short end early."""
    out = []
    for table in tables_of(html):
        said = " ".join(c.lower() for row in table[:2] for c in row)
        if len(table) < 2 or "added" not in said or "removed" not in said:
            continue
        for row in table:
            if row and re.search(r"\d{4}", row[0]):
                out += [(row[0], change, row[i]) for i, change in ((1, "join"), (3, "leave")) if len(row) > i and row[i]]
    return out


def seeds(text: str, table: str) -> list[dict]:
    """The entries of an array of tables in a TOML text."""
    import tomllib

    return tomllib.loads(text).get(table, [])


def roster(spark, entries: list[dict], columns: list[str]) -> DataFrame:
    """A seed list as rows, missing fields null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.createDataFrame([tuple(e.get(c) for c in columns) for e in entries], schema)
