"""Which tables a statement reads and writes, and the edges between them."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_WRITE = re.compile(r"^\s*(?:with\b.*?\)\s*)?(insert\s+(?:into|overwrite)(?:\s+table)?|merge\s+into|update|delete\s+from|create\s+(?:or\s+replace\s+)?(?:table|view)(?:\s+if\s+not\s+exists)?)\s+([\w.`]+)", re.I | re.S)


def sources(spark: SparkSession, sql: str) -> list[str]:
    """The relations that Spark's own parser finds in a query, CTEs left out."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text = plan.toString()
    names = {".".join(p.strip() for p in m.split(",")) for m in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", text)}
    ctes = {m for m in re.findall(r"(?:with|,)\s*([A-Za-z_]\w*)\s+as\s*\(", sql, re.I)}
    return sorted(n for n in names if n not in ctes)


def classify(spark: SparkSession, sql: str) -> dict:
    """kind (read or write), target and sources of a statement."""
    m = _WRITE.search(sql)
    if not m:
        return {"kind": "read", "target": None, "sources": sources(spark, sql)}
    target = m[2].replace("`", "")
    # without the clause that names the target, what is left is the query that is written, if there is one
    rest = sql[: m.start(1)] + re.sub(r"^\s*(?:\([^()]*\)\s*)?(?:as\s+)?(?=(?:select|with)\b)", "", sql[m.end(2) :], flags=re.I)
    read = sources(spark, rest) if re.match(r"\s*(?:with|select)\b", rest, re.I) else []
    return {"kind": "write", "target": target, "sources": [s for s in read if s != target]}


def edges(spark: SparkSession, statements: list[str]) -> list[tuple[str, str, str]]:
    """(source, target, kind) of a run's statements in order: a write that selects is direct; one of bare values is
    correlated to what was read since the last write."""
    out, recent = [], []
    for sql in statements:
        s = classify(spark, sql)
        if s["kind"] == "read":
            recent += [x for x in s["sources"] if x not in recent]
            continue
        kind, read = ("direct", s["sources"]) if s["sources"] else ("correlated", recent)
        out += [(x, s["target"], kind) for x in read]
        recent = []
    return list(dict.fromkeys(out))


def mermaid(found: list[tuple[str, str, str]]) -> str:
    arrow = {"direct": "-->", "correlated": "-.->"}
    return "\n".join(["graph LR", *(f"  {a.replace('.', '_')}[{a}] {arrow[k]} {b.replace('.', '_')}[{b}]" for a, b, k in found)])
