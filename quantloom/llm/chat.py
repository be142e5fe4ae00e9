"""Chat formatting: heterogeneous layouts of conversations, recognised by schema fingerprint, in one template.

Each row, with its nested columns, is a variant. The known field paths that it has, sorted and hashed, are
its fingerprint, and select a declarative mapping to canonical turns (position, role, text). A row whose
fingerprint is not registered, for it has known paths besides, takes the first mapping all of whose paths it
has. A turn is written

    ### role:\\n text </turn>\\n      without the blanks around text

with \\, #, : and </turn> escaped in roles, and \\, # and </turn> in texts, so that no text can look like a
mark and all is read back as it was. The loss mask is the spans of the assistant's texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table


@dataclass(frozen=True)
class Layout:
    """Where a layout's turns are: an array of (role, text) at each, or a row's own turn at position, or
    (role, paths whose texts are joined by a blank line) in order."""

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    position: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), role="role", text="text", position="turn"),
    Layout("message rows", ("index", "role", "content"), role="role", text="content", position="index"),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("no messages", ("messages",), "messages", "role", "content"),
    Layout("from and value", ("conversations", "conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("no conversations", ("conversations",), "conversations", "from", "value"),
    Layout("instruction and input", ("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system prompt", ("system", "prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt and completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", ("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: other names for the roles, in layouts that are not rows of turns
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))
_TURNS = "array<struct<position: bigint, role: string, text: string>>"


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _has(record: Column, path: str) -> Column:
    return F.try_variant_get(record, "$." + path.replace("[]", "[0]"), "variant").isNotNull()


def record_fingerprint(record: Column) -> Column:
    """The hash of the known paths that a variant has."""
    present = F.array(*(F.when(_has(record, p), F.lit(p)) for p in PATHS))
    return F.md5(F.array_join(F.filter(present, lambda p: p.isNotNull()), "\n").cast("binary"))


def layout_of(record: Column) -> Column:
    """The name of a record's layout, or null."""
    by_print = F.create_map(*(F.lit(x) for layout in LAYOUTS for x in (fingerprint(layout.paths), layout.name)))
    all_paths = lambda layout: F.array(*(_has(record, p) for p in layout.paths))
    partly = F.coalesce(*(F.when(F.forall(all_paths(x), lambda p: p), F.lit(x.name)) for x in LAYOUTS))
    return F.coalesce(by_print[record_fingerprint(record)], partly)


def _texts(record: Column, paths) -> Column:
    parts = [F.try_variant_get(record, f"$.{p}", "string") for p in paths]
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")


def _role(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(known[F.lower(name)], F.lower(name), F.lit(""))


def _turn(x: Layout):
    return lambda t, i: F.struct(
        i.cast("bigint").alias("position"), _role(t[x.role]).alias("role"), F.coalesce(t[x.text], F.lit("")).alias("text")
    )


def turns_of(record: Column, layout: Column) -> Column:
    """A record's turns, an empty array for unknown layouts. Null texts and roles are empty."""
    out = F.lit(None).cast(_TURNS)
    for x in LAYOUTS:
        if x.position:
            one = F.struct(
                F.try_variant_get(record, f"$.{x.position}", "bigint").alias("position"),
                F.coalesce(F.try_variant_get(record, f"$.{x.role}", "string"), F.lit("")).alias("role"),
                F.coalesce(F.try_variant_get(record, f"$.{x.text}", "string"), F.lit("")).alias("text"),
            )
            turns = F.array(one)
        elif x.each:
            kind = f"array<struct<`{x.role}`: string, `{x.text}`: string>>"
            turns = F.transform(F.try_variant_get(record, f"$.{x.each}", kind), _turn(x))
        else:
            turns = F.array(
                *(
                    F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(role).alias("role"), _texts(record, paths).alias("text"))
                    for i, (role, paths) in enumerate(x.turns)
                )
            )
        out = F.when(layout == x.name, turns.cast(_TURNS)).otherwise(out)
    return F.coalesce(out, F.array().cast(_TURNS))


def canonical(rows: DataFrame, id_column: str = "conv_id", json_column: str | None = None) -> DataFrame:
    """(id, layouts, turns) of conversations in any known layout, as columns or as JSON text.

    Rows with the same id, a null one too, are one conversation: its turns go by position (null first), ties
    by role and text; repeated rows are repeated turns. layouts has unknown for rows that no mapping fits,
    which add no turns; so does JSON that is broken. Columns that no layout knows are not looked at.
    """
    if json_column:
        record = F.try_parse_json(F.col(json_column))
    else:
        known = {p.split("[")[0] for p in PATHS}
        columns = [f.name for f in rows.schema if f.name in known]
        record = F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in columns))) if columns else F.parse_json(F.lit("{}"))
    rows = rows.select(F.col(id_column), record.alias("__record"))
    rows = rows.select(id_column, "__record", layout_of(F.col("__record")).alias("__layout"))
    rows = rows.select(id_column, F.coalesce("__layout", F.lit("unknown")).alias("layout"), turns_of(F.col("__record"), F.col("__layout")).alias("turns"))
    return rows.groupBy(id_column).agg(
        F.sort_array(F.collect_set("layout")).alias("layouts"), F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns")
    )


def escape(text: Column, marks: str = r"\\|#|(?<=<)/(?=turn>)") -> Column:
    return F.regexp_replace(text, f"({marks})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(chats: DataFrame) -> DataFrame:
    """Adds text, the conversation in the template, and loss, the spans (start from 0, length) in code points
    of the assistant's texts in it."""
    piece = lambda t: F.struct(
        F.concat(F.lit("### "), escape(t.role, r"\\|#|:|(?<=<)/(?=turn>)"), F.lit(":\n")).alias("head"),
        escape(t.text).alias("body"),
        (t.role == "assistant").alias("loss"),
    )
    out = chats.withColumn("__pieces", F.transform("turns", piece))
    tail = "</turn>\n"
    spans = F.aggregate(
        "__pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans")),
        lambda s, p: F.struct(
            (s.at + F.length(p.head) + F.length(p.body) + len(tail)).alias("at"),
            F.when(p.loss, F.concat(s.spans, F.array(F.struct((s.at + F.length(p.head)).alias("start"), F.length(p.body).alias("length"))))).otherwise(s.spans).alias("spans"),
        ),
        lambda s: s.spans,
    )
    text = F.array_join(F.transform("__pieces", lambda p: F.concat(p.head, p.body, F.lit(tail))), "")
    return out.select(*chats.columns, text.alias("text"), spans.alias("loss")).drop("turns")


def read_back(chats: DataFrame) -> DataFrame:
    """(text, loss, ...) -> turns and loss_text besides, from the formatted text alone."""
    parts = F.split("text", "</turn>\n", -1)
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+):\n(.*)$"  # possessive: the matcher loops, and a long role takes no stack
    turn = lambda t: F.struct(unescape(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_extract(t, head, 2)).alias("text"))
    under = F.transform("loss", lambda s: unescape(F.col("text").substr(s.start + 1, s.length)))
    return chats.withColumns({"turns": F.transform(F.slice(parts, 1, F.size(parts) - 1), turn), "loss_text": F.array_join(under, "")})


def format_chats(rows: DataFrame, id_column: str = "conv_id", json_column: str | None = None) -> DataFrame:
    """Conversations of canonical() in the template: id, layouts, text, loss."""
    return formatted(canonical(rows, id_column, json_column))


PLANTED = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "select -7L as conv_id, turn, role, :text as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
    back = read_back(format_chats(rows.unionByName(spark.sql(planted, args={"text": PLANTED}))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), ':', '\:'), '</turn>', '<\/turn>') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
