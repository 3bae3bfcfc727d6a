"""Chat formatting: fingerprints of record layouts select mappings into canonical turns; a reversible template."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template. A turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"

#: Declarative mappings: the record's paths, and either turns in a list (list, role, text) or fixed turns (role, path).
#: A text of several paths joins those that are not empty by a blank line.
LAYOUTS = {
    ("messages[].content", "messages[].role"): {"list": "messages", "role": "role", "text": "content"},
    ("conversations[].from", "conversations[].value"): {"list": "conversations", "role": "from", "text": "value"},
    ("completion", "prompt"): {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    ("prompt", "response"): {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    ("instruction", "output"): {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    ("input", "instruction", "output"): {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    ("output", "question", "system"): {"turns": [("system", ["system"]), ("user", ["question"]), ("assistant", ["output"])]},
    ("role", "text", "turn"): {"rows": ("turn", "role", "text")},
    ("content", "role", "turn"): {"rows": ("turn", "role", "content")},
}
#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    """The hash of sorted nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def by_fingerprint(rows_only: bool = False) -> list[tuple[tuple, str, dict]]:
    """(paths, fingerprint, mapping) of the layouts, the one to prefer first: lists hold whole conversations, more paths say more."""
    found = [(paths, fingerprint(paths), how) for paths, how in LAYOUTS.items() if "rows" in how or not rows_only]
    return sorted(found, key=lambda x: ("list" not in x[2], -len(x[0])))


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return paths_of(kind.elementType, prefix + "[]") if isinstance(kind, T.ArrayType) else [prefix]


def json_paths(record: Column) -> Column:
    """Sorted nested field paths of each JSON record (two levels: fields, and fields of the objects in lists)."""
    inner = lambda v: F.from_json(v, "array<map<string,string>>")
    fields = F.map_entries(F.from_json(record, "map<string,string>"))
    deep = F.transform(fields, lambda e: F.when(e["value"].startswith("[{"), F.transform(F.array_distinct(F.flatten(F.transform(inner(e["value"]), F.map_keys))), lambda k: F.concat(e["key"], F.lit("[]."), k))).otherwise(F.array(e["key"])))
    return F.sort_array(F.array_distinct(F.flatten(deep)))


def turns_from_json(records: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text, layout) of JSON records in any of LAYOUTS; layout is the fingerprint of the paths that the mapping uses.

    A mapping is taken if the record's paths among the mapping's own have its fingerprint, so further paths don't matter.
    Records for which none is taken (layout is the fingerprint of all their paths then), or that are null or not JSON, give
    one row with null turn, role and text, so nothing is lost silently.
    """
    r = F.col(record)
    marked = records.select(F.col(key), r.alias("_r"), json_paths(r).alias("_p"))
    hashed = lambda paths: F.sha2(F.array_join(paths, "\n"), 256)
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    chosen = F.lit(None).cast(turn)
    layout = hashed(F.col("_p"))
    for paths, known, how in reversed(by_fingerprint()):
        if "list" in how:
            made = F.expr(f"transform(from_json(get_json_object(_r, '$.{how['list']}'), 'array<map<string,string>>'), (m, i) -> struct(CAST(i AS BIGINT) AS turn, m['{how['role']}'] AS role, m['{how['text']}'] AS text))")
        elif "turns" in how:
            parts = lambda ps: F.array_join(F.filter(F.array(*[F.get_json_object("_r", f"$.{p}") for p in ps]), lambda x: x != ""), "\n\n")
            made = F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), parts(ps).alias("text")) for i, (role, ps) in enumerate(how["turns"])])
        else:
            t, role, text = how["rows"]
            made = F.array(F.struct(F.get_json_object("_r", f"$.{t}").cast("long").alias("turn"), F.get_json_object("_r", f"$.{role}").alias("role"), F.get_json_object("_r", f"$.{text}").alias("text")))
        same = hashed(F.array_sort(F.array_intersect("_p", F.array(*[F.lit(p) for p in paths])))) == known
        chosen, layout = F.when(same, made.cast(turn)).otherwise(chosen), F.when(same, F.lit(known)).otherwise(layout)
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return marked.select(F.col(key), F.explode_outer(chosen).alias("t"), layout.alias("layout")).select(key, "t.turn", F.coalesce(names[F.col("t.role")], F.col("t.role")).alias("role"), "t.text", "layout")


def turns_from_rows(table: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text, layout) of a table with a row for each turn, by the fingerprint of its columns; extra columns don't matter."""
    have = {p.lower() for p in paths_of(table.schema)}
    for paths, known, how in by_fingerprint(rows_only=True):
        if (found := fingerprint(have & set(paths))) == known:
            t, role, text = how["rows"]
            return table.select(F.col(key), F.col(t).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(found).alias("layout"))
    raise ValueError(f"no layout for the columns {sorted(have)}")


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): a conversation's turns in the template, and the spans of assistant texts in code points.

    Turns are ordered by turn, role and text, nulls first. A null role or text is empty; a
    null key is a conversation like others. Control strings inside texts are escaped, reversibly.
    Lengths run over a window and turns meet once, in the row of their conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(_escape(role), F.lit(CLOSE), F.lit("|\\>")), F.lit(CLOSE))
    rows = turns.select(key, "turn", role.alias("role"), text.alias("text"), head.alias("_head"), _escape(text).alias("_body"))
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    by = Window.partitionBy(key).orderBy("turn", "role", "text")
    start = F.coalesce(F.sum(F.length("_piece")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("_head")
    rows = rows.withColumns({"_start": start, "_at": F.row_number().over(by)})
    got = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_piece", "role", "_start", (F.col("_start") + F.length("_body")).alias("_end")))).alias("_t"))
    loss = F.transform(F.filter("_t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["_start"].cast("int").alias("start"), x["_end"].cast("int").alias("end")))
    return got.select(key, F.array_join(F.transform("_t", lambda x: x["_piece"]), "").alias("formatted"), loss.alias("loss"))


def read_chats(chats: DataFrame, formatted: str = "formatted") -> DataFrame:
    """chats with turns (role, text), parsed back from the formatted string."""
    pieces = F.split(F.col(formatted), "<\\|end\\|>\n")
    cut = lambda p: F.regexp_extract(p, r"(?s)^<\|(.*?)\|>(.*)$", 1)
    body = lambda p: F.regexp_extract(p, r"(?s)^<\|(.*?)\|>(.*)$", 2)
    return chats.withColumn("_p", pieces).withColumn("turns", F.transform(F.slice("_p", 1, F.size("_p") - 1), lambda p: F.struct(_unescape(cut(p)).alias("role"), _unescape(body(p)).alias("text")))).drop("_p")


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: _unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def layouts_report() -> str:
    return json.dumps({fingerprint(p): list(p) for p in LAYOUTS}, indent=1)
