r"""Chat formatting by schema fingerprints, on DataFrame functions alone.

A record's fingerprint is a hash of the nested field paths that it fills. Declarative mappings, keyed by fingerprint,
turn each layout (prompt/response, instruction/input/output, messages, from/value) into canonical turns, an array of
(role, text). A template then writes the turns as one string; control strings inside texts and role names get a
backslash, which reading back takes away, so that any text survives.

Null texts and roles count as empty ones. A record that fills no known set of paths gets null turns, and its
fingerprint shows which layout lacks a mapping. Turns are ordered by (turn, role, text), so that ties and repeated
rows have a fixed order. A very long text is one value of its row. Extra columns aren't read. An empty table has no
conversations. op4 plants a conversation of id -1; rows of the table with that id would be turns of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"

#: A mapping lists (role, path) for scalar layouts, or (path, role field, text field) for lists of turns.
MAPPINGS = {
    "prompt_response": {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "instruction": {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {
        "paths": ["instruction", "input", "output"],
        "turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")],
    },
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
}
#: Other names that layouts use for the three roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Opening and closing control string of each kind of turn.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = r"(<<|\[|<)(\\*)(/?(?:SYS>>|INST\]|ROLE\]|s>))"
_ESCAPED = r"(<<|\[|<)\\(\\*)(/?(?:SYS>>|INST\]|ROLE\]|s>))"
_TURN = r"(?s)(\[ROLE\].*?\[/ROLE\])?(<<SYS>>|\[INST\]|<s>)(.*?)(?:<</SYS>>|\[/INST\]|</s>)"


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The leaf paths of a schema; [] stands for the elements of a list."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        out += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return sorted(out)


def fingerprint_of(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(record: str, schema: T.StructType) -> Column:
    """Hash of the paths that a record fills: those under a top-level field that is not null."""
    filled = [F.when(F.col(f"{record}.`{p.split('.')[0].split('[')[0]}`").isNotNull(), F.lit(p)) for p in field_paths(schema)]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*filled)), "\n")) if filled else fingerprint_of([])


def _list_turn(role, text, role_field: str, text_field: str):
    return lambda x: F.struct(role(x[role_field]).alias("role"), text(x[text_field]).alias("text"))


def canonical_turns(df: DataFrame, record: str = "record", mappings: dict = MAPPINGS) -> DataFrame:
    """df with fingerprint and turns; record is a struct column whose fields may follow any mapped layout."""
    schema = df.schema[record].dataType
    names = set(schema.fieldNames())
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def role(c):
        known = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
        return F.coalesce(known[text(c)], text(c))

    turns = F.lit(None).cast(TURNS)
    for m in mappings.values():
        if not {p.split(".")[0].split("[")[0] for p in m["paths"]} <= names:
            continue
        if "list" in m:
            field, r, t = m["list"]
            made = F.transform(F.col(f"{record}.{field}"), _list_turn(role, text, r, t))
        else:
            made = F.array(*[F.struct(F.lit(r).alias("role"), text(F.col(f"{record}.{p}")).alias("text")) for r, p in m["turns"]])
        turns = F.when(F.col("fingerprint") == fingerprint_of(m["paths"]), made.cast(TURNS)).otherwise(turns)
    return df.withColumn("fingerprint", fingerprint(record, schema)).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_turns(turns: Column) -> Column:
    """One string of marked turns. Roles other than the three are named in front of a user mark."""

    def one(t):
        known = lambda r, i: F.lit(MARKS[r][i])
        is_role = lambda r: t["role"] == r
        head = F.when(is_role("system"), known("system", 0)).when(is_role("user"), known("user", 0)).when(is_role("assistant"), known("assistant", 0))
        tail = F.when(is_role("system"), known("system", 1)).when(is_role("assistant"), known("assistant", 1)).otherwise(known("user", 1))
        named = F.concat(F.lit("[ROLE]"), escape(t["role"]), F.lit("[/ROLE]"), known("user", 0))
        return F.concat(F.coalesce(head, named), escape(t["text"]), tail)

    return F.array_join(F.transform(turns, one), "")


def parse_turns(formatted: Column) -> Column:
    """The turns that format_turns wrote."""
    part = lambda i: F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i))
    roles = F.zip_with(part(1), part(2), lambda name, mark: F.struct(name.alias("name"), mark.alias("mark")))

    def turn(r, t):
        by_mark = F.when(r["mark"] == "<<SYS>>", "system").when(r["mark"] == "<s>", "assistant")
        name = F.substr(r["name"], F.lit(len("[ROLE]") + 1), F.length(r["name"]) - len("[ROLE][/ROLE]"))
        named = F.when(r["name"] != "", unescape(name)).otherwise(F.lit("user"))
        return F.struct(F.coalesce(by_mark, named).alias("role"), unescape(t).alias("text"))

    return F.zip_with(roles, part(3), turn)


def loss_texts(turns: Column) -> Column:
    """The text under the loss mask: what assistants say."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as one record a conversation, in the layout that fits its roles."""
    items = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    convs = rows.groupBy("conv_id").agg(items.alias("items"))
    roles = F.array_join(F.transform("items", lambda x: x["role"]), ",")
    pair, triple = roles == "user,assistant", roles == "system,user,assistant"
    said = lambda i: F.get(F.col("items"), i)["text"]
    record = F.struct(
        F.when(pair, said(0)).alias("prompt"),
        F.when(pair, said(1)).alias("response"),
        F.when(triple, said(0)).alias("instruction"),
        F.when(triple, said(1)).alias("input"),
        F.when(triple, said(2)).alias("output"),
        F.when(~pair & ~triple, F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )
    return convs.select("conv_id", record.alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, fingerprint, formatted, and the turns as read back from formatted."""
    made = canonical_turns(as_records(rows)).select("conv_id", "fingerprint", format_turns(F.col("turns")).alias("formatted"))
    return made.withColumn("turns", parse_turns(F.col("formatted")))


def op4(spark, sf_dir):
    from tideline.llm.common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = format_conversations(rows.unionByName(planted))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_texts(F.col("turns")), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '(<<|\[|<)\\*/?(SYS>>|INST\]|ROLE\]|s>)')) AS extra,
  len(regexp_extract_all(role, '(<<|\[|<)\\*/?(SYS>>|INST\]|ROLE\]|s>)')) AS extra_role FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + extra + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 13 + 13 + length(role) + extra_role END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
