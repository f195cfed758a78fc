"""Chat formatting by schema fingerprints.

A record is JSON text in any layout.  Its nested field paths, without the values and their types, make a
structure whose SHA-256 is the layout's fingerprint; the fingerprint selects a declarative mapping, and the
mapping's paths turn the record into canonical turns (role, text).  A record with more fields than a layout (an id,
names, tool calls) is taken by the fingerprint of its richest part that is one: of the mappings whose paths it all
has, the one with most.  Records stay VARIANT values inside the JVM; only structures, of which there are few, go to
Python, which keeps what it found for each.  A new layout is a new entry of ``MAPPINGS``, no code.

Cases.  Text that isn't JSON, null and empty text have no fingerprint and no turns; layouts without a mapping
have a fingerprint and no turns (``layouts`` reports them).  Turns whose text is null are left out, empty
texts stay; in a joined text, empty parts are left out.  Roles are trimmed, lower-cased and translated; a
null role is ``unknown``.  Repeated rows are each converted.  An empty table gives an empty result.  Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "answer": "assistant", "developer": "system"}

#: paths: the layout's leaves, ``[]`` for list items.  Either ``each`` with role and text below it, or ``turns``
#: of (role, paths whose texts are joined by a blank line).
MAPPINGS = [
    {"layout": "messages", "paths": ["messages[].role", "messages[].content"], "each": "messages", "role": "role", "text": "content"},
    {"layout": "sharegpt", "paths": ["conversations[].from", "conversations[].value"], "each": "conversations", "role": "from", "text": "value"},
    {"layout": "dialog", "paths": ["dialog.turns[].speaker", "dialog.turns[].text"], "each": "dialog.turns", "role": "speaker", "text": "text"},
    {"layout": "completion", "paths": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"layout": "system_completion", "paths": ["system", "prompt", "completion"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"layout": "instruction", "paths": ["instruction", "input", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"layout": "instruction_output", "paths": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"layout": "question", "paths": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
]
_LEAF = r"(?:BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|VOID|VARIANT|UUID|DECIMAL\(\d+, ?\d+\))"


def structure_of(paths: list[str]) -> str:
    """The structure of a layout given by its leaves, as Spark writes schemas of variants, without leaf types."""
    tree: dict = {}
    for path in paths:
        here = tree
        for step in path.replace("[]", ".[]").split("."):
            here = here.setdefault(step, {})

    def write(node: dict) -> str:
        if not node:
            return ""
        if set(node) == {"[]"}:
            return f"ARRAY<{write(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {write(v)}".rstrip() for k, v in sorted(node.items())) + ">"

    return write(tree)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256(structure_of(paths).encode()).hexdigest()


def structure(schema: str) -> str:
    """A variant's schema as Spark writes it, without leaf types."""
    return re.sub(rf"<{_LEAF}>", "<>", re.sub(rf": {_LEAF}(?=[,>])", ":", schema))


def leaves_of(schema: str) -> set[str]:
    """The leaves of a variant's schema as Spark writes it, ``[]`` for list items."""
    found, at = set(), 0

    def node(path: str) -> None:
        nonlocal at
        if schema.startswith("ARRAY<", at):
            at += 6
            node(path + "[]")
            at += 1
        elif schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                if schema[at] == "`":
                    end = at + 1
                    while schema[end] != "`" or schema[end + 1 : end + 2] == "`":
                        end += 2 if schema[end] == "`" else 1
                    name, at = schema[at + 1 : end].replace("``", "`"), end + 1
                else:
                    end = schema.index(":", at)
                    name, at = schema[at:end], end
                at += 2
                node(f"{path}.{name}" if path else name)
                at += 2 if schema.startswith(", ", at) else 0
            at += 1
        else:
            end, deep = at, 0
            while end < len(schema) and (deep or schema[end] not in ",>"):
                deep += {"(": 1, ")": -1}.get(schema[end], 0)
                end += 1
            at = end
            found.add(path)

    node("")
    return found


def richest(schema: str | None, mappings: list[dict]) -> str | None:
    """The fingerprint of the mapping with most paths of those whose paths are all among the schema's leaves; the first of equals."""
    try:
        leaves = leaves_of(schema or "")
    except (IndexError, ValueError):  # a schema with names that can't be told apart from its syntax
        return None
    inside = [m for m in mappings if leaves.issuperset(m["paths"])]
    return fingerprint_of(max(inside, key=lambda m: len(m["paths"]))["paths"]) if inside else None


def _role(role: Column) -> Column:
    clean = F.lower(F.trim(role))
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, clean), clean, F.lit("unknown"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(mapping: dict, record: Column) -> Column:
    """An array of (role, text) by one mapping."""
    if "each" in mapping:
        r, t = mapping["role"], mapping["text"]
        items = F.try_variant_get(record, f"$.{mapping['each']}", f"array<struct<`{r}`: string, `{t}`: string>>")
        return F.transform(items, lambda x: _turn(_role(x[r]), x[t]))
    made = []
    for role, paths in mapping["turns"]:
        parts = [F.try_variant_get(record, f"$.{p}", "string") for p in paths]
        text = parts[0] if len(parts) == 1 else F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")
        made.append(_turn(F.lit(role), text))
    return F.array(*made)


def parsed(records: DataFrame, id_col: str, raw_col: str, mappings: list[dict]) -> DataFrame:
    """(id, fingerprint, layout, turns) of every record."""
    known = {fingerprint_of(m["paths"]): m for m in mappings}

    @F.arrow_udf("struct<fingerprint:string,part:string>")
    def prints(schemas: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: dict = {None: (None, None)}
        for column in schemas:
            coded = column.dictionary_encode()
            found = []
            for schema in coded.dictionary.to_pylist():
                if schema not in held:
                    held[schema] = hashlib.sha256(structure(schema).encode()).hexdigest(), richest(schema, mappings)
                found.append(held[schema])
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()).take(coded.indices) for i in (0, 1)], ["fingerprint", "part"])

    row = records.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(raw_col).cast("string")).alias("record"))
    row = row.withColumn("p", prints(F.schema_of_variant("record"))).select("id", "record", "p.fingerprint", "p.part")
    chosen = F.when(F.col("fingerprint").isin(*known), F.col("fingerprint")).otherwise(F.col("part"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for print_, mapping in known.items():
        hit = chosen == print_
        layout = F.when(hit, mapping["layout"]).otherwise(layout)
        turns = F.when(hit, _turns(mapping, F.col("record"))).otherwise(turns)
    return row.select("id", "fingerprint", layout.alias("layout"), F.filter(turns, lambda t: t["text"].isNotNull()).alias("turns"))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", raw_col: str = "raw", mappings: list[dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, text, layout): one row for each turn, numbered from 0."""
    rows = parsed(records, id_col, raw_col, MAPPINGS if mappings is None else mappings)
    out = rows.select(F.col("id").alias("conv_id"), "layout", F.posexplode("turns").alias("turn", "said"))
    return out.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "said.role", "said.text", "layout")


def layouts(records: DataFrame, id_col: str = "conv_id", raw_col: str = "raw", mappings: list[dict] | None = None) -> DataFrame:
    """(fingerprint, layout, n_records): also the layouts that have no mapping yet."""
    return parsed(records, id_col, raw_col, MAPPINGS if mappings is None else mappings).groupBy("fingerprint", "layout").agg(F.count("*").alias("n_records"))


def heterogeneous(conversations: DataFrame) -> DataFrame:
    """(conv_id, raw): the conversations written as JSON in five layouts, chosen by the id and the roles."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    one = conversations.groupBy("conv_id").agg(said.alias("said"))
    roles = F.array_join(F.transform("said", lambda x: x["role"]), ",")
    text = lambda i: F.col("said")[i]["text"]
    items = lambda r, t: F.transform("said", lambda x: F.struct(x["role"].alias(r), x["text"].alias(t)))
    kind = F.pmod("conv_id", F.lit(3))
    raw = (
        F.when((roles == "user,assistant") & (kind == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when((roles == "user,assistant") & (kind == 1), F.to_json(F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output"))))
        .when(kind == 0, F.to_json(F.struct(items("role", "content").alias("messages"))))
        .when(kind == 1, F.to_json(F.struct(items("from", "value").alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.struct(items("speaker", "text").alias("turns")).alias("dialog"))))
    )
    return one.select("conv_id", raw.alias("raw"))


ORACLE_SQL = """
WITH shape AS (
  SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id
)
SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) - 1 AS turn, c.role, c.text,
       CASE WHEN roles = 'user,assistant' AND c.conv_id % 3 = 0 THEN 'completion' WHEN roles = 'user,assistant' AND c.conv_id % 3 = 1 THEN 'instruction'
            WHEN c.conv_id % 3 = 0 THEN 'messages' WHEN c.conv_id % 3 = 1 THEN 'sharegpt' ELSE 'dialog' END AS layout
FROM conversations c JOIN shape USING (conv_id)
"""
