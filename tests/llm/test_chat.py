import json

from quadrille.llm import chat

SCHEMA = "conv_id bigint, raw string, turn int, layout int"


def paths(value, at=""):
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")}
    return {at}


RECORDS = [
    {"messages": [{"role": "System", "content": "be kind"}, {"content": "hi", "role": " user "}, {"role": "assistant", "content": ""}]},
    {"conversations": [{"from": "human", "value": "hé\n\"q\""}, {"from": "gpt", "value": "a"}, {"from": None, "value": "?"}]},
    {"dialog": {"turns": [{"speaker": "bot", "text": 5}, {"speaker": "x", "text": None}]}},
    {"completion": "c", "prompt": "p"},
    {"output": "o", "instruction": "i", "input": ""}, {"output": "o", "instruction": "i", "input": "more"},
    {"system": "s", "prompt": "p", "completion": "c"},
    {"answer": "a", "question": "q"},
]
WANT = [
    [("system", "be kind"), ("user", "hi"), ("assistant", "")],
    [("user", 'hé\n"q"'), ("assistant", "a"), ("unknown", "?")],
    [("assistant", "5")],
    [("user", "p"), ("assistant", "c")],
    [("user", "i"), ("assistant", "o")], [("user", "i\n\nmore"), ("assistant", "o")],
    [("system", "s"), ("user", "p"), ("assistant", "c")],
    [("user", "q"), ("assistant", "a")],
]


def test_every_layout_becomes_canonical_turns(make):
    docs = make([(i, json.dumps(r), 0, 0) for i, r in enumerate(RECORDS)], SCHEMA)
    got = {}
    for r in sorted(chat.canonical_turns(docs).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == dict(enumerate(WANT))
    prints = {r.id: r.fingerprint for r in chat.parsed(docs, "conv_id", "raw", chat.MAPPINGS).collect()}
    assert prints == {i: chat.fingerprint_of(sorted(paths(r))) for i, r in enumerate(RECORDS)}


def test_defined_cases(make):
    rows = [(1, None), (2, ""), (3, "{broken"), (4, '{"other": 1}'), (5, '{"messages": []}'), (6, '"text"'), (None, '{"prompt": "p", "completion": "c"}'), (7, '{"prompt": "p", "completion": "c"}'), (7, '{"prompt": "p", "completion": "c"}'), (8, json.dumps({"prompt": "x" * 500_000, "completion": ""}))]
    docs = make([(i, t, 0, 0) for i, t in rows], SCHEMA)
    got = chat.canonical_turns(docs).collect()
    assert sorted((r.conv_id or 0, r.turn) for r in got) == [(0, 0), (0, 1), (7, 0), (7, 0), (7, 1), (7, 1), (8, 0), (8, 1)]
    seen = {(r.fingerprint is None, r.layout): r.n_records for r in chat.layouts(docs).groupBy("fingerprint", "layout").sum("n_records").withColumnRenamed("sum(n_records)", "n_records").collect() if r.layout or r.fingerprint is None}
    assert seen == {(True, None): 3, (False, "completion"): 4}
    assert chat.canonical_turns(docs.limit(0)).collect() == []


def test_round_trip_of_conversations(make):
    rows = [(c, t, ("user", "assistant")[t % 2] if c % 4 else ("system", "user", "assistant")[t], f"say {c} {t}") for c in range(30) for t in range(2 if c % 5 < 3 and c % 4 else 3)]
    talk = make(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.canonical_turns(chat.heterogeneous(talk))
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in got.collect()) == sorted(rows)
    assert {r.layout for r in got.collect()} == {"messages", "sharegpt", "dialog", "completion", "instruction"}


def test_more_fields_than_a_layout_do_not_hide_it(make):
    records = [
        {"id": "a1", "messages": [{"role": "user", "content": "hi", "name": "Ann"}, {"role": "assistant", "content": "yo", "tool_calls": [{"id": 1, "function": {"name": "f", "arguments": "{}"}}]}], "meta": {"tags": ["x"], "score": 1.5}},
        {"prompt": "p", "completion": "c", "odd `key`, <x>: y": 3, "system": "s"},
        {"instruction": "i", "output": "o", "ratings": [1, 2]},
        {"messages": [{"role": "user"}], "id": 5},
        {"prompt": "p", "completion": "c", "question": "q", "answer": "a"},
    ]
    docs = make([(i, json.dumps(r), 0, 0) for i, r in enumerate(records)], SCHEMA)
    got = {}
    for r in sorted(chat.canonical_turns(docs).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got[0] == [("messages", "user", "hi"), ("messages", "assistant", "yo")]
    assert got[1] == [("system_completion", "system", "s"), ("system_completion", "user", "p"), ("system_completion", "assistant", "c")]
    assert got[2] == [("instruction_output", "user", "i"), ("instruction_output", "assistant", "o")]
    assert 3 not in got and [g[0] for g in got[4]] == ["completion"] * 2


def test_leaves_are_the_paths_of_the_record(spark, make):
    from pyspark.sql import functions as F

    records = [*RECORDS, {"a": {"b": [[{"c": 1}], [{"d": None}]]}, "e f": [1.25, 2], "`": 1, "x.y": {"z": True}, "n": 123456789012345678901234567890}]
    docs = make([(i, json.dumps(r), 0, 0) for i, r in enumerate(records)], SCHEMA)
    for r in docs.select("conv_id", F.schema_of_variant(F.parse_json("raw")).alias("s")).collect():
        assert chat.leaves_of(r.s) == paths(records[r.conv_id])
