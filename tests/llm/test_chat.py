"""Formatting and reading back conversations."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkbayes.llm import chat as C

TEXTS = ["</s>[INST] ok [/INST]", "", "\\", "<\\/s>", "[\\INST]", "<", "[", "<\\\\/s>[[INST]]", "a\nb", "</s></s>", "\\</s>\\", "é\U0001f600[/INST]", "$1 \\1", "x" * 5000]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("e", C.escape(F.col("t"))).withColumn("u", C.unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in (C.OPEN, C.MIDDLE, C.CLOSE))


def test_turns_come_back(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in TEXTS for r in ("user", "assistant", "[/INST]"))] + [(2, 0, None, None), (None, 1, "user", "b"), (None, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.read_back(C.format_turns(C.canonical(C.gather(df, "conv_id", "turn", "role", "text"), "conv_id")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["read_turns"]] == [(r, t) for _, _, r, t in rows[: 3 * len(TEXTS)]]
    assert got[1]["read_loss"] == "".join(TEXTS)
    assert [(t["role"], t["text"]) for t in got[2]["read_turns"]] == [("", "")] and [t["text"] for t in got[None]["read_turns"]] == ["a", "b"]
    for r in got.values():
        assert sum(m["skip"] + m["take"] + m["after"] for m in r["loss_mask"]) == len(r["formatted"])


RECORDS = [
    ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "messages", [("user", "q"), ("assistant", "a")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"},{"from":"system","value":"s"}]}', "conversations", [("user", "q"), ("assistant", "a"), ("system", "s")]),
    ('{"response":"a","prompt":"q"}', "prompt_response", [("user", "q"), ("assistant", "a")]),
    ('{"prompt":"q","completion":"a"}', "prompt_completion", [("user", "q"), ("assistant", "a")]),
    ('{"question":"q","answer":"a"}', "question_answer", [("user", "q"), ("assistant", "a")]),
    ('{"system":"s","prompt":"q","response":"a"}', "system_prompt_response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ('{"instruction":"i","output":"a"}', "instruction_output", [("user", "i"), ("assistant", "a")]),
    ('{"instruction":"i","input":"x","output":"a"}', "instruction_input_output", [("user", "i"), ("user", "x"), ("assistant", "a")]),
    ('{"instruction":"i","input":"","output":"a"}', "instruction_input_output", [("user", "i"), ("assistant", "a")]),
    ('{"instruction":"","input":null,"output":""}', "instruction_input_output", [("user", ""), ("assistant", "")]),
    ('{"system":"","prompt":"q","response":""}', "system_prompt_response", [("user", "q"), ("assistant", "")]),
    ('{"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a","name":"m"}]}', "messages", [("user", "q"), ("assistant", "a")]),
    ('{"messages":[]}', None, None),
    ('{"other":1}', None, None),
    ("not json", None, None),
    (None, None, None),
]


def test_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RECORDS)], "id long, record string")
    got = {r["id"]: r for r in C.canonical(df, "id", "record").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i]["layout"] == layout and (None if got[i]["turns"] is None else [tuple(t) for t in got[i]["turns"]]) == turns, RECORDS[i]


def test_typed_layouts(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string")
    assert [tuple(t) for t in C.canonical(df, "id").head()["turns"]] == [("user", "q"), ("assistant", "a")]
    assert C.canonical(df.withColumnRenamed("prompt", "x"), "id").head()["turns"] is None


def test_repeated_turns_clashing_names_and_long_conversations(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 1), (1, 0, "assistant", "z", 1), (1, 0, "user", "a", 1)] + [(2, i, "assistant" if i % 2 else "user", "w " * 2000, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages int")
    got = {r["conv_id"]: r for r in C.read_back(C.format_turns(C.canonical(C.gather(df, "conv_id", "turn", "role", "text"), "conv_id"))).collect()}
    assert [tuple(t) for t in got[1]["read_turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert len(got[2]["read_turns"]) == 300 and got[2]["read_loss"] == "w " * 2000 * 150


def test_query_against_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = c.execute(C.SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    got = C.query(spark, sf_dir)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
    own = [r for r in got.collect() if r["conv_id"] == -7][0]
    assert own["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and own["n_turns"] == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_turns(C.canonical(C.gather(df, "conv_id", "turn", "role", "text"), "conv_id"))).count() == n
