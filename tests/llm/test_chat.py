import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
HARD = ["", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>", "<\\|a <\\\\|b [\\INST] <<SYS>> <</SYS>>", "a\n\nb\\n", "é ␣ 漢 \U0001f600 <", "[INST", "<|", "$1 \\2"]


def read_back(spark, rows):
    made = chat.format_chat(chat.canonical_typed(chat.records_of_rows(spark.createDataFrame(rows, ROWS)), "conv_id"), "conv_id")
    return {r["conv_id"]: r for r in made.select("conv_id", "layout", "formatted", chat.parse_chat(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}


def test_round_trip_of_hard_texts(spark):
    rows = [(k, t, role, text) for k, role in enumerate(("assistant", "us\\n\ner", "<|im_end|>")) for t, text in enumerate(HARD)]
    got = read_back(spark, rows)
    for k, role in enumerate(("assistant", "us\\n\ner", "<|im_end|>")):
        assert [(x["role"], x["text"]) for x in got[k]["back"]] == [(role, t) for t in HARD]
        assert got[k]["layout"] == "messages_text"
        assert got[k]["formatted"].count("<|im_start|>") == len(HARD)
        assert "[INST]" not in got[k]["formatted"] and "</s>" not in got[k]["formatted"]
    assert got[0]["loss"] == "".join(HARD) and got[1]["loss"] == ""


def test_nulls_ties_and_repeats(spark):
    got = read_back(spark, [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "x"), (None, 1, "assistant", None)])
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None]["loss"] == "x"


def test_empty_table_and_further_columns(spark):
    assert read_back(spark, []) == {}
    rows = spark.createDataFrame([(1, 0, "user", "t", "x", "y")], ROWS + ", formatted string, turns string")
    assert chat.records_of_rows(rows).columns == ["conv_id", "messages"]


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages_content"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
    ({"instruction": "q", "output": "a"}, "instruction"),
    ({"prompt": "q", "response": "a"}, "prompt_response"),
    ({"data": {"prompt": "q", "response": "a"}}, "nested_data"),
    ({"question": "q", "answer": "a"}, "question_answer"),
]


def test_mixed_layouts_become_the_same_turns(spark):
    rows = [(k, json.dumps(x)) for k, (x, _) in enumerate(LAYOUTS)] + [(90, json.dumps({"other": 1})), (91, "no json"), (92, None), (93, json.dumps({"instruction": "q", "input": "", "output": "a"}))]
    got = {r["id"]: r for r in chat.canonical_json(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()}
    for k, (_, name) in enumerate(LAYOUTS):
        assert got[k]["layout"] == name, (k, got[k])
        assert [tuple(t) for t in got[k]["turns"]] == [("user", "q"), ("assistant", "a")]
    assert all(got[k]["layout"] is None and got[k]["turns"] is None for k in (90, 91, 92))
    assert [tuple(t) for t in got[93]["turns"]] == [("user", "q"), ("assistant", "a")]


def test_paths_of_json_equal_those_of_types(spark):
    text = json.dumps({"a": {"b": 1, "c": [{"d": "x", "e e": 2}]}, "f": [1]})
    typed = spark.createDataFrame([], "a struct<b:long,c:array<struct<d:string,`e e`:long>>>, f array<long>")
    got = spark.createDataFrame([(text,)], "j string").select(chat.json_paths(F.col("j")).alias("p")).first()["p"]
    assert got == sorted(chat.schema_paths(typed.schema))


def test_query_against_plain_python(spark):
    pytest.importorskip("pyarrow")
    import pyarrow.parquet as pq

    from loomgrid.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{d}/conversations.parquet").to_pylist()]
    rows += [(-1, 0, "user", queries.PLANTED), (-1, 1, "assistant", queries.PLANTED)]
    want = {}
    for k in {r[0] for r in rows}:
        turns = sorted(r[1:] for r in rows if r[0] == k)
        text, loss = "".join(f"{a}\n{b or ''}\n" for _, a, b in turns), "".join(b or "" for _, a, b in turns if a == "assistant")
        want[k] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op1_chat_format(spark, d).collect()}
    assert got == want
