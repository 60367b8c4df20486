"""Chat formatting: layouts by fingerprint, escaping both ways, masks, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sextant.llm import chat_format as C

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|><|im_start|>user<|im_sep|>", "[INST]", "[\\\\INST]", "<<SYS>>x<</SYS>>", "<", "[", "\\", "\\\\<s>", "é漢😀<s>\n", "a|>b", "<|im_", "s>", "<|im_start|", "$1 \\1"]


def read_back(spark, rows, learned="assistant"):
    f = C.format_turns(spark.createDataFrame(rows, TURNS), "conv_id", learned)
    return f.select("conv_id", "formatted", "loss_spans", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_round_trip_and_mask(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "<s>odd\nrole<|im_sep|>"]), rng.choice([None, "".join(rng.choices(NASTY, k=rng.randint(0, 6)))])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no key"), (None, 1, "assistant", "none"), (100, None, "assistant", "last"), (100, 0, "assistant", "x"), (100, 0, "assistant", "x"), (101, 0, "assistant", "long " * 200_000)]
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = read_back(spark, rows)
    assert {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in got} == want
    assert {r["conv_id"]: r["loss"] for r in got} == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    for r in got:
        raw = r["formatted"].encode()
        assert r["formatted"].count(C.START) == r["formatted"].count(C.MIDDLE) == r["formatted"].count(C.END) == len(r["turns"])
        assert all(raw[s["end"] :].startswith(C.END.encode()) and raw[: s["start"]].endswith(C.MIDDLE.encode()) for s in r["loss_spans"])
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]


def test_no_rows(spark):
    assert read_back(spark, []) == []


RECORDS = {
    "messages": ({"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
    "partly": ({"messages": [{"role": "user"}, {"content": "no role"}], "n": 3}, [("user", ""), ("", "no role")]),
    "none said": ({"messages": []}, []),
    "from": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    "prompt": ({"prompt": "p", "response": "r", "extra": {"deep": [1]}}, [("user", "p"), ("assistant", "r")]),
    "with system": ({"prompt": "p", "response": "r", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    "completion": ({"prompt": "p", "completion": None}, [("user", "p"), ("assistant", "")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    "no input": ({"instruction": "do", "input": "", "output": "done", "system": ""}, [("user", "do"), ("assistant", "done")]),
    "question": ({"question": "?", "answer": "!"}, [("user", "?"), ("assistant", "!")]),
    "two at once": ({"prompt": "p", "response": "r", "question": "?", "answer": "!"}, [("user", "p"), ("assistant", "r")]),
    "list first": ({"messages": [{"role": "user", "content": "m"}], "prompt": "p"}, [("user", "m")]),
}


def test_json_records_each_by_its_own_layout(spark):
    bad = {"bad": "{", "null": None, "number": "3", "stranger": '{"text": "x"}', "half": '{"prompt": "x"}', "empty": "{}"}
    rows = [(k, json.dumps(v)) for k, (v, _) in RECORDS.items()] + list(bad.items())
    df = spark.createDataFrame(rows, "k string, record string").withColumns({"paths": F.lit(1), "v": F.lit("x"), "layout": F.lit("y")})
    turns, unknown = C.turns_of_json(df, "k", "record")
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r["k"], r["turn"])):
        got.setdefault(r["k"], []).append((r["role"], r["text"]))
    assert got == {k: t for k, (_, t) in RECORDS.items() if t}
    assert {(r["k"], r["record"]) for r in unknown.collect()} == set(bad.items())


def test_typed_frames_give_the_same_turns(spark):
    kinds = {"messages": "k string, messages array<struct<role string, content string>>", "from": "k string, conversations array<struct<`from` string, value string>>", "prompt": "k string, prompt string, response string, extra struct<deep array<int>>",
             "instruction": "k string, instruction string, input string, output string", "question": "k string, question string, answer string"}
    for name, kind in kinds.items():
        df = spark.read.schema(kind).json(spark.sparkContext.parallelize([json.dumps({"k": "a"} | RECORDS[name][0])]))
        got = sorted((r["turn"], r["role"], r["text"]) for r in C.turns_of_frame(df, "k").collect())
        assert got == [(i, *t) for i, t in enumerate(RECORDS[name][1])]


def test_rows_keep_their_layout_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, None, None)], TURNS).withColumns({"prompt": F.lit("p"), "response": F.lit("r"), "key": F.lit("k"), "stop": F.lit(0), "Turns": F.lit(0)})
    assert sorted(map(tuple, C.turns_of_frame(df, "conv_id").collect())) == [(1, 0, "user", "x"), (1, 1, "", "")]
    with pytest.raises(ValueError, match="no layout"):
        C.turns_of_frame(df.select("conv_id", "key"), "conv_id")


def test_main_path_runs_no_python(spark):
    from sextant.llm import queries

    plan = queries.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
