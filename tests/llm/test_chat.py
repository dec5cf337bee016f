from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqspark.llm import chat

MARKS = ["[INST:", "[/INST]", "[TURN]", "</s>", "<s>", "<|", "\\", "]", "[", "%5D", "%", "\n", "ok", "é😀", ""]


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, formatted string")
    out = chat.format_conversations(df)
    return {
        r.conv_id: r
        for r in out.select("conv_id", "formatted", F.array_join("segments.text", "").alias("joined"), chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a]b[%<s>", None]), st.lists(st.sampled_from(MARKS), max_size=6).map("".join) | st.none()), min_size=1, max_size=5), min_size=30, max_size=40))
def test_round_trip(spark, talks):
    rows = [(i, k, role, text, None, None) for i, talk in enumerate(talks) for k, (role, text) in enumerate(talk)]
    got = made(spark, rows)
    for i, talk in enumerate(talks):
        want = [(role or "", text or "") for role, text in talk]
        assert [tuple(t) for t in got[i].turns] == want
        assert got[i].loss == "".join(text for role, text in want if role == "assistant")
        assert got[i].joined == got[i].formatted


def test_long_conversation_merges_over_parts(spark):
    rows = [(1, k, "assistant" if k % 300 else "user", f"t{k}", None, None) for k in range(1000)]
    rows += [(None, None, None, None, None, None), (2, 5, "user", "b", None, None), (2, 5, "user", "a", None, None), (2, 5, "user", "a", None, None)]
    got = made(spark, rows)
    assert [t.text for t in got[1].turns] == [f"t{k}" for k in range(1000)]
    assert got[1].formatted.count("[INST:") == 8
    assert [t.text for t in got[2].turns] == ["a", "a", "b"]
    assert [tuple(t) for t in got[None].turns] == [("", "")]
    assert made(spark, []) == {}
