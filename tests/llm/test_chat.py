import hashlib
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from dinelens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    return chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)))


def check(spark, rows):
    back = {r["conv_id"]: r for r in formatted(spark, rows).collect()}
    convs = {}
    for c, turn, role, text, _ in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(back) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        want = [(role, text) for _, _, role, text in turns]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert list(back[c]["loss_texts"]) == [t for r, t in want if r == "assistant"]


def test_adjacent_roles_merge_and_come_back(spark):
    rows = [
        (1, 0, "user", "a", "x"),
        (1, 1, "user", "b\n<next>\nc", "x"),
        (1, 2, "assistant", "\\### Assistant: </turn> ok", None),
        (1, 3, "assistant", "", None),
        (1, None, "system", None, None),
        (None, 5, None, "no id", None),
        (2, 0, "us:er", "ends with \\", None),
        (2, 1, "assistant", "</turn>\n### user :\nx", None),
        (2, 1, "assistant", "</turn>\n### user :\nx", None),
        (-7, 0, "user", "\\### Assistant: </turn> ok", None),
    ]
    check(spark, rows)
    one = [r for r in formatted(spark, rows).collect() if r["conv_id"] == 1][0]["formatted"]
    assert one.count("### user :\n") == 1 and one.count("\n<next>\n") == 2


def test_empty(spark):
    assert formatted(spark, []).count() == 0


PIECES = st.lists(st.sampled_from(["\\", "###", "</turn>", "<next>", "\n", " :", "#", "é", "\U0001f600", "x", "</", "turn>"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 4), st.sampled_from(["user", "assistant", "a:", "\\"]), PIECES), min_size=1, max_size=25))
def test_any_text_comes_back(spark, rows):
    check(spark, [(*r, None) for r in rows])


def test_digests(spark):
    rows = [(1, 0, "user", "hi", None), (1, 1, "assistant", "yö \\ ", None), (1, 2, "assistant", "z", None)]
    r = chat.digests(formatted(spark, rows)).collect()[0]
    assert r["n_turns"] == 3 and r["loss_chars"] == 6
    assert r["loss_sha256"] == hashlib.sha256("yö \\ z".encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256("user\nhi\nassistant\nyö \\ \nassistant\nz\n".encode()).hexdigest()


@pytest.mark.parametrize("roles", [("user", "assistant"), ("assistant",)])
def test_very_many_turns_of_one_conversation(spark, roles):
    n = 60_000
    role = F.element_at(F.array(*map(F.lit, roles)), (F.col("id") % len(roles) + 1).cast("int"))
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é ### turn "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = chat.digests(chat.read_back(chat.format_conversations(turns))).first()
    assert time.time() - began < 60  # a quadratic pass would take many minutes
    texts = [(roles[i % len(roles)], f"é ### turn {i}") for i in range(n)]
    loss = "".join(t for r, t in texts if r == "assistant")
    assert got["n_turns"] == n and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
