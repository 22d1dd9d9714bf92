"""Windows against a plain walk over every conversation."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitlife.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\s>", "[\\\\INST]", "hé", "\n", "[", "<", "\\", "", " a"]


def conversations(seed=2):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        turns = rng.choice([1, 2, 5, 60])
        for t in range(turns):
            role = "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant", "tool"])
            text = "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 4, 30])))
            rows.append((conv, t * rng.choice([1, 1, 1]), role, text if rng.random() > 0.05 else None, 1))
    rows += [(None, 0, "user", "x", 1), (None, None, None, "first", 1), (99, 3, "assistant", "same", 1),
             (99, 3, "assistant", "same", 1), (98, 0, "assistant", "z" * 5000, 1), (98, 1, "user", "q", 1)]
    return rows


def walk(rows, budget, history, block):
    """Per conversation: its turns, their costs, and windows as (repeated, new) lists of places."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        costs = [-(-len(text.encode()) // 4) + chat.TURN_TOKENS for *_, text in turns]
        starts = [sum(costs[:i]) for i in range(len(turns))]
        made = []
        for i, cost in enumerate(costs):
            system = [0] if turns[0][2] == "system" and i else []
            if made and starts[i] // (block * budget) == starts[i - 1] // (block * budget):
                again, new = made[-1]
                if sum(costs[j] for j in again + new) + cost <= budget:
                    new.append(i)
                    continue
            left = budget - cost - sum(costs[j] for j in system)
            back = [j for j in range(len(system), i) if starts[i] - starts[j] <= min(history, left)]
            made.append((system + back, [i]))
        out[conv] = (turns, costs, made)
    return out


@pytest.mark.parametrize("budget, history, piece, block", [
    (2048, 512, 4096, 16), (80, 30, 7, 16), (80, 60, 7, 1), (40, 0, 1, 2), (25, 24, 3, 3)])
def test_windows(spark, budget, history, piece, block):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")
    got = {}
    for r in chat.read_back(chat.windows(df, budget, history, piece=piece, block=block)).collect():
        got.setdefault(r.conv_id, []).append(r)
    want = walk(rows, budget, history, block)
    assert got.keys() == want.keys()
    for conv, (turns, costs, made) in want.items():
        found = sorted(got[conv], key=lambda r: r.window)
        assert len(found) == len(made)
        for r, (again, new) in zip(found, made, strict=True):
            held = sum(costs[i] for i in again + new)
            assert held <= budget or len(new) == 1 and len(again) == (turns[0][2] == "system" and new != [0])
            assert r.window == new[0]
            assert (r.n_repeated, r.n_turns) == (len(again), len(again) + len(new))
            assert [tuple(t) for t in r.turns] == [turns[i][2:] for i in new]
            assert r.targets == [turns[i][3] for i in new if turns[i][2] == "assistant"]
            assert r.formatted.count("<s>") == r.n_turns


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/\\sINTSY ", max_size=25), min_size=30, max_size=60))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts + PIECES], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_long_turns_keep_to_the_budget(spark):
    """Turns of 1,400 tokens: none exceeds the budget, so no window does."""
    rows = [(1, t, "system" if t == 0 else "user", "x" * (80 if t == 0 else 5568)) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.windows(df).collect()
    assert len(got) == 8 and all(len(r.formatted) / 4 <= 2048 + 20 for r in got)


def test_long_texts_and_turns_without_a_number(spark):
    rows = [(1, None, "user", "y" * 3_000_000), (1, None, "assistant", "z"), (2, 10 ** 12, "assistant", "é" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.windows(df)).collect()
    assert sorted((r.conv_id, t.role, len(t.text)) for r in read for t in r.turns) == [
        (1, "assistant", 1), (1, "user", 3_000_000), (2, "assistant", 9000)]
    assert [r.targets for r in read if r.conv_id == 2] == [["é" * 9000]]


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(df)).collect() == []
