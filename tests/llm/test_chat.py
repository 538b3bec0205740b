"""Chat snapshots against plain prefix comparison."""

import random

import pytest

from affinium.llm import chat
from affinium.llm.chat import format_chats
from affinium.llm.queries import QUERIES


def brute(rows, block):
    talks = {}
    for conv, turn, role, text in set(rows):
        content = (role or "unknown", text or "")
        talks.setdefault(conv, set()).add((turn is not None, turn or 0, content))
    return talks


def expected(rows, block):
    """Rendered maximal conversations; turns of equal number are not ordered here, so tests avoid them."""
    talks = {c: tuple(x for _, _, x in sorted(t, key=lambda x: x[:2])) for c, t in brute(rows, block).items()}
    groups = {}
    for conv, turns in talks.items():
        groups.setdefault(turns, []).append(conv)
    out = []
    for turns, convs in groups.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in groups):
            conv = None if None in convs else min(convs)
            for part in range(0, len(turns), block):
                text = "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns[part : part + block])
                out.append((conv, len(turns), len(convs), part // block, text))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 1024])
def test_snapshots(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rng = random.Random(block)
    rows, conv = [], 0
    for _ in range(12):
        talk = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", ""])) for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(1, 6)):
            base, step = rng.randint(-5, 5), rng.choice([1, 2, 700])
            cut = rng.randint(1, len(talk))
            rows += [(conv, base + step * i, *t) for i, t in enumerate(talk[:cut])]
            conv += 1
    rows += [rows[0], rows[0], (None, 0, "user", "a"), (None, 1, None, None), (900, None, "user", "a"), (900, 5, None, "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    assert sorted(map(tuple, format_chats(df).collect()), key=str) == expected(rows, block)


def test_query(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op6_chat_snapshots"](spark, tables)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 1024)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "ArrowEval", "Pandas", "MapInArrow", "NestedLoop", "Cartesian"))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(df).collect() == []
