import random

import pytest

from quillspark.llm import chat


def brute_force(rows):
    chats = {}
    for conv, turn, role, text in {*rows}:
        if conv is not None:
            chats.setdefault(conv, []).append((turn is None, turn or 0, "unknown" if role is None else role, text or ""))
    chats = {c: [t[2:] for t in sorted(own)] for c, own in chats.items()}
    out = []
    for c, own in chats.items():
        if any(d != c and other[: len(own)] == own and (len(other) > len(own) or d < c) for d, other in chats.items()):
            continue
        at = 0
        for n, (role, text) in enumerate(own):
            piece = f"<|im_start|>{role}\n{text}<|im_end|>\n"
            out.append((c, len(own), n + 1, at, piece))
            at += len(piece)
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    out = []
    for conv in range(60):
        if conv % 3 and out:
            source = rng.randrange(conv)
            own = [r[1:] for r in out if r[0] == source]
            own = own[: rng.randint(1, len(own) + 1)]
        else:
            own = []
        if rng.random() < 0.6 or not own:
            own = own + [(len(own) + k, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok 🤖", "", None, "why?"])) for k in range(rng.randint(1, 6))]
        out += [(conv, *t) for t in own]
    return out + out[:5] + [(None, 0, "user", "x"), (70, None, "user", "a"), (70, None, "user", "b"), (70, 3, "user", "c"), (71, 5, "user", "c")]


@pytest.mark.parametrize("seed,block", [(0, 1024), (1, 2)])
def test_render_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    own = rows(seed)
    df = spark.createDataFrame(own, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "text AS rendered").repartition(3)
    assert sorted(map(tuple, chat.render(df).collect())) == brute_force(own)


def test_empty_table(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_and_sums_that_wrap(spark, monkeypatch):
    """Many blocks, wide turn numbers, copies and prefixes; sums modulo a small number tell chats apart only by all of them."""
    monkeypatch.setattr(chat, "BLOCK_TURNS", 8)
    own = [(1, t * 3, "user", f"t{t}") for t in range(300)] + [(2, t, "user", f"t{t}") for t in range(300)] + [(3, t, "user", f"t{t}") for t in range(120)]
    own += [(4, -5, "user", "t0"), (5, 2**62, "user", "t0"), (6, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(own, "conv_id long, turn long, role string, text string").repartition(5)
    assert sorted(map(tuple, chat.render(df).collect())) == brute_force(own)


def test_texts_are_dealt_out_once(spark):
    """One exchange holds the texts, and all others but narrow ones read it again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = chat.render(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    texts = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x and "ReusedExchange" not in x]
    by_column = [x for x in texts if "REPARTITION_BY_COL" in x]
    assert len(by_column) == 1, plan
    assert plan.count("ReusedExchange") >= 2, plan
    assert "Python" not in plan and "Arrow" not in plan
