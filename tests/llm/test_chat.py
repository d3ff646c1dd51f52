"""Snapshot collapse against list prefixes."""

from __future__ import annotations

import random

from lexweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def expect(rows):
    convs = {}
    for c, t, r, x in {r[:4] for r in rows if r[0] is not None}:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    lists = {c: tuple(x[2:] for x in sorted(v)) for c, v in convs.items()}
    kept = {}
    for c, v in sorted(lists.items()):
        if not any(len(w) > len(v) and w[: len(v)] == v for w in lists.values()):
            kept.setdefault(v, c)
    return {c: len(v) for v, c in kept.items()}


def run(spark, rows, **settings):
    got = chat.collapse(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    out = {}
    for r in got:
        out.setdefault(r["conv_id"], []).append((r["position"], r["rendered"]))
        assert r["n_turns"] >= r["position"]
    for v in out.values():
        assert sorted(p for p, _ in v) == list(range(1, len(v) + 1))
    return {c: len(v) for c, v in out.items()}


def test_prefixes_go(spark):
    a = [(1, k, "user", f"t{k}", "x") for k in range(3)]
    rows = a + [(2, k, "user", f"t{k}", "x") for k in range(5)] + [(3, k + 10, "user", f"t{k}", "x") for k in range(5)] + [(4, 0, "user", "t1", "x")]
    assert run(spark, rows) == expect(rows) == {2: 5, 4: 1}


def test_nulls_repeats_and_ties(spark):
    rows = [
        (1, 0, None, "a", "x"), (2, 0, "unknown", "a", "x"), (3, None, "user", "a", "x"), (3, 0, "user", None, "x"), (4, 0, "user", "", "x"),
        (None, 0, "user", "a", "x"), (5, 0, "user", "a", "x"), (5, 0, "user", "a", "x"), (5, 0, "user", "b", "x"), (6, 0, "user", "a", "x"),
    ]
    assert run(spark, rows) == expect(rows)
    assert run(spark, rows[:0] + []) == {}


def test_random_logs_and_small_chunks(spark):
    rng, rows = random.Random(1), []
    for c in range(120):
        n = rng.randint(1, 9)
        first = rng.choice("ab")
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", first if k < rng.randint(2, 9) else rng.choice("xy"), "p") for k in range(n)]
    rows += [(999, k, "user", "a" if k < 4 else str(k), "p") for k in range(700)]
    want = expect(rows)
    assert run(spark, rows) == want and run(spark, rows, chunk=2) == want


def test_rendering(spark):
    rows = [(1, 0, "user", "hi\nyou", "x"), (1, 1, "assistant", None, "x")]
    got = chat.collapse(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [r["rendered"] for r in got] == ["<|im_start|>user\nhi\nyou<|im_end|>\n", "<|im_start|>assistant\n<|im_end|>\n"]
    assert [r["bears_loss"] for r in got] == [False, True]


def test_no_python_in_the_plan(spark):
    rows = [(1, 0, "user", "a", "x")]
    plan = chat.collapse(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_turn_numbers_and_very_long_turns(spark, monkeypatch):
    """All rows of a conversation without a number, or with one; a long text; many chunks."""
    from lexweave.llm import spread

    monkeypatch.setattr(spread, "LEAST_ROWS", 16)
    rows = [(1, None, "user", f"t{k:03d}") for k in range(70)] + [(2, 5, "user", f"t{k:03d}") for k in range(70)]
    rows += [(3, k, "user", f"t{k}") for k in range(300)] + [(4, k, "user", f"t{k}") for k in range(299)]
    rows += [(5, 0, "user", "long " * 200_000), (6, -3, "user", "a"), (6, None, "user", "b"), (6, 1 << 40, None, None), (1, None, "user", "t000")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.collapse(frame, chunk=4).collect()
    assert {r["conv_id"] for r in got} == {1, 3, 5, 6}  # 2 equals 1, 4 begins 3
    by = {(r["conv_id"], r["position"]): r for r in got}
    assert len(by) == len(got) == 70 + 300 + 1 + 3
    assert all(by[1, k + 1]["rendered"].endswith(f"t{k:03d}<|im_end|>\n") and by[1, k + 1]["copies"] == 2 for k in range(70))
    assert all(f"\nt{k}<" in by[3, k + 1]["rendered"] for k in range(300))
    assert [by[6, k]["rendered"].split("\n")[1][:1] for k in (1, 2, 3)] == ["b", "a", "<"] and len(by[5, 1]["rendered"]) > 10**6
