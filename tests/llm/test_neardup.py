"""Near-duplicates against exact set comparison."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from lexweave.llm import neardup

SCHEMA = "doc_id long, text string, class string"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expect(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[find(b)] = find(a)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), low.get(find(k)), r[0] == low.get(find(k))) for k, r in enumerate(rows)), key=str)


def run(spark, rows, settings=None, **more):
    got = neardup.components(spark.createDataFrame(rows, SCHEMA), settings or neardup.Settings(**more)).collect()
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
    return text


def test_edge_rows(spark):
    a = "a b c d e f g"
    rows = [
        (5, a, "x"), (3, a.upper(), "x"), (9, a.replace(" ", "\t\n"), "x"), (1, None, "x"), (2, "", "x"), (4, " \n ", "x"), (6, "one two", "x"), (7, "ONE two ", "x"),
        (8, "one", "x"), (None, a, "x"), (None, "alone here", "x"), (None, None, "x"), (5, "other words entirely here now", "x"), (5, a, "x"), (10, "  x y z w v", "x"),
    ]
    assert run(spark, rows) == expect(rows)
    assert run(spark, rows[:0]) == []


@pytest.mark.parametrize("block", [384, 5])
def test_families_with_small_and_large_blocks(spark, block):
    rng, rows = random.Random(4), []
    for family in range(6):
        base = words(rng, 200)
        for _ in range(25):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(0, 9))), "x"))
    shared = words(rng, 60)
    rows += [(len(rows) + k, " ".join(shared + words(rng, 60)), "x") for k in range(20)]
    rng.shuffle(rows)
    assert run(spark, rows, block=block, broadcast_ids=0 if block == 5 else 1000) == expect(rows)


def test_long_chain_becomes_one_component(spark):
    rng = random.Random(2)
    text, rows = words(rng, 300), []
    for k in range(40):
        rows.append((40 - k, " ".join(text), "x"))
        text = edited(rng, text, 3)
    want = expect(rows)
    assert run(spark, rows) == want and len({w[2] for w in want}) == 1


def test_lower_threshold_settings(spark):
    rng = random.Random(7)
    base, rows = words(rng, 200), []
    for n in (0, 2, 4, 5, 6, 30):
        rows.append((n, " ".join(edited(rng, base, n)), "x"))
    settings = neardup.Settings(percent=80, bands=25, rows=5, bands_per_batch=5)
    assert run(spark, rows, settings) == expect(rows, 80)


def test_recall_at_and_above_the_threshold(spark):
    """Chance of losing one pair, from the bounds themselves, and a measured recall."""
    for s in (neardup.Settings(), neardup.Settings(percent=80, bands=25, rows=5, bands_per_batch=5)):
        t = s.percent / 100
        least = neardup.pruning(s)
        assert neardup.lost(s, least, t) <= s.miss and (1 - t**s.rows) ** s.bands <= 1e-4
        losses = [neardup.lost(s, least, t + x) for x in (0.0, 0.02, 0.05, 0.1)]
        assert losses == sorted(losses, reverse=True)
        # looser by one step of the bound would lose more than allowed, or prunes no less
        assert all(m > 0 for m in least)
    assert neardup.pruning(neardup.EXACT) == (0,)
    rng, rows = random.Random(11), []
    for _ in range(150):  # pairs of 200 words; an edit removes five of about 196 shingles
        base = words(rng, 200)
        for text in (base, edited(rng, base, rng.choice((1, 2, 3, 4)))):
            rows.append((len(rows), " ".join(text), "x"))
    want = expect(rows)
    got = run(spark, rows)
    linked = lambda out: {r[0] for r in out if r[2] != r[0]}
    assert len(linked(want)) > 60 and len(linked(got) & linked(want)) >= 0.99 * len(linked(want)) and linked(got) <= linked(want)
    assert run(spark, rows, neardup.EXACT) == want


def test_large_family_and_outsiders(spark):
    """More copies than a block: representatives connect most, blocks the rest."""
    rng, rows = random.Random(21), []
    base = words(rng, 150)
    for k in range(120):
        rows.append((len(rows), " ".join(edited(rng, base, k % 4)), "x"))
    far = edited(rng, base, 9)
    for k in range(12):
        rows.append((len(rows), " ".join(edited(rng, far, k % 3)), "x"))
    rows.append((len(rows), " ".join(f"w{k}" for k in range(30_000)), "x"))  # a very long text and its near copy
    rows.append((len(rows), " ".join(f"w{k}" for k in range(29_500)), "x"))
    want = expect(rows)
    for more in ({"block": 7, "broadcast_ids": 0}, {"block": 400, "block_shingles": 2000}):
        assert run(spark, rows, **more) == want


def test_joins_deal_hot_keys(spark, monkeypatch):
    from lexweave.llm import spread

    monkeypatch.setattr(spread, "LEAST_ROWS", 8)
    many = spark.createDataFrame([(k if k < 10 else 99, k) for k in range(200)] + [(None, 1)], "key long, v long")
    one = spark.createDataFrame([(99, "hot"), (3, "cold"), (3, "twice"), (500, "none")], "key long, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, spread.spread_join(many, one, "key", how).collect()))
        assert got == sorted(map(str, many.join(one, "key", how).collect()))
    rng, rows = random.Random(4), []
    base = words(rng, 120)
    for _ in range(60):
        rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(0, 6))), "x"))
    rows += [(1000 + k, "the same words again and again", "x") for k in range(40)]
    assert run(spark, rows, block=9, broadcast_ids=0) == expect(rows)


def test_posterior_bound():
    scipy_like = neardup.least_matches
    rng = np.random.default_rng(0)
    for n in (42, 84, 126):
        m = scipy_like(n, 85, 1e-3)
        hits = rng.beta(m + 1, n - m + 1, 200_000)
        below = rng.beta(m, n - m + 2, 200_000)
        assert (hits >= 0.85).mean() >= 0.8e-3 and (below >= 0.85).mean() <= 1.2e-3


def test_connect(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (3, 9)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.connect(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert neardup.connect(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "z", "x"), (1, "a b c d e f", "x"), (4, None, "x")]
    got = neardup.deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "class"]
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
