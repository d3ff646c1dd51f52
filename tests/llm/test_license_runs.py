"""Notices that span several pieces of a longer text, against a loop over all runs."""

from __future__ import annotations

import re
import textwrap

from test_licenses import ROWS, expect, run

from lexweave.llm import licenses

MIT, ISC = licenses.TEMPLATES[-1][1], licenses.TEMPLATES[-2][1]


def words(text):
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split()


def pairs(ws):
    return list(zip(ws, ws[1:]))


def runs(rows, templates=licenses.TEMPLATES, least=0.8):
    out = set()
    for doc, text in {r[:2] for r in rows if r[1] is not None}:
        raw = re.split(licenses.SENTENCE_END, text)
        pieces = [words(p) for p in raw]
        full = [k for k, p in enumerate(pieces) if p]
        best = {}
        for name, body in templates:
            of = set(pairs(words(body)))
            high = int((2 - least) / least * len(of) + 1e-9)
            at = [(k, w) for k, p in enumerate(pieces) for w in p]
            hit = [(a, b) for (a, x), (b, y) in zip(at, at[1:]) if (x, y) in of]
            for i in {a for a, _ in hit}:
                for j in {b for a, b in hit if a >= i}:
                    own = pairs([w for p in pieces[i : j + 1] for w in p])
                    if not own or len(own) > high:
                        continue
                    dice = 2 * len(set(own) & of) / (len(set(own)) + len(of))
                    if dice >= least - 1e-12:
                        best[i, j] = min(best.get((i, j), (0, "")), (-dice, name))
        spans = []
        for (i, j), (less, name) in best.items():
            spans.append((0 if (i, j) == (full[0], full[-1]) else 1 if i == j else 2, less, j - i, i, j, name))
        kept = []
        for x in sorted(spans):
            if not any(y[3] <= x[4] and y[4] >= x[3] and (y[0] == 2 or y[5] == x[5]) for y in kept):
                kept.append(x)
        out |= {(doc, i, "\n".join(raw[i : j + 1]), name, round(-less, 9)) for kind, less, _, i, j, name in kept if kind == 2}
    return out


def wrapped(text, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, 70))


CODE = "\n".join(f"def step_{k}(x):\n    return x + {k}" for k in range(200))
PROSE = "It was a long day. The software was sold without limitation! Nobody asked for permission. " * 60
LONG = [
    (1, wrapped(MIT, " * ") + "\n" + CODE, "x", 1),
    (2, CODE + "\n# " + wrapped(ISC, "# ") + "\n\n" + CODE, "x", 1),
    (3, PROSE + wrapped(ISC) + "\n" + PROSE + wrapped(MIT) + "\n" + PROSE, "x", 1),
    (4, PROSE + "Released under the\nMIT License.\n" + PROSE, "x", 1),
    (5, PROSE + "Released under the MIT License.\nThanks.\n" + PROSE, "x", 1),
    (6, PROSE + "This work is licensed under the GNU General\nPublic License, version 2.\n" + PROSE, "x", 1),
    (None, wrapped(ISC) + "\n" + PROSE, "x", 1),
    (8, PROSE, "x", 1),
    (9, wrapped(MIT) + "\n" + wrapped(MIT) + "\n" + CODE, "x", 1),
    (9, wrapped(MIT) + "\n" + wrapped(MIT) + "\n" + CODE, "x", 1),
]


def test_wrapped_notices_in_longer_texts(spark):
    got = run(spark, LONG)
    assert got == expect(LONG) | runs(LONG)
    names = [(r[0], r[3]) for r in got if r[1] >= 0]
    for k, name in ((1, "MIT"), (2, "ISC"), (3, "MIT"), (3, "ISC"), (4, "MIT"), (6, "GPL-2.0-only"), (None, "ISC")):
        assert names.count((k, name)) == 1
    assert names.count((9, "MIT")) == 2
    assert not any(r[0] == 8 for r in got)


def test_without_broadcast_and_with_other_thresholds(spark):
    for least in (0.8, 0.6):
        for more in ({"broadcast_rows": 0}, {"most_listed": 0}):
            assert run(spark, LONG, least=least, **more) == expect(LONG, least=least) | runs(LONG, least=least)


def test_cases_of_single_units(spark):
    assert run(spark, ROWS) == expect(ROWS) | runs(ROWS)
