"""Rows of a Spark frame against rows of SQL, in no order."""

from __future__ import annotations


def _text(x) -> str:
    if x is None or x != x:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return repr([_text(y) for y in x])
    return str(x)


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_text(r[k]) for k in order) for r in rows)


def assert_same(frame, duck, sql: str) -> int:
    rows = frame.collect()
    want = duck.sql(sql)
    assert sorted(frame.columns) == sorted(want.columns)
    got = canonical(frame.columns, rows)
    assert got == canonical(want.columns, want.fetchall())
    return len(got)
