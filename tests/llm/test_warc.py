"""WARC: exact round trips, revisits, segments, framing, damage."""

from __future__ import annotations

import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 50), st.integers(40, 200))
def test_records_survive(payload, chunk, segment):
    assert warc.dechunked(warc.chunked(payload, chunk)) == payload
    records = b"".join(r + b"\r\n" for r in warc.records_of(1, "http://x", payload, None, False, segment, chunk))
    found = list(warc.parse(records))
    block = b"".join(b for _, b in found)
    assert warc.http_payload(block) == payload
    assert all(len(b) <= segment for _, b in found)
    if len(found) > 1:
        assert int(found[-1][0]["warc-segment-total-length"]) == len(block)


def run(spark, rows, **settings):
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    assert all(r["problem"] is None for r in got)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str)


ROWS = [
    (1, "http://a", "dup", "c"), (2, "http://b\r\nX: y", "dup", "c"), (3, None, "dup", "c"), (4, "u", None, "c"), (None, "x", "", "c"),
    (5, "u", "é" * 5000, "c"), (5, "u", "é" * 5000, "c"), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nWARC/1.1", "c"), (7, "u", "\r\n" * 50, "c"),
]
WANT = [
    (1, 3, b32("dup"), "revisit", 3), (2, 3, b32("dup"), "revisit", 3), (3, 3, b32("dup"), "response", None), (4, 0, b32(""), "response", None),
    (None, 0, b32(""), "revisit", 4), (5, 10000, b32("é" * 5000), "response", None), (5, 10000, b32("é" * 5000), "response", None),
    (6, len(ROWS[7][2]), b32(ROWS[7][2]), "response", None), (7, 100, b32("\r\n" * 50), "response", None),
]


@pytest.mark.parametrize("settings", [{}, {"segment_bytes": 300, "chunk_bytes": 64}, {"broadcast_rows": 0}, {"records_per_file": 1}], ids=str)
def test_round_trip(spark, settings):
    assert run(spark, ROWS, **settings) == sorted(WANT, key=str)


def test_small_payloads_may_stay_responses(spark):
    got = run(spark, ROWS[:5], least_bytes=4)
    assert {r[3] for r in got} == {"response"}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_full_payloads_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(ROWS, SCHEMA), path, segment_bytes=200)
    got = warc.read(spark, path).where("record_type = 'response'")
    assert {bytes(r["payload"]) for r in got.collect()} == {(r[2] or "").encode() for r in ROWS}


def test_damage_is_reported(spark):
    parts = list(warc.records_of(1, "u", b"x" * 1000, None, False, 300, 100))
    rows = [warc._row(*next(iter(warc.parse(p + b"\r\n"))), True) for p in parts]
    lost = [r for k, r in enumerate(rows) if k != 1]
    frame = spark.createDataFrame(lost, warc.RECORDS)
    origin = F.coalesce("origin_id", "record_id")
    groups = frame.groupBy(origin.alias("origin")).agg(
        F.max("target_uri").alias("target_uri"), F.max("stated_digest").alias("stated_digest"), F.max("total_length").alias("total_length"),
        F.collect_list(F.struct("segment", "block")).alias("parts"),
    )
    got = groups.mapInArrow(lambda b: warc._assemble(b, True), warc.RECORDS).collect()
    assert [r["problem"] for r in got] == ["a segment is missing"]
    assert warc._checked(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz", None)[3]
    assert warc._checked(b"HTTP/1.1 200 OK\r\n\r\nbody", "sha1:WRONG")[3] == "payload digest differs"
