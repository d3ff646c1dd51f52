"""Packing: every id once, limits kept, little padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.packing import Encoder, Limits, _Packer, pack
from lexweave.llm.queries import default_encoder

tokenizers = pytest.importorskip("tokenizers")


def check(rows, ids_of, limits):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence, offset, loss)."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[0]].append(r)
        bins[r[5]].append(r)
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        at, ids = 0, ids_of[doc]
        for r in sorted(own, key=lambda r: r[1]):
            assert r[1] == at and r[2] > 0 and r[4] == len(ids)
            assert r[3] == zlib.crc32(np.asarray(ids[at : at + r[2]], dtype="<u4").tobytes())
            at += r[2]
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r[7] for r in own) <= limits.loss
    return bins


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), min_size=1, max_size=60),
    st.sampled_from([Limits(64, 256, 64), Limits(64, 3, 64), Limits(64, 8, 40), Limits(16, 2, 5)]),
)
def test_packer(docs, limits):
    packer, ids_of = _Packer(limits, 4, 7), {}
    for k, (n, prompt) in enumerate(docs):
        ids_of[k] = np.arange(n, dtype=np.uint32) + 1000 * k
        packer.add(k, ids_of[k], min(prompt, n))
        if len(packer.items) > 20:
            packer.place(5)
    packer.place(0)
    check(packer.out, ids_of, limits)


def test_full_bins_when_only_tokens_bind():
    packer, rng = _Packer(Limits(1024, 256, 1024), 16, 0), np.random.default_rng(3)
    for k in range(500):
        packer.add(k, np.arange(rng.integers(1, 3000), dtype=np.uint32), 0)
    packer.place(0)
    bins = defaultdict(int)
    for r in packer.out:
        bins[r[5]] += r[2]
    assert sum(bins.values()) / (1024 * len(bins)) > 0.99


def rows_of(frame):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    return [tuple(r[n] for n in names) for r in frame.collect()]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    enc = default_encoder()
    slow = Encoder(enc.path).load()
    ids_of = {r["doc_id"]: [*slow(r["text"] or "").tolist(), 0] for r in docs.collect()}
    bins = check(rows_of(pack(docs, enc)), ids_of, Limits())
    assert sum(map(len, ids_of.values())) / (1024 * len(bins)) > 0.98


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "one", 5), (3, "same", 5), (3, "same", 5), (4, "word " * 9000, 5), (5, "法 emoji 😀 <|endoftext|> x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = rows_of(pack(docs, default_encoder()))
    assert sorted(r[2] for r in got if r[0] in (1, 2)) == [1, 1]
    assert len([r for r in got if r[0] == 3]) == 2 and len([r for r in got if r[0] is None]) == 1
    assert sum(r[2] for r in got if r[0] == 4) == [r[4] for r in got if r[0] == 4][0]
    assert pack(docs.limit(0), default_encoder()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=80))
def test_fast_encoder_equals_tokenizers(text):
    enc = default_encoder()
    if not hasattr(test_fast_encoder_equals_tokenizers, "both"):
        test_fast_encoder_equals_tokenizers.both = enc.load(), Encoder(enc.path).load()
    fast, slow = test_fast_encoder_equals_tokenizers.both
    assert fast(text).tolist() == slow(text).tolist()


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 3), (2, "x", 0)], "doc_id long, text string, prompt long")
    got = {r[0]: r for r in rows_of(pack(docs, default_encoder(), prompt_col="prompt"))}
    assert got[1][7] == got[1][2] - 3 and got[2][7] == got[2][2]
