"""Vector bin packing of tokenised documents (operator 2).

Every document is tokenised and closed with an end id.  Whole sequences are cut
off long documents; the remaining pieces are items with a demand vector
(tokens, segments, loss-bearing tokens) and are placed in bins of fixed
capacity by the dot-product heuristic: an open bin takes the fitting item whose
demand has the largest dot product with the bin's remaining capacity.  When no
whole item fits and enough room is left, the item with the largest dot product
is cut to the room.

The packer runs inside the input partitions (no shuffle at all); it holds at
most ``buffer`` items, whatever the partition's size.  Every piece is written
by one task attempt from one reading of its rows, so a lost executor only
costs a rerun of its tasks.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each on their own; a null id stays null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import release

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_GONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Limits:
    """Capacity of one sequence in each dimension."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


@dataclass(frozen=True)
class Encoder:
    """Token ids of texts, by the vocabulary file ``path`` of ``tokenizers``.

    ``ranks`` may name the same vocabulary as a rank file.  Texts made of ASCII
    and Latin letters then go through the faster rank encoder, which gives the
    same ids there (see tests); all other texts, and those with a special
    token's string, go through ``tokenizers`` itself.
    """

    path: str
    ranks: str | None = None
    pattern: str | None = None
    end_id: int = 0

    def load(self) -> Callable[[str], np.ndarray]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        exact = None  # loaded when the first text needs it

        def slow(text: str) -> np.ndarray:
            nonlocal exact
            if exact is None:
                from tokenizers import Tokenizer

                exact = Tokenizer.from_file(self.path)
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        if self.ranks is None:
            return slow
        import base64
        import json
        import re

        import tiktoken

        with open(self.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        # ASCII without control characters but \t \n \r, and the Latin letters
        # of Latin-1 and Latin Extended-A; no special token has any other form.
        plain = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ſ]*").fullmatch
        with open(self.path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]

        def either(text: str) -> np.ndarray:
            if plain(text) and not any(s in text for s in special):
                return quick.encode_to_numpy(text).astype(np.uint32)
            return slow(text)

        return either


@dataclass
class _Packer:
    limits: Limits
    min_fragment: int
    first_id: int
    out: list = field(default_factory=list)
    items: list = field(default_factory=list)
    made: int = 0

    def emit(self, item: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total, loss = item
        self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, loss))

    def sequence(self) -> int:
        self.made += 1
        return self.first_id + self.made - 1

    def add(self, doc, ids: np.ndarray, prompt: int) -> None:
        """Cut whole sequences off a document; keep the rest as an item."""
        lim, total, start = self.limits, len(ids), 0
        while start < total:
            length = min(lim.tokens, total - start, max(prompt - start, 0) + lim.loss)
            loss = max(0, start + length - max(start, prompt))
            item = (doc, start, ids[start : start + length], total, loss)
            if length == lim.tokens:
                self.emit(item, self.sequence(), 0)
            else:
                self.items.append((doc, start, item[2].copy(), total, loss))
            start += length

    def place(self, keep: int) -> None:
        """Fill bins until at most ``keep`` items are left over."""
        lim, items = self.limits, self.items
        tokens = np.array([len(x[2]) for x in items], dtype=np.int64)
        loss = np.array([x[4] for x in items], dtype=np.int64)
        left = len(items)
        while left > keep:
            sequence, offset, seg, room, room_loss = self.sequence(), 0, lim.segments, lim.tokens, lim.loss
            while seg and room and left:
                score = tokens * (room / lim.tokens**2) + loss * (room_loss / lim.loss**2) + seg / lim.segments**2
                score[(tokens > room) | (loss > room_loss)] = -1.0
                best = int(np.argmax(score))
                if score[best] < 0:
                    best, taken = self.cut(tokens, loss, room, room_loss)
                    if best < 0:
                        break
                    self.emit(taken, sequence, offset)
                    room, offset, seg, room_loss = room - len(taken[2]), offset + len(taken[2]), seg - 1, room_loss - taken[4]
                    continue
                self.emit(items[best], sequence, offset)
                room, offset, seg, room_loss = room - int(tokens[best]), offset + int(tokens[best]), seg - 1, room_loss - int(loss[best])
                tokens[best], items[best], left = _GONE, None, left - 1
        self.items = [x for x in items if x is not None]

    def cut(self, tokens: np.ndarray, loss: np.ndarray, room: int, room_loss: int) -> tuple[int, tuple | None]:
        """Cut the item with the largest dot product to the room that is left."""
        if room < self.min_fragment:
            return -1, None
        live = tokens < _GONE
        demand = np.minimum(tokens, room) * (room / self.limits.tokens**2) + np.minimum(loss, room_loss) * (room_loss / self.limits.loss**2)
        best = int(np.argmax(np.where(live & (tokens >= self.min_fragment), demand, -1.0)))
        if not live[best] or tokens[best] < self.min_fragment:
            return -1, None
        doc, start, ids, total, lost = self.items[best]
        quiet = len(ids) - lost  # the loss-bearing tokens come last
        n = min(room, len(ids) - 1, quiet + room_loss)
        if n < self.min_fragment:
            return -1, None
        head = max(0, n - quiet)
        self.items[best] = (doc, start + n, ids[n:].copy(), total, lost - head)
        tokens[best], loss[best] = len(ids) - n, lost - head
        return best, (doc, start, ids[:n], total, head)

    def flush(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _pack(batches: Iterator[pa.RecordBatch], encoder: Encoder, limits: Limits, min_fragment: int, buffer: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder.load(), np.array([encoder.end_id], dtype=np.uint32)
    packer = _Packer(limits, min_fragment, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
    for batch in batches:
        docs, prompts = batch["id"].to_pylist(), batch["prompt"].to_pylist()
        for k, doc in enumerate(docs):
            packer.add(doc, np.concatenate([encode(batch["text"][k].as_py() or ""), end]), prompts[k] or 0)
            if len(packer.items) >= buffer:
                packer.place(buffer // 4)
            if len(packer.out) >= 20_000:
                yield packer.flush()
        del batch
        release()
    packer.place(0)
    yield packer.flush()
    del packer, encode
    release()


def pack(
    docs: DataFrame,
    encoder: Encoder,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    min_fragment: int = 16,
    buffer: int = 2048,
) -> DataFrame:
    """Pieces of all documents with the sequence and offset they are placed at.

    ``prompt_col`` counts a document's leading tokens that bear no loss (none
    when it isn't given).  No piece is cut shorter than ``min_fragment`` ids
    from the front of an item, so up to that many ids of a sequence may be
    padding, besides the one unfilled sequence at the end of each partition.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        (F.col(prompt_col) if prompt_col else F.lit(0)).cast("long").alias("prompt"),
    )
    return rows.mapInArrow(partial(_pack, encoder=encoder, limits=limits, min_fragment=min_fragment, buffer=buffer), PIECES)
