"""Python functions over Arrow batches that keep the rows they judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordhash import release

#: From a batch of texts to the judged columns, row by row.
Judge = Callable[[pa.Array], list[pa.Array]]


def _apply(batches: Iterator[pa.RecordBatch], make: Callable[[], Judge], text: str | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    judge = make()
    for batch in batches:
        if batch.num_rows:
            texts = batch["text"] if text is None else batch["row"].field(text)
            yield pa.RecordBatch.from_arrays([batch["row"], *judge(texts)], names=["row", *names])
            del batch, texts
            release()


def judged(rows: DataFrame, text: str, make: Callable[[], Judge], schema: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the input row as a struct, or its columns ``keep``) and
    those of ``schema``.

    As the row is a struct, its columns cannot clash with the judged ones; a text
    that is kept is sent to Python once.  ``make`` is called once per partition
    and may load models there.
    """
    out = T.StructType.fromDDL(schema)
    kept = rows if keep is None else rows.select(*keep)
    inside = text in kept.columns
    full = T.StructType([T.StructField("row", kept.schema, True), *out.fields])
    packed = rows.select(F.struct(*kept.columns).alias("row"), *([] if inside else [F.col(text).alias("text")]))
    return packed.mapInArrow(partial(_apply, make=make, text=text if inside else None, names=out.fieldNames()), full)
