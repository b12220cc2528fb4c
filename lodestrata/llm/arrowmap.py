"""Columns computed from whole texts, beside a table's own columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textscan as ts

_KINDS = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def with_text_columns(df: DataFrame, text_col: str, make: Callable, added: dict[str, str], keep_text: bool = True) -> DataFrame:
    """df with columns `added` (name to type), which make(bytes, offsets) returns as a tuple of arrays for a group of whole texts; null counts as empty.

    Names must not clash: callers take names that start with an underscore and rename them at the end.
    """
    kept = [f for f in df.schema if keep_text or f.name != text_col]
    taken = {f.name for f in df.schema} & set(added)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in added.items()))])
    kinds = [_KINDS[v] for v in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = ts.raw(batch.column(text_col))
            parts = [make(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in ts.groups(off)]
            if not parts:
                continue
            columns = [pa.array(np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for y in x for v in y], k) for x, k in zip(zip(*parts, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, [f.name for f in schema])

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
