"""Packing of token sequences by best fit decreasing.

Documents are tokenised where they lie; an overlong document is cut into full windows and a rest. Pieces
are dealt over groups by a hash of their numbers, and each group is packed by itself: pieces in decreasing length, each
into the tightest open window it fits, which a segment tree indexed by remaining capacity finds in
log2(window) steps. A group holds many thousand pieces, so the windows that stay partly empty are a
small share of its windows, and no group grows with the corpus: there are more groups.

Null text is empty (the closing id only). Null and repeated ids: each row is packed for itself. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import scratch, tokens
from lodestrata.llm import textscan as ts

#: Pieces of a packing group; a sequence's id is its group's number times this plus its place there.
GROUP_PIECES = 65_536
GROUP_IDS = 1 << 32


class TightestFit:
    """A segment tree over remaining capacities 0..size: how many open windows have each; finds the least capacity that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of a tightest open window with room for need; it is no longer open."""
        i, tree = self.leaves + need, self.tree
        while not tree[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._count(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; lengths from 1 to size."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fit, opened = TightestFit(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = fit.take(need)
        if found is None:
            capacity, w = size, opened
            opened += 1
        else:
            capacity, w = found
        window[i], offset[i] = w, size - capacity
        if capacity > need:
            fit.put(capacity - need, w)
    return window, offset


def pieces(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of at most size ids."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.cache(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            buf, off = ts.raw(batch.column("text"))
            for lo, hi in ts.groups(off):
                ids, at = cache.encode(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = np.diff(at) + 1
                per = -(-n // size)
                doc = np.repeat(np.arange(hi - lo), per)
                start = ts.spread(np.zeros(hi - lo, np.int64), per) * size
                length = np.minimum(n[doc] - start, size)
                crc = np.empty(len(doc), np.int64)
                for k, (d, s, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
                    a = at[d] + s
                    closing = s + m == n[d]
                    c = zlib.crc32(ids[a : a + m - closing].astype("<u4").tobytes())
                    crc[k] = zlib.crc32(end.astype("<u4").tobytes(), c) if closing else c
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), *(pa.array(x) for x in (start, length, crc, n[doc]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of docs with sequence_id and offset there; sequence ids are unique, not consecutive."""
    cut = pieces(docs, tokenizer_path, size, end_id, id_col, text_col)
    names, types = cut.columns, [f.dataType.simpleString() for f in cut.schema]
    # pieces are numbered, so that equal ones are dealt over groups as others are
    cut = scratch.keep(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = scratch.parts_for(cut.count(), group_pieces)

    def place(table: pa.Table) -> pa.Table:
        # the order of rows that a shuffle brings is not fixed; the packing is
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "length", "piece")])
        window, offset = best_fit_decreasing(table.column("length").to_numpy(), size)
        base = int(table.column("packing_group")[0].as_py()) * GROUP_IDS
        return table.select(names).append_column("sequence_id", pa.array(window + base)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)) + ", sequence_id long, offset long"
    return cut.withColumn("packing_group", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("packing_group").applyInArrow(place, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.default_path(), size=2048, end_id=1)


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
