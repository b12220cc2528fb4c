"""Sorted hashes as small blobs that meet by ranges of hashes, and text tables laid out in bounded groups of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import scratch
from lodestrata.llm import textscan as ts

#: Ranges of hashes, as bits, into which a group's hashes are dealt at most in one step.
STEP_BITS = 12


def dump(values: np.ndarray) -> bytes:
    """Ascending uint64 values: differences, byte by byte, compressed."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(d) else b""


def load(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Values of one type, byte by byte."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def member(h: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which of h are among sorted values."""
    if not len(sorted_values):
        return np.zeros(len(h), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)] == h


class Meeting:
    """Hashes of many groups meet in tasks that have all of a range of hashes, and answers go back to the groups.

    A packet is a row of ascending hashes, each with other values (`sent` or `answered` names and their numpy types). Ranges follow the number of
    hashes. Where they are many, a group doesn't send a packet to each: it deals its hashes into about the square root as many coarse ranges, tasks
    that have one of these from a block of groups deal them further, and answers take the same way back. So a group causes about 2**STEP_BITS packets at most, and packets hold about
    `each` / 2**STEP_BITS hashes at least, at any size.
    """

    SCHEMA = "range long, block long, grp long, n long, data binary"

    def __init__(self, hashes: int, groups: int, each: int, sent: dict[str, str], answered: dict[str, str] | None = None, step_bits: int | None = None):
        step = STEP_BITS if step_bits is None else step_bits
        self.bits = max(1, (max(1, -(-hashes // each)) - 1).bit_length())
        self.coarse = self.bits if self.bits <= step else -(-self.bits // 2)
        self.sent, self.answered = sent, answered or {}
        #: Groups of a block: those from which a task that deals further has about two `each` hashes.
        self.blocks = max(1, -(-groups // (2 << self.coarse))) if self.coarse < self.bits else 1

    def _pack(self, h: np.ndarray, others: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
        raw = planes(np.diff(h, prepend=np.uint64(0)).astype("<u8")) + b"".join(planes(others[k].astype(v)) for k, v in kinds.items())
        return pa.compress(raw, codec="zstd", asbytes=True)

    def _unpack(self, data: bytes, n: int, kinds: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        widths = [8, *(np.dtype(v).itemsize for v in kinds.values())]
        raw = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd", asbytes=True), np.uint8)
        parts = np.split(raw, np.cumsum(widths)[:-1] * n)
        values = [np.ascontiguousarray(p.reshape(w, n).T).view(t).ravel() for p, w, t in zip(parts, widths, ("<u8", *kinds.values()), strict=True)]
        return np.cumsum(values[0], dtype=np.uint64), dict(zip(kinds, values[1:], strict=True))

    def _rows(self, made: list[tuple]) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else [[]] * 5, kinds, strict=True)], ["range", "block", "grp", "n", "data"])

    def _dealt(self, h: np.ndarray, others: dict[str, np.ndarray], bits: int, block: int, grp: int | None, kinds: dict[str, str]) -> list[tuple]:
        """A packet for each range of hashes that has any; h ascends."""
        which = (h >> np.uint64(64 - bits)).astype(np.int64)
        new = np.flatnonzero(np.diff(which, prepend=-1))
        return [(int(which[x]), block, grp, y - x, self._pack(h[x:y], {k: v[x:y] for k, v in others.items()}, kinds)) for x, y in zip(new.tolist(), [*new[1:].tolist(), len(h)], strict=True)]

    def send(self, grp: int, h: np.ndarray, **others: np.ndarray) -> pa.Table:
        """A group's packets; h ascends."""
        block = int(ts.mix(np.array([grp], np.int64).view(ts.U))[0] % np.uint64(self.blocks))
        return self._rows(self._dealt(h, others, self.coarse, block, grp, self.sent))

    def none(self) -> pa.Table:
        return self._rows([])

    def _gather(self, table: pa.Table, kinds: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """(hashes, other values, group) of all packets of a table, one after another."""
        hashes, groups, others = [], [], {k: [] for k in kinds}
        for grp, n, data in zip(*(table.column(c).to_pylist() for c in ("grp", "n", "data")), strict=True):
            h, got = self._unpack(data, n, kinds if grp is not None else kinds | {"grp": "<i8"})
            hashes.append(h)
            groups.append(np.full(n, grp) if grp is not None else got["grp"])
            for k in kinds:
                others[k].append(got[k])
        return np.concatenate(hashes), {k: np.concatenate(v) for k, v in others.items()}, np.concatenate(groups)

    def met(self, packets: DataFrame, answer) -> DataFrame:
        """Packets for each group of what answer(hashes, other values) says of a whole range: (mask, answered values of those in it)."""
        if self.coarse < self.bits:

            def further(table: pa.Table) -> pa.Table:
                h, others, grp = self._gather(table, self.sent)
                order = np.argsort(h, kind="stable")
                more = {k: v[order] for k, v in others.items()} | {"grp": grp[order]}
                return self._rows(self._dealt(h[order], more, self.bits, table.column("block")[0].as_py(), None, self.sent | {"grp": "<i8"}))

            packets = packets.groupBy("range", "block").applyInArrow(further, self.SCHEMA)

        def meet(table: pa.Table) -> pa.Table:
            h, others, grp = self._gather(table, self.sent)
            mask, values = answer(h, others)
            place, blocks = 0, table.column("block").to_pylist()
            at = np.cumsum(mask) - mask  # a hash's place among those in the mask
            back: dict[int, list[np.ndarray]] = {}
            out = []
            for block, own, n in zip(blocks, table.column("grp").to_pylist(), table.column("n").to_pylist(), strict=True):
                mine = place + np.flatnonzero(mask[place : place + n])
                place += n
                if not len(mine):
                    continue
                if own is None:
                    back.setdefault(block, []).append(mine)
                else:
                    out.append((0, block, own, len(mine), self._pack(h[mine], {k: v[at[mine]] for k, v in values.items()}, self.answered)))
            own_range = table.column("range")[0].as_py() >> (self.bits - self.coarse)
            for block, parts in back.items():
                mine = np.concatenate(parts)
                mine = mine[np.argsort(h[mine], kind="stable")]
                out.append((own_range, block, None, len(mine), self._pack(h[mine], {k: v[at[mine]] for k, v in values.items()} | {"grp": grp[mine]}, self.answered | {"grp": "<i8"})))
            return self._rows(out)

        answers = packets.groupBy("range").applyInArrow(meet, self.SCHEMA)
        if self.coarse < self.bits:

            def home(table: pa.Table) -> pa.Table:
                h, others, grp = self._gather(table, self.answered)
                order = np.lexsort((h, grp))
                h, grp, others = h[order], grp[order], {k: v[order] for k, v in others.items()}
                new = np.flatnonzero(np.diff(grp, prepend=grp[:1] - 1))
                return self._rows([(0, 0, int(grp[x]), y - x, self._pack(h[x:y], {k: v[x:y] for k, v in others.items()}, self.answered)) for x, y in zip(new.tolist(), [*new[1:].tolist(), len(h)], strict=True)])

            answers = answers.groupBy("range", "block").applyInArrow(home, self.SCHEMA)
        return answers

    def answers(self, table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """A group's answers: hashes, ascending, and their values."""
        if not table.num_rows:
            return np.zeros(0, np.uint64), {k: np.zeros(0, v) for k, v in self.answered.items()}
        h, others, _ = self._gather(table, self.answered)
        order = np.argsort(h, kind="stable")
        return h[order], {k: v[order] for k, v in others.items()}


def in_order(table: pa.Table) -> pa.Table:
    """A group's rows by number; a shuffle or sort may have moved them."""
    row = table.column("row").to_numpy()
    return table if (row == np.arange(len(row))).all() else table.sort_by("row")


def grouped_table(docs: DataFrame, name: str, group_bytes: int, text_col: str = "text", total: int = 0) -> DataFrame:
    """docs written once with columns `grp` and `row`, bucketed by grp: a group is some rows of one task with about group_bytes of text, under 2**20 of them, which `row` numbers.

    Grouping or cogrouping it by `grp` later reads each group where it lies, without another shuffle of the texts.
    """
    spark = docs.sparkSession
    schema = docs.withColumns({"grp": F.lit(0).cast("long"), "row": F.lit(0)}).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, filled, rows = TaskContext.get().partitionId() << 20, 0, 0, 0
        for batch in batches:
            _, off = ts.raw(batch.column(text_col))
            off = off + 16 * np.arange(len(off))  # rows without text fill a group too
            number = seq + (filled + off[:-1]) // group_bytes
            new = np.flatnonzero(np.diff(number, prepend=seq))  # rows that begin a group
            begins = np.zeros(len(number), np.int64)
            begins[new] = new
            begins = np.maximum.accumulate(begins) if len(number) else begins
            row = np.arange(len(number)) - begins + np.where(number == seq, rows, 0)
            if len(number):
                rows = int(row[-1]) + 1
                filled += int(off[-1]) - (int(number[-1]) - seq) * group_bytes
                seq = int(number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + number, pa.int64()), pa.array(row, pa.int32())], [*batch.schema.names, "grp", "row"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Spark's limit of buckets of a table; a bucket holds any number of groups
    buckets = min(max(parts, scratch.parts_for(total, 2 * group_bytes)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    path = scratch.new_path(spark, name)
    table = scratch.table_of(path)
    docs.mapInArrow(deal, schema).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "grp").saveAsTable(table)
    return spark.table(table)
