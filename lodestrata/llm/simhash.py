"""SimHash near-dedup by a segment-popcount embedding.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of its word shingles, repeats included. Words are runs of
characters other than ASCII white space, A-Z folded; a shingle is `n` consecutive words joined by one space, and a text of fewer words is one. Fingerprints link at
`most` differing bits or fewer.

Equal fingerprints form a class; only classes go on. A fingerprint is mapped to the counts of set bits in its segments of two bits. The Manhattan distance of two such vectors
is a lower bound of the number of differing bits, and is the sum of the distances in groups of coordinates: of `most` + a groups, a at least have distance 0 if the whole is within `most`. So the grid has a
cell for each choice of a groups and values of the counts in them, a fingerprint lies in one cell of each choice, and any two that may link share a cell. A larger table takes more groups for a finer grid; what it finds is the same.

In a cell fingerprints lie in the order of their total counts; each is compared with those whose total is within `most`, which is a range join, then by all counts' Manhattan distance, and last by its bits. A spanning
forest of the links is kept: what is linked already isn't compared again with the rest of its cell, and no pairs leave a task. A cell of many fingerprints is dealt in parts, of which each pair is one task's.

Null text, or one without words, has fingerprint zero, which links like any other. A null id takes part, but names no component unless all ids in it are null. Repeated
rows are each returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, components, scratch, skew
from lodestrata.llm import textscan as ts

SEED = 42
#: Fingerprints of a cell that one task compares; a cell of more is dealt in parts.
PART = 4096
#: Rows of cells that a task takes.
TASK = 100_000
#: The grid is made fine enough for about so many fingerprints a cell, if they were random.
CELL = 1000
_PAIRS = ts.U(0x5555555555555555)
_EVERY16 = ts.U(0x0001000100010001)


def shingle_hashes(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, bounds of each document's)."""
    w = ts.words(buf, off, ts.SPACED, fold=True, hashed=False)
    words = w.counts()
    length = w.ends - w.starts
    starts = np.cumsum(length + 1) - (length + 1)
    data = np.full(int((length + 1).sum()), 32, np.uint8)
    data[ts.spread(starts, length)] = w.buf[ts.spread(w.starts, length)]
    many = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    first = ts.spread(w.first[:-1], many)
    last = np.minimum(first + n - 1, np.repeat(w.first[1:], many) - 1)
    said, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(said[a:b], SEED) for a, b in zip(starts[first].tolist(), (starts + length)[last].tolist(), strict=True)), ts.U, len(first))
    return hashes, np.concatenate([[0], np.cumsum(many)])


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each document's fingerprint. Bits are counted four at a time in lanes of 16 bits, over parts of under 2**16 hashes."""
    docs = len(bounds) - 1
    count = np.diff(bounds)
    out = np.zeros(docs, ts.U)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    parts = -(-count[some] // 0xFFFF)
    starts = np.repeat(bounds[:-1][some], parts) + ts.spread(np.zeros(len(some), np.int64), parts) * 0xFFFF
    of = np.cumsum(parts) - parts
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> ts.U(shift)) & _EVERY16, starts)
        for lane in range(4):
            ones = np.add.reduceat((lanes >> ts.U(16 * lane)) & ts.U(0xFFFF), of).astype(np.int64)
            out[some] |= (2 * ones > count[some]).astype(ts.U) << ts.U(16 * lane + shift)
    return out


def segment_counts(f: np.ndarray) -> np.ndarray:
    """The counts of set bits in all segments of two bits, each count written as so many ones: 00, 01, 11."""
    return ((f | (f >> ts.U(1))) & _PAIRS) | ((f & (f >> ts.U(1)) & _PAIRS) << ts.U(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of vectors of counts: the places in which they differ."""
    return np.bitwise_count(a ^ b)


def grid(most: int, agree: int) -> list[int]:
    """A mask of coordinates for each choice of `agree` among most + agree groups of neighbouring segments."""
    edges = np.linspace(0, 32, most + agree + 1).round().astype(int).tolist()
    groups = [sum(3 << 2 * i for i in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(groups, agree)]


def agreeing(classes: int, most: int, cell: int = CELL) -> int:
    """How many groups must agree for random fingerprints to come to about `cell` in a cell, or fewer; two random counts of two bits agree with chance 3/8."""
    for agree in range(1, 33 - most):
        if classes * (3 / 8) ** (32 * agree / (most + agree)) <= cell:
            return agree
    return 32 - most


def forest(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a spanning forest of the links of a cell's distinct fingerprints."""
    counts = segment_counts(f)
    total = np.bitwise_count(f).astype(np.int64)
    order = np.argsort(total, kind="stable")
    f, counts, total = f[order], counts[order], total[order]
    left = np.ones(len(f), bool)  # not in a tree yet
    us, vs = [], []
    lo, hi = np.searchsorted(total, total - most), np.searchsorted(total, total + most, "right")
    for root in range(len(f)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            # a tree has no end below its root that is not in it: roots ascend, but a branch may go back
            near = lo[i] + np.flatnonzero(left[lo[i] : hi[i]])
            near = near[manhattan(counts[near], counts[i]) <= most]
            near = near[np.bitwise_count(f[near] ^ f[i]) <= most]
            if len(near):
                left[near] = False
                us.append(np.full(len(near), i))
                vs.append(near)
                todo += near.tolist()
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(us)], order[np.concatenate(vs)]


def with_fingerprints(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits (the fingerprint as a long of the same bits) of every row."""
    texts = arrowmap.id_and_text(docs, id_col, text_col)
    made = arrowmap.with_text_columns(texts, "text", lambda buf, off: (fingerprints(*shingle_hashes(buf, off, n)).view(np.int64),), {"_bits": "long"}, keep_text=False)
    return made.select("doc_id", F.col("_bits").alias("bits"))


def links(classes: DataFrame, most: int = 4, part: int = PART, agree: int | None = None) -> DataFrame:
    """u, v: links between the distinct fingerprints in classes(bits) that connect all that are linked, directly or over others."""
    agree = agreeing(classes.count(), most) if agree is None else agree
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in grid(most, agree)])
    pairs, next_ = F.lit(0x5555555555555555), F.shiftrightunsigned("bits", 1)
    counts = F.col("bits").bitwiseOR(next_).bitwiseAND(pairs).bitwiseOR(F.shiftleft(F.col("bits").bitwiseAND(next_).bitwiseAND(pairs), 1))  # as segment_counts
    placed = scratch.keep(classes.select("bits", counts.alias("counts")).select("bits", F.posexplode(F.transform(masks, lambda m: F.col("counts").bitwiseAND(m))).alias("choice", "cell")), "simhash-cells")
    sizes = placed.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = skew.look_up(placed, scratch.keep(sizes.withColumn("parts", F.ceil(F.col("n") / part).cast("int")), "simhash-sizes"), ["choice", "cell"], "n", "inner")
    # part i meets part j in the task (i, j), a cell of one part itself
    dealt = met.withColumn("own", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("choice", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "bits")
    # several cells, or pairs of parts, go to a task: most are small
    tasks = scratch.parts_for(placed.count(), TASK, 8)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("choice", "cell", "p", "q", "bits")])
        bits = table.column("bits").to_numpy()
        new = np.zeros(len(bits), bool)
        new[0] = True
        for c in ("choice", "cell", "p", "q"):
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bits)], strict=True):
            u, v = forest(bits[a:b].view(ts.U), most)
            us.append(bits[a:b][u])
            vs.append(bits[a:b][v])
        return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return dealt.groupBy(F.pmod(F.xxhash64("choice", "cell", "p", "q"), F.lit(tasks)).alias("task")).applyInArrow(compare, "u long, v long").distinct()


def dedup(docs: DataFrame, n: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, bits, component_id (the least id that links reach, itself included) of every row."""
    rows = scratch.keep(with_fingerprints(docs, n, id_col, text_col), "simhash-rows")
    classes = scratch.keep(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = components.components(links(classes.select("bits"), most, **options))
    rooted = scratch.keep(classes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", "n", F.coalesce("root", "bits").alias("root")), "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = skew.look_up(rooted, scratch.keep(names, "simhash-names"), ["root"], "classes", "inner").select("bits", "component_id", "n")
    return skew.look_up(rows, scratch.keep(named, "simhash-named"), ["bits"], "n", "inner").select("doc_id", "bits", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scratch.settle(lambda: dedup(docs), "simhash-result")
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op12_simhash": op12_simhash}
ORACLE_SQL: dict[str, str] = {}
