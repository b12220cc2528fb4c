"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of ASCII letters and digits (A-Z folded) and of everything outside ASCII. A window is k
consecutive words of a test item; an item with fewer words is one window. Every window of every document
is looked up by hash, hits are verified word by word, and hit words, or whole documents, can be removed.

The set is broadcast only up to `max_item_bytes` of test text; a larger test collection is dealt into
slices below that bound. Each slice then is a pass of its own over the documents, which are written once with row numbers, and only rows that are hit come out of it; a
slice is given up before the next is made. What the passes found is put together by row number.

Null text, or one without words: nothing is hit. An item without words has no window; one with a null id marks words
but is not named. Repeated rows are scanned each for itself; an id that several items share counts once. With no
items, no document is contaminated. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, scratch
from lodestrata.llm import textscan as ts

ADDED = {"_decon_words": "long", "_decon_hit": "long", "_decon_bits": "binary", "_decon_items": "array<string>"}
_ROW = "_decon_row"


class TestWindows:
    """Windows of one length: sorted hashes, with the item and words of each, and a bit table before them."""

    def __init__(self, length: int, hashes: np.ndarray, items: np.ndarray, at: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.length, self.hashes, self.items, self.at = length, hashes[order], items[order], at[order]
        self.shift = np.uint64(64 - min(26, max(10, (16 * len(hashes)).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.hashes >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in h that hit, first and end of their entries)."""
        c = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
        a = np.searchsorted(self.hashes, h[c])
        b = np.searchsorted(self.hashes, h[c], "right")
        hit = b > a
        return c[hit], a[hit], b[hit]


class TestSet:
    def __init__(self, items: list[tuple[str | None, str | None]], k: int):
        self.ids = [i for i, _ in items]
        self.data = "\n".join(t or "" for _, t in items).encode()
        buf = np.frombuffer(self.data, np.uint8)
        off = np.cumsum([0, *(len((t or "").encode()) + 1 for _, t in items)])
        off[-1] = max(len(buf), 0)
        w = ts.words(buf, off, ts.ALNUM, fold=True)
        self.starts, self.ends = w.starts, w.ends
        n = w.counts()
        self.sets = []
        for length in sorted({min(int(x), k) for x in n if x}):
            mine = n >= k if length == k else n == length
            at, h = ts.windows(w.hash, w.first, length)
            item = np.searchsorted(w.first, at, "right") - 1
            ok = mine[item]
            self.sets.append(TestWindows(length, h[ok], item[ok], at[ok]))

    def text(self, at: int, length: int) -> bytes:
        return normal(self.data, self.starts[at : at + length], self.ends[at : at + length])


def normal(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by a space; bytes.lower() folds A-Z only."""
    return b" ".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)).lower()


def scan(buf: np.ndarray, off: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
    """(words, mask of hit words, items found in each document)."""
    w = ts.words(buf, off, ts.ALNUM, fold=True)
    mask, found = np.zeros(len(w.hash), bool), [set() for _ in range(len(off) - 1)]
    data, known = None, {}
    for s in tests.sets:
        at, h = ts.windows(w.hash, w.first, s.length)
        where, a, b = s.find(h)
        if not len(where):
            continue
        data = data if data is not None else buf.tobytes()
        first = at[where]
        doc = np.searchsorted(w.first, first, "right") - 1
        good = np.zeros(len(where), bool)
        last = w.ends[first + s.length - 1]
        for i, (f, x, y, lo, hi, d) in enumerate(zip(first.tolist(), w.starts[first].tolist(), last.tolist(), a.tolist(), b.tolist(), doc.tolist(), strict=True)):
            key = (s.length, data[x:y])
            if key not in known:
                text = normal(data, w.starts[f : f + s.length], w.ends[f : f + s.length])
                known[key] = {int(s.items[j]) for j in range(lo, hi) if tests.text(int(s.at[j]), s.length) == text}
            if known[key]:
                good[i] = True
                found[d] |= known[key]
        mask |= ts.covered(first[good], s.length, len(mask))
    return w, mask, found


def _blank(buf, off):
    n = ts.words(buf, off, ts.ALNUM, hashed=False).counts()
    return n, np.zeros(len(n), np.int64), [None] * len(n), [[]] * len(n)


def _found(tests):
    def make(buf, off):
        w, mask, found = scan(buf, off, tests.value)
        hit = ts.per_document(mask, w.first)
        bits = [np.packbits(mask[a:b]).tobytes() if h else None for a, b, h in zip(w.first[:-1].tolist(), w.first[1:].tolist(), hit.tolist(), strict=True)]
        ids = tests.value.ids
        return w.counts(), hit, bits, [sorted({ids[i] for i in f if ids[i] is not None}) if f else [] for f in found]

    return make


def mark(docs: DataFrame, benchmark: DataFrame, k: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_item_bytes: int = 16 << 20, keep_text: bool = True) -> DataFrame:
    """docs with the columns of ADDED: words, hit words, a bit for each word (null: none hit), ids of the items found."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).distinct()
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    n = -(-total // max_item_bytes)
    # rows of a slice are bounded by its bytes
    tests = lambda i: spark.sparkContext.broadcast(TestSet([(r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()], k))
    if n < 2:
        return arrowmap.with_text_columns(docs, text_col, _found(tests(0)) if n else _blank, ADDED, keep_text)
    taken = {_ROW, "_decon_of", "_all_hit", "_all_bits", "_all_items"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    numbered = scratch.keep(docs.withColumn(_ROW, F.monotonically_increasing_id()), "decon-documents")
    passes = []
    for i in range(n):
        own = tests(i)
        found = arrowmap.with_text_columns(numbered.select(_ROW, text_col), text_col, _found(own), ADDED, keep_text=False)
        passes.append(scratch.keep(found.where("_decon_bits is not null").drop("_decon_words", "_decon_hit"), "decon-hits"))
        own.destroy()

    def together(table: pa.Table) -> pa.Table:
        bits = reduce(np.bitwise_or, (np.frombuffer(b, np.uint8) for b in table.column("_decon_bits").to_pylist()))
        ids = sorted({i for found in table.column("_decon_items").to_pylist() for i in found})
        return pa.table({_ROW: table.column(_ROW).slice(0, 1), "_all_hit": pa.array([int(np.bitwise_count(bits).sum())], pa.int64()), "_all_bits": pa.array([bits.tobytes()], pa.binary()), "_all_items": pa.array([ids], pa.list_(pa.string()))})

    hits = reduce(DataFrame.unionByName, passes).groupBy(_ROW).applyInArrow(together, f"{_ROW} long, _all_hit long, _all_bits binary, _all_items array<string>")
    out = arrowmap.with_text_columns(numbered, text_col, _blank, ADDED, keep_text).join(hits.withColumnRenamed(_ROW, "_decon_of"), F.col(_ROW) == F.col("_decon_of"), "left")
    made = {"_decon_words": F.col("_decon_words"), "_decon_hit": F.coalesce("_all_hit", "_decon_hit"), "_decon_bits": F.col("_all_bits"), "_decon_items": F.coalesce("_all_items", "_decon_items")}
    names = [c for c in docs.columns if keep_text or c != text_col]
    return out.select(*[F.col(f"`{c}`") for c in names], *[e.alias(c) for c, e in made.items()])


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", k: int = 10, text_col: str = "text", **options) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the text from the first to the last word of each run of hit words."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    marked, columns = mark(docs, benchmark, k, text_col, **options), docs.columns
    if remove == "documents":
        return marked.where("_decon_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])

    def cut(batches):
        for batch in batches:
            texts = []
            for text, bits in zip(batch.column(text_col).to_pylist(), batch.column("_decon_bits").to_pylist(), strict=True):
                if bits is None:
                    texts.append(text)
                    continue
                data = text.encode()
                buf = np.frombuffer(data, np.uint8)
                w = ts.words(buf, np.array([0, len(buf)]), ts.ALNUM, hashed=False)
                hit = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(w.starts)].astype(bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                at, out = 0, []
                for x, y in edge.reshape(-1, 2).tolist():
                    out.append(data[at : int(w.starts[x])])
                    at = int(w.ends[y - 1])
                texts.append(b"".join([*out, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in columns], columns)

    return marked.mapInArrow(cut, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = arrowmap.id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10, keep_text=False)
    names = F.array_join(F.array_sort(F.array_distinct("_decon_items")), ",")
    return marked.select("doc_id", F.col("_decon_words").alias("n_words"), F.col("_decon_hit").alias("n_hit"), F.size("_decon_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("_decon_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i, w FROM b WHERE len(w) > 0),
tw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM bw),
ks AS (SELECT DISTINCT k FROM tw),
di AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM di),
hits AS (SELECT dw.r, dw.k, dw.i, tw.item_id FROM dw JOIN tw ON dw.t = tw.t AND dw.k = tw.k),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hits)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE_SQL = {"op7_decontamination": SQL}
