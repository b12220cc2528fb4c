"""Target-distribution importance resampling over hashed word n-grams whose CRC-32s are computed in matrices.

Words are runs of ASCII letters and digits (A-Z folded) and of everything outside ASCII. Features are all runs of one to `orders`
consecutive words, joined by one space; a feature's bucket is the CRC-32 of its bytes modulo `buckets`. A task takes the distinct features of
about a megabyte of whole texts, groups them by equal length into matrices of bytes, a row for each place and a column for each feature, and updates
the CRCs of a matrix place by place; buckets are scattered back to all occurrences. Features are told apart by their words, which are compared byte by byte.

Counts of both corpora cover all their rows. They are vectors of `buckets` numbers, summed in tasks before they are shuffled, and their size bounds what the driver
gathers and broadcasts. A bucket's gain is a whole number, so a document's weight is an exact sum. Gumbel noise is drawn from the id, so a row's key is the same in every run.

The k highest scores are found by digits, without sorting what isn't drawn; the drawn ones are numbered in ranges of (score, id).

Null text has no words; its weight is 0. A null id draws its noise as an empty text does, and comes after other ids of its score. Repeated rows draw equal noise and
are drawn each for itself, in no order of their own. Documents of fewer words than `least_words` are never drawn. An empty target has no features: all its counts are 0. An empty table gives an empty
result. Extra columns are ignored, and the text's and id's names are parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, radix, scratch
from lodestrata.llm import textscan as ts

#: Reflected polynomial of CRC-32, a fixed value.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


_TABLE = _crc_table()
#: The CRC-32 of two bytes, the first of them the lower: what both do to a CRC.
_TABLE2 = _TABLE[np.arange(1 << 16) >> 8 ^ (_TABLE[np.arange(1 << 16) & 0xFF] & 0xFF)] ^ (_TABLE[np.arange(1 << 16) & 0xFF] >> np.uint32(8))


def crc32_matrix(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """CRC-32 of each piece of buf.

    Pieces of one length make a matrix of bytes, of about `cells` at most or one piece, a column for each place. All its CRCs are updated together, column by column, two columns at a time and an odd last one.
    """
    n = ends - starts
    out = np.zeros(len(n), np.uint32)
    order = np.argsort(n, kind="stable")
    bounds = np.flatnonzero(np.diff(n[order], prepend=-1))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(n)][: len(bounds)], strict=True):
        length = int(n[order[a]])
        step = max(1, cells // max(length, 1))
        for lo in range(a, b, step):
            mine = order[lo : min(b, lo + step)]
            at = starts[mine]
            matrix = np.ndarray((len(buf) - length + 1, length), np.uint8, buf, 0, (1, 1))[at].T.copy() if length else np.zeros((0, len(mine)), np.uint8)
            wide = matrix[: length // 2 * 2].reshape(-1, 2, len(mine))
            crc = np.full(len(mine), 0xFFFFFFFF, np.uint32)
            for first, second in wide:
                crc = _TABLE2[(crc & np.uint32(0xFFFF)) ^ first ^ (second.astype(np.uint32) << np.uint32(8))] ^ (crc >> np.uint32(16))
            if length % 2:
                crc = _TABLE[(crc & np.uint32(0xFF)) ^ matrix[-1]] ^ (crc >> np.uint32(8))
            out[mine] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def spaced(w: ts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): all words one after another with a space after each."""
    n = w.ends - w.starts
    starts = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 32, np.uint8)
    out[ts.spread(starts, n)] = w.buf[ts.spread(w.starts, n)]
    return out, starts, starts + n


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, which of them each key is)."""
    if len(keys) and int(keys.max()) < 4 * len(keys):  # small numbers need no sorting
        a_place = np.full(int(keys.max()) + 1, -1)
        a_place[keys] = np.arange(len(keys))
        there = a_place >= 0
        return a_place[there], (np.cumsum(there) - 1)[keys]
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return first, place


def feature_buckets(buf: np.ndarray, off: np.ndarray, orders: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words of each document, first places of features for each order as documents' bounds, their buckets): features of one order lie in the order of the text."""
    w = ts.words(buf, off, ts.ALNUM, fold=True, hashed=False)
    words = w.counts()
    data, starts, ends = spaced(w)
    said = ts.classes(w.buf, w.starts, w.ends)
    bounds, found = [], []
    for k in range(1, orders + 1):
        many = np.maximum(words - k + 1, 0)
        at = ts.spread(w.first[:-1], many)
        first, place = _distinct(ts.runs_of(said, at, k))
        distinct = at[first]
        crc = crc32_matrix(data, starts[distinct], ends[distinct + k - 1])
        bounds.append(np.concatenate([[0], np.cumsum(many)]))
        found.append((crc % np.uint32(buckets)).astype(np.int32)[place])
    return words, bounds, found


def bucket_counts(texts: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off = ts.raw(batch.column("text"))
            for lo, hi in ts.groups(off):
                for found in feature_buckets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], orders, buckets)[2]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both models' chances of each bucket, rounded down."""
    size = float(len(raw))
    t_all, s_all = float(target.sum()) + size, float(raw.sum()) + size
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, orders: int = 3, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    texts = arrowmap.id_and_text(docs, id_col, text_col)
    gain = gains(bucket_counts(target.select(F.col(target_col).alias("text")), orders, buckets), bucket_counts(texts, orders, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def make(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        words, bounds, found = feature_buckets(buf, off, orders, buckets)
        n, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for b, at in zip(bounds, found, strict=True):
            total = np.concatenate([[0], np.cumsum(shared.value[at])])
            n += np.diff(b)
            weight += total[b[1:]] - total[b[:-1]]
        return words, n, weight

    out = arrowmap.with_text_columns(texts, "text", make, {"_words": "long", "_features": "long", "_weight": "long"}, keep_text=False)
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place, from 1, in an order: sorted in ranges, which are written once and counted."""
    at = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a range
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    table = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    return at.join(table, part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row: rank is the place among the percent of the rows of least_words words or more that are drawn, else null."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.keep(weigh(docs, target, **options).withColumn("score", F.col("weight") + noise), "target-scores")
    able = F.col("n_words") >= least_words
    k = percent * scored.where(able).count() // 100
    least, _ = radix.kth_largest(scored.where(able), "score", k)
    near = scored.where(able & (F.col("score") >= least))  # all that are drawn, and those that tie with the last
    drawn = numbered(near, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.where(~able | (F.col("score") < least)).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS c FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, range(1, 4) o(k) WHERE len(w) >= k) GROUP BY ALL),
bf AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS c FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, range(1, 4) o(k) WHERE len(w) >= k) GROUP BY ALL),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
x AS (SELECT f, list_reduce(list_concat([4294967295], list_transform(range(1, 2 * strlen(f), 2), lambda i: CAST('0x' || hex(f)[i:i + 1] AS BIGINT))), lambda c, y: xor(t[CAST(xor(c, y) & 255 AS BIGINT) + 1], c >> 8)) AS crc FROM fs, tab),
bk AS (SELECT f, xor(crc, 4294967295) % 10000 AS bucket FROM x),
s AS (SELECT bucket, sum(c) AS s FROM df JOIN bk USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM bf JOIN bk USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(c) AS n_features, sum(c * gain) AS weight FROM df JOIN bk USING (f) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n_words, CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d),
q AS (SELECT r, doc_id, n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM k) THEN rank END AS rank FROM q LEFT JOIN k USING (r)
"""

QUERIES = {"op11_target_resampling": op11_target_resampling}
ORACLE_SQL = {"op11_target_resampling": SQL}
