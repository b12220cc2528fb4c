"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target texts (labelled 1) and one of all raw texts, give each
document a log importance weight: the sum over its n-grams of the log ratio of their probabilities. Adding independent Gumbel noise and taking the k
largest samples k documents without replacement in proportion to their weights.

Counts of raw texts come from all documents, those of target texts from a bounded number of labelled rows; they are two vectors of `buckets` numbers, summed in tasks before they are shuffled,
and that size bounds what the driver gathers and broadcasts. The k-th largest key is found digit by digit, exactly, so no task sorts all keys.

Null text has no n-grams and weight 0. Null ids draw their noise from the text alone. Repeated rows draw equal noise; of rows that tie at
the threshold those with smaller ids' hashes are taken. Without labels nothing is the target: all weights are 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, radix, scratch
from lodestrata.llm import textscan as ts


def grams(buf: np.ndarray, off: np.ndarray, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word n-gram of the orders, words folded."""
    w = ts.words(buf, off, ts.SPACED, fold=True)
    docs, hashes = [], []
    for n in orders:
        at, h = ts.windows(w.hash, w.first, n)
        docs.append(np.searchsorted(w.first, at, "right") - 1)
        hashes.append((h >> np.uint64(20)) % np.uint64(buckets))
    return np.concatenate(docs), np.concatenate(hashes).astype(np.int64)


def bucket_counts(texts: DataFrame, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """N-grams of all texts in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off = ts.raw(batch.column("text"))
            for lo, hi in ts.groups(off):
                total += np.bincount(grams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], orders, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def weigh(docs: DataFrame, labels: DataFrame, orders: tuple[int, ...] = (1, 2), buckets: int = 10_000, smoothing: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_target: int = 50_000) -> DataFrame:
    """doc_id, n_grams, log_weight of every row. The target model is fitted on at most max_target labelled texts, those with the least hashes of their ids: a bound on what is broadcast."""
    texts = arrowmap.id_and_text(docs, id_col, text_col)
    target_ids = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).distinct()
    target_ids = F.broadcast(target_ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target))
    target = bucket_counts(texts.join(target_ids, "doc_id", "left_semi"), orders, buckets)
    raw = bucket_counts(texts, orders, buckets)
    p, q = ((c + smoothing) / (c.sum() + smoothing * buckets) for c in (target, raw))
    ratio = docs.sparkSession.sparkContext.broadcast(np.log(p / q) if target.sum() else np.zeros(buckets))

    def score(buf, off):
        doc, bucket = grams(buf, off, orders, buckets)
        n = np.bincount(doc, minlength=len(off) - 1)
        return n, np.bincount(doc, ratio.value[bucket], minlength=len(off) - 1)

    weighed = arrowmap.with_text_columns(texts.withColumn("_text_hash", F.xxhash64("text")), "text", score, {"_n": "long", "_w": "double"}, keep_text=False)
    return weighed.select("doc_id", F.col("_n").alias("n_grams"), F.col("_w").alias("log_weight"), "_text_hash")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 42, **options) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept of every row; k rows are kept, by default as many as the labels' share of targets."""
    weighed = weigh(docs, labels, **options)
    # 52 bits of a hash, never 0 or 1: the noise of a row is the same in every run and task
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), F.col("_text_hash"))), 12).cast("double") + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(draw)))
    whole, rest = radix.ordered_longs(F.col("gumbel_key"))
    keyed = scratch.keep(keyed.withColumns({"_whole": whole, "_rest": rest, "_tie": F.xxhash64("doc_id", "_text_hash")}), "importance")
    n = keyed.count()
    if k is None:
        label = options.get("label_col", "quality")
        share = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
        k = round(n * (share if share is not None else 1.0))
    # the k-th key by its whole part, then by what is left of it, then by the tie's hash: each digit is one job of at most 2**16 rows
    names, rows, left, kept = ("_whole", "_rest", "_tie"), keyed, k, F.lit(False)
    equal = F.lit(True)
    for name in names:
        at, left = radix.kth_largest(rows, name, left)
        kept = kept | (equal & (F.col(name) > at))
        equal = equal & (F.col(name) == at)
        rows = rows.where(F.col(name) == at)
    # rows that are equal in key and tie are kept together
    kept = kept | (equal & F.lit(left > 0))
    return keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
