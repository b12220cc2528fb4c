"""Exact substring dedup over words by fixed-block anchors.

Every text is indexed by its non-overlapping blocks of half a window; any window holds a whole block. Every rolling
half window of every text probes that index. Hits, which other documents share, are extended: each full window
that holds one is compared with equal windows elsewhere, and adjoining windows that start in an earlier document
make up a maximal repeat, whose words are removed.

Both comparisons are meetings of sorted hashes: a group of documents sends each of its distinct hashes once, in compressed packets
dealt by the hashes' top bits, and gets back those that matter to it. A passage in a third of all documents is thus one
hash of each group, and no pairs are made. Texts are written once in groups and never shuffled. Half windows meet by 64 bits, which only
choose candidates; full windows are compared by the hashes of two families, 128 bits.

Words are runs of characters other than ASCII white space. Null text has no words. Ids are of any type that has an order; a row with a null id neither
loses words nor makes others lose them; rows that share an id don't make each other lose words. Texts shorter than a window stay
whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import hashruns as hr
from lodestrata.llm import scratch
from lodestrata.llm import textscan as ts

GROUP_BYTES = 12 << 20
RANGE_HASHES = 1_500_000


def _subgroups(table: pa.Table):
    """(first row, ranks of ids, null ids, bytes, offsets) of each megabyte of a group."""
    buf, off = ts.raw(table.column("text"))
    ids = table.column("rank").combine_chunks()
    null = np.asarray(ids.is_null())
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi in ts.groups(off):
        yield lo, value[lo:hi], null[lo:hi], buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _firsts(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal windows adjoin, where each new one begins in it)."""
    order, again = ts.order_of(h, h2)
    return order, np.flatnonzero(np.concatenate([[True], ~again])) if len(h) else np.zeros(0, np.int64)


def with_ranks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, rank: a long in the order of the ids. Ids of other types than whole numbers are numbered: distinct ids are sorted in ranges, not the texts."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(texts.schema["doc_id"].dataType, T.IntegralType):
        return texts.withColumn("rank", F.col("doc_id").cast("long"))
    ids = texts.select(F.col("doc_id").alias("of")).where("of is not null").distinct().repartitionByRange("of").sortWithinPartitions("of")
    return texts.join(scratch.keep(ids.withColumn("rank", F.monotonically_increasing_id()), "id-ranks"), F.col("of") == F.col("doc_id"), "left").drop("of")


def removed_and_kept(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: str = "sha", group_bytes: int = GROUP_BYTES, range_hashes: int = RANGE_HASHES, step_bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, and kept_sha256 of the kept words (keep="sha") or kept_text, the kept words joined by a space."""
    texts = with_ranks(docs, id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    total, count = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    half = window // 2
    store = hr.grouped_table(texts, "substring_texts", group_bytes, total=total)
    groups = (total + 16 * count) // group_bytes + 1
    halves = hr.Meeting(total // 6, groups, range_hashes, {"block": "u1", "several": "u1"}, step_bits=step_bits)
    fulls = hr.Meeting(total // 6, groups, range_hashes, {"second": "<u8", "rank": "<i8"}, {"second": "<u8"}, step_bits=step_bits)

    def probe(table: pa.Table) -> pa.Table:
        """Each distinct hash of a group's rolling half windows; whether it is a block's, and whether two documents here have it."""
        hashes, blocks, owner = [], [], []
        for lo, _, null, buf, off in _subgroups(table):
            w = ts.words(buf, off)
            at, h = ts.windows(w.hash, w.first, half)
            doc = np.searchsorted(w.first, at, "right") - 1
            ok = ~null[doc]
            hashes.append(h[ok])
            blocks.append(((at - w.first[doc]) % half == 0)[ok])
            owner.append((doc + lo)[ok].astype(np.int32))
        h, block, doc = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (blocks, bool), (owner, np.int32)))
        order = np.argsort(h, kind="stable")
        h, block, doc = h[order], block[order], doc[order]
        new = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        if not len(new):
            return halves.none()
        any_block = np.logical_or.reduceat(block, new)
        several = np.maximum.reduceat(doc, new) != np.minimum.reduceat(doc, new)
        return halves.send(table.column("grp")[0].as_py(), h[new], block=any_block, several=several)

    def live(h: np.ndarray, others: dict) -> tuple[np.ndarray, dict]:
        """Which hashes are a block's somewhere and in two documents."""
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
        size = np.diff(np.append(new, len(h)))
        found = np.logical_or.reduceat(others["block"][order], new) & ((size > 1) | np.logical_or.reduceat(others["several"][order], new))
        mask = np.zeros(len(h), bool)
        mask[order] = np.repeat(found, size)
        return mask, {}

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each distinct full window of a group that holds a hit, with its smallest rank here."""
        if not left.num_rows or not right.num_rows:
            return fulls.none()
        known, _ = halves.answers(right)
        hashes, seconds, owner = [], [], []
        for _, ids, null, buf, off in _subgroups(left):
            w = ts.words(buf, off)
            at, h = ts.windows(w.hash, w.first, half)
            hit = at[hr.member(h, known)]
            if not len(hit):
                continue
            n = len(w.hash)
            # starts from half a window before a hit to the hit itself
            d = np.bincount(np.maximum(hit - (window - half), 0), minlength=n + 1) - np.bincount(hit + 1, minlength=n + 2)[: n + 1]
            near = np.cumsum(d[:n]) > 0
            at, h = ts.windows(w.hash, w.first, window)
            doc = np.searchsorted(w.first, at, "right") - 1
            ok = near[at] & ~null[doc]
            hashes.append(h[ok])
            seconds.append(ts.windows(w.second(), w.first, window, which=1)[1][ok])
            owner.append(ids[doc[ok]])
        if not sum(map(len, hashes)):
            return fulls.none()
        h, h2, rank = np.concatenate(hashes), np.concatenate(seconds), np.concatenate(owner)
        order, new = _firsts(h, h2)
        return fulls.send(left.column("grp")[0].as_py(), h[order][new], second=h2[order][new], rank=np.minimum.reduceat(rank[order], new))

    def earlier(h: np.ndarray, others: dict) -> tuple[np.ndarray, dict]:
        """The windows, for each group, that start in a document with a smaller id than any of that group's."""
        rank = others["rank"]
        order, new = _firsts(h, others["second"])
        least = np.repeat(np.minimum.reduceat(rank[order], new), np.diff(np.append(new, len(h))))
        mask = np.zeros(len(h), bool)
        mask[order] = least < rank[order]
        return mask, {"second": others["second"][mask]}

    result = "kept_sha256" if keep == "sha" else "kept_text"

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        seen, seen2 = fulls.answers(right)
        parts, hashes, seconds, owner = [], [], [], []
        for _, ids, null, buf, off in _subgroups(left) if left.num_rows else ():
            w = ts.words(buf, off)
            at, h = ts.windows(w.hash, w.first, window)
            h2 = ts.windows(w.second(), w.first, window, which=1)[1]
            doc = np.searchsorted(w.first, at, "right") - 1
            ok = ~null[doc]
            parts.append((buf, w.starts, w.ends, w.first, at[ok]))
            hashes.append(h[ok])
            seconds.append(h2[ok])
            owner.append(ids[doc[ok]])
        flagged = np.zeros(sum(map(len, hashes)), bool)
        if len(flagged):
            # known repeats go first: what equals one is a repeat too
            h, h2 = np.concatenate([seen, *hashes]), np.concatenate([seen2["second"], *seconds])
            d = np.concatenate([np.full(len(seen), np.iinfo(np.int64).min), *owner])
            order, new = _firsts(h, h2)
            d = d[order]
            least = np.repeat(np.minimum.reduceat(d, new), np.diff(np.append(new, len(h))))
            again = np.zeros(len(h), bool)
            again[order] = d > least
            flagged = again[len(seen) :]
        n_words, n_removed, kept, place = [], [], [], 0
        for buf, starts, ends, first, at in parts:
            gone = ts.covered(at[flagged[place : place + len(at)]], window, len(starts))
            place += len(at)
            n_words.append(np.diff(first))
            n_removed.append(ts.per_document(gone, first))
            kept += kept_words(buf, starts, ends, first, gone)
        made = [hashlib.sha256(x).hexdigest() for x in kept] if keep == "sha" else [x.decode() for x in kept]
        ids = left.column("doc_id").combine_chunks() if left.num_rows else left.schema.empty_table().column("doc_id").combine_chunks()
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"doc_id": ids, "n_words": pa.array(join(n_words), pa.int64()), "n_removed": pa.array(join(n_removed), pa.int64()), result: pa.array(made, pa.string())})

    hits = halves.met(store.groupBy("grp").applyInArrow(probe, halves.SCHEMA), live)
    full = store.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(candidates, fulls.SCHEMA)
    repeats = fulls.met(full, earlier)
    return store.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, {result} string")


def kept_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """Each document's words that are not gone, joined by one space."""
    n, keep = len(starts), ~gone
    d = np.zeros(len(buf) + 1, np.int8)
    d[starts[keep]] += 1
    # one byte after a kept word goes along as its space, where a kept word of the document follows
    last = np.full(len(first) - 1, -1)
    at = np.flatnonzero(keep)
    doc = np.searchsorted(first, at, "right") - 1
    last[doc] = at
    closes = np.zeros(n, bool)
    closes[last[last >= 0]] = True
    stop = ends[keep] + ~closes[keep]
    np.add.at(d, stop, -1)
    mask = np.cumsum(d[:-1]) > 0
    out = np.where(ts.SPACED[buf], buf, 32).astype(np.uint8)[mask].tobytes()
    length = (stop - starts[keep]).astype(np.int64)
    ends_at = np.cumsum(np.bincount(doc, length, minlength=len(first) - 1).astype(np.int64))
    bounds = [0, *ends_at.tolist()]
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scratch.settle(lambda: removed_and_kept(docs, window=50), "substring-result")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
x AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
g AS (SELECT r, list(i) AS starts FROM x JOIN m USING (h) WHERE least < doc_id GROUP BY r),
p AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS q FROM (SELECT r, unnest(starts) AS i FROM g)),
e AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT e.r, count(*) AS n_kept, string_agg(t, ' ' ORDER BY e.q) AS kept FROM e LEFT JOIN p ON e.r = p.r AND e.q = p.q WHERE p.r IS NULL GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE_SQL = {"op4_substring_dedup": SQL}
