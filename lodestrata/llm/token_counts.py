"""Token counts of whole texts; huge documents are encoded as overlapping chunks and spliced.

A document of more than `huge_chars` characters is cut into chunks that overlap by `overlap`
characters. Chunks are rows, so the chunks of one document are encoded in different tasks. Each is
encoded with offsets; two neighbours are spliced at a place in their overlap that is a token
boundary in both and proven stable: white space after a visible character, before which the
pre-tokenizer always cuts. A chunk's summary is its token count up to the stable places of its
two overlaps. Where neighbours share no such place the document is done again with an overlap
four times as wide, up to a single chunk. Shorter documents are one chunk each.

Null text: no bytes, no tokens. Null and repeated ids: each row is counted for itself. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import scratch, tokens
from lodestrata.llm import textscan as ts

CHUNKS = "doc_id {id}, digest string, n_bytes long, chunk int, start long, last boolean, part string"
ENDS = "doc_id {id}, digest string, n_bytes long, chunk int, last boolean, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at].isspace() and text[at] < "\x80" and text[at] > "\x08" and text[at] not in "\x1c\x1d\x1e\x1f" and not text[at - 1].isspace() and text[at - 1].isprintable()


def ends(encoding_offsets: list[tuple[int, int]], text: str, start: int, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Stable boundaries of a chunk's encoding between the places lo and hi of the chunk, and the tokens before each."""
    begins = np.fromiter((a for a, _ in encoding_offsets), np.int64, len(encoding_offsets))
    a, b = np.searchsorted(begins, [lo, hi])
    at, n = [], []
    for k in range(int(a), int(b)):
        p = int(begins[k])
        # a character in several tokens gives them equal offsets: only the first is a boundary
        if (k == 0 or begins[k - 1] < p) and stable(text, p):
            at.append(start + p)
            n.append(k)
    return at, n


def splice(rows: list[tuple]) -> int | None:
    """Tokens of a document from its chunks' (number, last, left_at, left_n, right_at, right_n); None if two don't align."""
    total, since = 0, 0
    for k, (_, last, _, _, right_at, right_n) in enumerate(rows):
        if last:
            return total + right_n[-1] - since
        after = dict(zip(rows[k + 1][2], rows[k + 1][3], strict=True))
        found = next(((n, after[p]) for p, n in zip(right_at, right_n, strict=True) if p in after), None)
        if found is None:
            return None
        total += found[0] - since
        since = found[1]
    return None


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32_768, huge_chars: int = 65_536, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    huge = F.length("text") > huge_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.cache(tokenizer_path)
        for batch in batches:
            buf, off = ts.raw(batch.column("text"))
            n = np.zeros(batch.num_rows, np.int64)
            for lo, hi in ts.groups(off):
                n[lo:hi] = cache.counts(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    short = docs.where(~huge).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")
    long_docs = docs.where(huge).withColumn("digest", F.sha2("text", 256))
    found = _spliced(long_docs, kind, tokenizer_path, chunk_chars, overlap)
    return short.unionByName(found).withColumn("over_limit", F.col("n_tokens") > limit)


def _spliced(docs: DataFrame, kind: str, path: str, chunk: int, overlap: int) -> DataFrame:
    done = None
    todo = docs
    while True:
        got = scratch.keep(_attempt(todo, kind, path, chunk, overlap), "token-counts")
        good = got.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = got.where("n_tokens is null").select("doc_id", "digest").distinct()
        if failed.isEmpty():
            return done
        overlap *= 4
        chunk = max(chunk, 2 * overlap)
        todo = docs.join(failed.withColumnRenamed("doc_id", "again"), (F.col("again").eqNullSafe(F.col("doc_id"))) & (failed["digest"] == docs["digest"]), "left_semi")


def _attempt(docs: DataFrame, kind: str, path: str, chunk: int, overlap: int) -> DataFrame:
    n = F.length("text")
    starts = F.sequence(F.lit(0).cast("int"), F.greatest(n - overlap - 1, F.lit(0)).cast("int"), F.lit(chunk))
    chunks = docs.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text"), n.alias("n"), F.posexplode(starts).alias("chunk", "start")).select(
        "doc_id", "digest", "n_bytes", "chunk", F.col("start").cast("long").alias("start"), (F.col("start") + chunk >= F.col("n") - overlap).alias("last"), F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text, start, last = row.column("part")[0].as_py(), row.column("start")[0].as_py(), row.column("last")[0].as_py()
                e = tok.encode(text, add_special_tokens=False)
                left = ends(e.offsets, text, start, 0, overlap)
                right = ([start + len(text)], [len(e.ids)]) if last else ends(e.offsets, text, start, chunk, len(text))
                yield pa.RecordBatch.from_arrays([row.column(c) for c in ("doc_id", "digest", "n_bytes", "chunk", "last")] + [pa.array([x], pa.list_(pa.int64())) for x in (*left, *right)], ["doc_id", "digest", "n_bytes", "chunk", "last", "left_at", "left_n", "right_at", "right_n"])

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "last", "left_at", "left_n", "right_at", "right_n")), strict=True), key=lambda r: r[0])
        copies = sum(r[0] == 0 for r in rows)  # rows that repeat a whole document
        n = splice(rows[::copies])
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1).combine_chunks().take([0] * copies), "digest": table.column("digest").slice(0, 1).combine_chunks().take([0] * copies), "n_bytes": table.column("n_bytes").slice(0, 1).combine_chunks().take([0] * copies), "n_tokens": pa.array([n] * copies, pa.int64())})

    spread = chunks.repartition("doc_id", "digest", "chunk")
    return spread.mapInArrow(encode, ENDS.format(id=kind)).groupBy("doc_id", "digest").applyInArrow(join, f"doc_id {kind}, digest string, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.default_path(), limit=1024)


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
