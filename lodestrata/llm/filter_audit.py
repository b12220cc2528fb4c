"""Filter interaction audit: what each filter of a chain removes, in every order of the chain, by a recursive common table expression.

Five filters, of which a document fails
A: with under 200 words; B: if under half of its words are distinct; C: if over 2 % of its code points are A-Z; D: with any of # $ % & * |;
E: if its text is that of a document with a smaller id, anywhere in the table and whether or not other filters remove that one.

Every document becomes a mask of the filters that it fails, and documents are counted by part, mask and labels: 32 masks a part at most. A recursive query extends prefixes of orders by letters that aren't in them yet,
joins the mask cells and carries the bits that were applied; each level emits its step: which masks are kept after it, removed by it, or fail it but were removed before. Its size is that of 325 prefixes
and the masks, however large the table is. Parts are joined to it by their masks, so nothing passes over documents again.

Null text is empty text. A null part is the empty string. A null id takes part, but is never smaller or larger than another; rows that share their id and text
are copies of each other of which neither is removed for the other. Labels of one id are joined by their maximum; documents without labels are neither good nor toxic. Words are runs of characters other than ASCII white
space, in any case. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, scratch, skew
from lodestrata.llm import textscan as ts

LETTERS = "ABCDE"
_MARKS = ts.byte_table(lambda b: chr(b) in "#$%&*|")
_COPY = 1 << LETTERS.index("E")


def own_failures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bits of A to D of each whole text."""
    docs = len(off) - 1
    w = ts.words(buf, off, hashed=False)
    n = w.counts()
    doc = w.doc()
    said = ts.classes(buf, w.starts, w.ends, doc)  # numbers of one document are its own
    distinct = np.zeros(docs, np.int64)
    if len(said):
        owner = np.zeros(int(said.max()) + 1, np.int64)
        owner[said] = doc
        there = np.zeros(len(owner), bool)
        there[said] = True
        distinct = np.bincount(owner[there], minlength=docs)
    within = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off])
    upper, points, marks = within((buf >= 65) & (buf <= 90)), within((buf < 128) | (buf >= 192)), within(_MARKS[buf])
    return (n < 200) * 1 + (100 * distinct < 50 * n) * 2 + (100 * upper > 2 * points) * 4 + (marks > 0) * 8


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic of every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = scratch.keep(arrowmap.with_text_columns(texts, "text", lambda b, o: (own_failures(b, o),), {"_own": "long"}, keep_text=False), "audit-rows")
    # all rows of a text have one digest; frequent ones stay where they are
    first = scratch.keep(rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "audit-digests")
    known = skew.look_up(rows.where("doc_id is not null"), first, ["digest"], "n", "inner")
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.join(of, F.col("doc_id") == F.col("_of"), "left").withColumn("mask", F.col("_own") + F.when(F.col("doc_id") > F.col("first"), _COPY).otherwise(0))
    # null ids have no labels and no smaller ids: they needn't meet
    nameless = rows.where("doc_id is null").select("part", F.col("_own").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).unionByName(nameless)


def cells(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """part, mask, n, good, toxic: how many rows there are of each part and mask, and of them how many are labelled so."""
    rows = masks(docs, labels, **columns)
    return rows.groupBy("part", F.col("mask").cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


STEPS = """
WITH RECURSIVE steps (prefix, step, applied, bit, mask, kept, removed, redundant) AS (
  SELECT CAST('' AS STRING), 0, 0, 0, mask, 1, 0, 0 FROM {cells}
  UNION ALL
  SELECT concat(prefix, f.letter), step + 1, applied | f.bit, f.bit, mask,
    IF(mask & (applied | f.bit) = 0, 1, 0), IF(mask & f.bit <> 0 AND mask & applied = 0, 1, 0), IF(mask & f.bit <> 0 AND mask & applied <> 0, 1, 0)
  FROM (SELECT *, explode(filter(sequence(0, length('{letters}') - 1), i -> applied & shiftleft(1, i) = 0)) AS i FROM steps) LATERAL VIEW inline(array(struct(substring('{letters}', i + 1, 1), shiftleft(1, i)))) f AS letter, bit
)
SELECT prefix, step, bit, mask, kept, removed, redundant FROM steps WHERE step > 0
"""


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and its counts, for every part, order and step; cells: part, mask, good, toxic, n."""
    spark, k = cells.sparkSession, len(letters)
    every = spark.range(0, 1 << k, 1, 1).select(F.col("id").cast("int").alias("mask"))
    steps = scratch.keep(spark.sql(STEPS.replace("{letters}", letters), cells=every), "audit-steps")  # the levels run once
    # of prefixes and masks there are as many as letters allow, whatever the table
    met = cells.join(F.broadcast(steps), "mask")
    total = lambda flag, of="n": F.sum(F.col(flag) * F.col(of))
    by_prefix = met.groupBy("part", "prefix", "step", "bit").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"))
    # orders that begin with a prefix: those of the letters left
    ways = F.factorial(F.lit(k) - F.col("step"))
    by_prefix = scratch.keep(by_prefix.withColumn("letter", F.substring("prefix", -1, 1)), "audit-prefixes")
    shapley = by_prefix.groupBy("part", "letter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = steps.where(F.col("step") == k).select(F.col("prefix").alias("filter_order")).distinct().select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    orders = orders.select("filter_order", F.expr("substring(filter_order, 1, step)").alias("prefix"))
    out = by_prefix.join(shapley, ["part", "letter"]).join(F.broadcast(orders), "prefix")
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(scratch.keep(found, "audit-cells"))


SQL = r"""
WITH RECURSIVE lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
f AS (SELECT x, min(doc_id) AS least FROM d GROUP BY x),
w AS (SELECT doc_id, part, x, least, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM d JOIN f USING (x)),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN lab USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
s(prefix, step, before, bit) AS (SELECT '', 0, 0, 0 UNION ALL SELECT prefix || letter, step + 1, before | s.bit, l.bit FROM s JOIN l ON (before | s.bit) & l.bit = 0),
a AS (SELECT part, prefix, step, right(prefix, 1) AS letter, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s WHERE step > 0 GROUP BY ALL),
o AS (SELECT prefix AS filter_order, unnest(range(1, 6)) AS step FROM s WHERE step = 5),
r AS (SELECT part, filter_order, o.step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM o JOIN a ON a.prefix = filter_order[1:o.step]),
v AS (SELECT part, letter, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley FROM r JOIN v USING (part, letter)
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE_SQL = {"op13_filter_audit": SQL}
