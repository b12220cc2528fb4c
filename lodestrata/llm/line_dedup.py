"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are parts of a text between line feeds; lines without a word are kept and don't count. Windows are `run` consecutive
lines, and fewer lines (one at least) that hold `words` words or more together, so that a long passage is found in
however few lines it stands; words=None leaves the shorter windows out.

1. Select: the least line hash of each window (the rightmost of equal ones) is its fingerprint. Equal windows select the same place, so a window that repeats has a fingerprint that repeats. Only
   selected lines are stored, with their position, the windows that selected them, and the digests of the lines around.
2. Join: positions of fingerprints that stand at one position only are dropped, most of them by a bitmap of those that repeat (skew.maybe_in), the others by a join.
3. Extend: from each position that is left the windows that selected it are read off its surroundings, before and after it, and meet by their lines' digests. One that occurs earlier, in order of (id, line), marks its
   lines; adjoining windows make up a repeated run of any length. Marked lines are deleted. Texts that a bitmap shows to lose nothing stay where they are; only the others are shuffled to meet their lines.

What is joined is one row a distinct fingerprint or window, never pairs of positions, so a line that a third of all documents
share is one row there, and rows of frequent ones aren't gathered (skew.look_up). A fast hash chooses fingerprints; lines
and windows are compared by 128 bits of SHA-256. Joins are shuffled on small tables too, so that what is measured there grows in proportion. The table is read three times. Null text stays null and counts no lines. A null id comes after all others. Rows that share an id and
text are at equal positions and don't delete each other's lines. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import scratch, skew

_WORD = r"[^\x20\x09-\x0D]"


def positions(rows: DataFrame, run: int, words: int | None) -> DataFrame:
    """A row for each selected line: id, row_key, n_lines, its hash (mark) and number (mark_line), the windows that select it (spans: 2 * run times the place of the first line, and how many they are), and numbers and digests of the lines around it, 16 bytes each: short rows to shuffle."""
    counted = "regexp_count(x, r'[^\\x20\\x09-\\x0D]+')" if words else "0"
    content = f"filter(transform(lines, (x, i) -> named_struct('line', i, 'n', {counted}, 'h', if(x rlike r'[^\\x20\\x09-\\x0D]', xxhash64(x), null), 'g', unhex(left(sha2(x, 256), 32)))), x -> x.h is not null)"
    none = f"array_repeat(cast(null as struct<line:int,n:int,h:bigint,g:binary>), {run - 1})"
    own = rows.select("id", "row_key", F.size("lines").alias("n_lines"), F.expr(content).alias("c")).withColumn("p", F.concat(F.expr(none), F.col("c"), F.expr(none)))
    seen = range(2 * run - 1)  # the line itself is in the middle
    flat = own.where(F.size("c") >= (1 if words else run)).select("id", "row_key", "n_lines", F.explode(F.arrays_zip(*[F.slice("p", j + 1, F.size("c")).alias(f"w{j}") for j in seen])).alias("w"))
    at = lambda j, of: F.col(f"w.w{j}.{of}")
    me, spans = run - 1, []
    for k in range(1 if words else run, run + 1):
        for a in range(me - k + 1, me + 1):
            least = [at(j, "h") >= at(me, "h") for j in range(a, me)] + [at(j, "h") > at(me, "h") for j in range(me + 1, a + k)]
            there = [at(j, "h").isNotNull() for j in {a, a + k - 1}]
            enough = [] if k == run else [reduce(add, [at(j, "n") for j in range(a, a + k)]) >= words]
            spans.append(F.when(reduce(and_, [*there, *least, *enough]), F.lit(a * 2 * run + k)))
    around = [F.array(*[at(j, "line") for j in seen]).alias("around"), F.concat(*[F.coalesce(at(j, "g"), F.lit(bytearray(16))) for j in seen]).alias("digests")]
    made = flat.select("id", "row_key", "n_lines", at(me, "h").alias("mark"), at(me, "line").alias("mark_line"), F.array_compact(F.array(*spans)).alias("spans"), *around)
    return made.where(F.size("spans") > 0)


def extended(near: DataFrame, run: int) -> DataFrame:
    """id, row_key, n_lines, its_lines, window (a digest of its lines' digests) of each window that selected a position."""
    own = near.select("id", "row_key", "n_lines", "around", "digests", F.explode("spans").alias("s")).withColumns({"a": F.expr(f"s div {2 * run}").cast("int"), "k": F.col("s") % (2 * run)})
    digest = F.unhex(F.left(F.sha2(F.expr("substring(digests, a * 16 + 1, k * 16)"), 256), F.lit(32)))
    return own.select("id", "row_key", "n_lines", F.slice("around", F.col("a") + 1, F.col("k")).alias("its_lines"), digest.alias("window"))


def repeated_lines(rows: DataFrame, run: int, words: int | None) -> DataFrame:
    """id, row_key, gone (numbers of lines to delete, ascending), kept (numbers of the others) of rows that lose lines."""
    every = scratch.keep(positions(rows, run, words), "line-positions")
    order = lambda line: F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), line.alias("line"))
    again = every.groupBy("mark").agg(F.min(order(F.col("mark_line"))).alias("a"), F.max(order(F.col("mark_line"))).alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    marks = scratch.keep(again.select("mark", "n"), "line-marks")
    likely = skew.maybe_in(every, marks, F.col("mark"), F.col("mark"), "likely").where("likely").drop("likely")
    near = extended(scratch.keep(skew.look_up(likely, marks, ["mark"], "n", "inner", hint="merge"), "line-matches"), run)
    start = order(F.col("its_lines")[0])
    first = near.groupBy("window").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    marked = skew.look_up(near, scratch.keep(first, "line-firsts"), ["window"], "n", "inner", hint="merge").where(start > F.col("first"))
    gone = marked.groupBy("id", "row_key", "n_lines").agg(F.flatten(F.collect_set("its_lines")).alias("gone"))
    gone = gone.withColumn("gone", F.array_sort(F.array_distinct("gone")))
    return gone.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone")))


def dedup(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", words: int | None = 50) -> DataFrame:
    """docs with _line_kept_text, _line_lines (number of lines) and _line_removed; words=None: runs of `run` lines only."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_key"), F.split(text_col, "\n", -1).alias("lines")).where("lines is not null")
    found = repeated_lines(rows, run, words).select(F.col("id").alias("_line_id"), F.col("row_key").alias("_line_key"), "gone", F.col("kept").alias("_line_kept"))
    found = scratch.keep(found.select("_line_id", "_line_key", "_line_kept", F.size("gone").cast("long").alias("_line_gone")), "line-losses")
    told = skew.maybe_in(docs.withColumn("_line_hash", F.xxhash64(text_col)), found, F.xxhash64(F.col(id_col), F.col("_line_hash")), F.xxhash64("_line_id", "_line_key"), "_line_likely")
    count = lambda parts: F.when(parts.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("_line_lines")
    own, none = [F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long")
    whole = told.where(~F.col("_line_likely")).select(*own, F.col(text_col).alias("_line_kept_text"), count(F.split(text_col, "\n", -1)), none.alias("_line_removed"))
    # the lines are made below the join, so that each is looked up in an array that exists
    likely = told.where("_line_likely").withColumn("_line_parts", F.split(text_col, "\n", -1))
    met = likely.join(found.hint("merge"), F.col(id_col).eqNullSafe(F.col("_line_id")) & (F.col("_line_hash") == F.col("_line_key")), "left")
    text = F.when(F.col("_line_kept").isNull(), F.array_join("_line_parts", "\n")).otherwise(F.array_join(F.transform("_line_kept", lambda k: F.get("_line_parts", k)), "\n"))
    return whole.unionByName(met.select(*own, text.alias("_line_kept_text"), count(F.col("_line_parts")), F.coalesce("_line_gone", none).alias("_line_removed")))


def _counts(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("_line_lines").alias("n_lines"), F.col("_line_removed").alias("n_removed"), F.sha2(F.coalesce("_line_kept_text", F.lit("")), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines, and one or two lines of 50 words or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _counts(dedup(docs, run=3, words=50))


def op9_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _counts(dedup(docs, run=3, words=None))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS n FROM d),
c AS (SELECT r, doc_id, n, x, lead(n, 1) OVER o AS n1, lead(n, 2) OVER o AS n2, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY r ORDER BY n)),
w AS (SELECT r, doc_id, n, n1, n2, x || chr(10) || x1 || chr(10) || x2 AS t FROM c WHERE n2 IS NOT NULL),
m AS (SELECT t, min((doc_id, n)) AS first FROM w GROUP BY t),
g AS (SELECT DISTINCT r, unnest([n, n1, n2]) AS n FROM w JOIN m USING (t) WHERE (doc_id, n) > first),
k AS (SELECT l.r, string_agg(x, chr(10) ORDER BY l.n) AS kept FROM l ANTI JOIN g ON l.r = g.r AND l.n = g.n GROUP BY l.r),
e AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN e USING (r)
"""

SQL_WORDS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS n FROM d),
v AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS k FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (SELECT r, doc_id, n, x, k, lead(n, 1) OVER o AS n1, lead(n, 2) OVER o AS n2, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(k, 1) OVER o AS k1 FROM v WINDOW o AS (PARTITION BY r ORDER BY n)),
w AS (SELECT r, doc_id, n, [n, n1, n2] AS ns, x || chr(10) || x1 || chr(10) || x2 AS t FROM c WHERE n2 IS NOT NULL
  UNION ALL SELECT r, doc_id, n, [n, n1], x || chr(10) || x1 FROM c WHERE n1 IS NOT NULL AND k + k1 >= 50
  UNION ALL SELECT r, doc_id, n, [n], x FROM c WHERE k >= 50),
m AS (SELECT t, min((doc_id, n)) AS first FROM w GROUP BY t),
g AS (SELECT DISTINCT r, unnest(ns) AS n FROM w JOIN m USING (t) WHERE (doc_id, n) > first),
k AS (SELECT l.r, string_agg(x, chr(10) ORDER BY l.n) AS kept FROM l ANTI JOIN g ON l.r = g.r AND l.n = g.n GROUP BY l.r),
e AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN e USING (r)
"""

#: op9_line_dedup_words is the earlier name of what op9_line_dedup does.
QUERIES = {"op9_line_dedup": op9_line_dedup, "op9_line_dedup_words": op9_line_dedup, "op9_line_dedup_runs": op9_line_dedup_runs}
ORACLE_SQL = {"op9_line_dedup": SQL_WORDS, "op9_line_dedup_words": SQL_WORDS, "op9_line_dedup_runs": SQL}
