"""N-gram Jaccard join of documents by blocked sparse matrix products.

Documents are rows and distinct word n-grams columns of an incidence matrix; overlap counts are entries of its product with
its transpose. The product is made in blocks that can hold linked pairs only, and pairs below the bounds that their sizes imply are discarded:

1. Documents with equal sets form a class; only one of each goes on.
2. Columns are put in one global order: by hash, with the most frequent ones last, in the order of how often documents have them. Two linked sets share a column among the first n - ceil(t n) + 1
   of each (their prefixes). Prefix columns that one class only has are dropped.
3. Blocks of classes that agree in the least hash of their prefix columns, in tiles that share a leading document,
   are multiplied whole, and a spanning forest of the links found is kept. No pairs of a block leave its task.
4. What is left are pairs that share a prefix column and aren't connected yet. Classes that crowd on columns and share several of these with their least class make clusters, which are multiplied whole, in pairs of
   tiles. Other pairs' overlap counts in the prefixes are accumulated over all columns, only across classes that aren't connected; a column of many classes is dealt over
   tasks in pairs of bounded parts. A pair stays if its count with all that may follow reaches the overlap its sizes need. Those left are multiplied as in 3.

Columns are hashes of n-grams of one family, and are used to find pairs; the overlaps of pairs that are multiplied count hashes of another family, whose
keys are its own. Tiles are bounded by rows and by the sizes of their sets.

So every linked pair has been multiplied, or was connected by links already.

Words are runs of characters other than ASCII white space, A-Z folded; a text of fewer words than n is one n-gram. Null text and text
without words have an empty set and link with nothing. A null id takes part, but names no component unless all ids are null. Repeated rows are each returned. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import components, scratch
from lodestrata.llm import hashruns as hr
from lodestrata.llm import textscan as ts

GROUP_BYTES = 12 << 20
RANGE_HASHES = 1_000_000
TILE = 1000
#: N-grams of all sets of a tile.
TILE_HASHES = 2_000_000
#: So many columns at most, the most frequent, are broadcast with their frequencies to go last: it bounds the broadcast, not what is compared.
MOST_COMMON = 1 << 20
#: Columns in under one of so many documents, of no more than one part of classes, needn't go last.
RARE = 1000
#: Step 3 takes classes that share this part of their prefix columns at least; step 4 takes all.
LIKELY = 0.4
#: A column that more likely classes share is crowded.
CROWD = 64
#: So many crowded columns in common with the least class of each make a class one of its cluster. To count a pair on fewer costs less than to multiply it, and chance would chain all classes.
CROWD_SHARES = 8
#: Classes of a column that one task pairs; a column of more is dealt in parts.
COLUMN_PART = 2048
#: Documents of a group that must have a column for it to be counted.
COMMON_HERE = 3
#: Pairs that a task holds before it counts them, and rows that it hands over at once.
PENDING, AT_ONCE = 2_000_000, 1 << 16
#: Blocks and tiles that one set goes to.
PLACES = pa.list_(pa.struct([("block", pa.int64()), ("tile", pa.int64())]))


def shingles(buf: np.ndarray, off: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct n-grams, ordered by both."""
    w = ts.words(buf, off, ts.SPACED, fold=True, hashed=not which)
    hashes = w.second() if which else w.hash
    at, h = ts.windows(hashes, w.first, n, which)
    doc = np.searchsorted(w.first, at, "right") - 1
    counts = w.counts()
    for k in range(1, n):
        if (few := np.flatnonzero(counts == k)).size:
            a, x = ts.windows(hashes, w.first, k, which)
            d = np.searchsorted(w.first, a, "right") - 1
            ok = np.isin(d, few)
            doc, h = np.concatenate([doc, d[ok]]), np.concatenate([h, x[ok]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


class Common:
    """The most frequent columns, sorted, and the place of each one's frequency among powers of two."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.tier = hashes[order], np.log2(np.maximum(docs[order], 1)).astype(np.uint8) + np.uint8(1)
        self.bits = np.zeros(1 << 24, bool)
        self.bits[(self.hashes >> ts.U(40)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        """0 for a column that isn't common."""
        tier = np.zeros(len(h), np.uint8)
        may = np.flatnonzero(self.bits[(h >> ts.U(40)).astype(np.int64)])
        if len(may) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
            tier[may] = np.where(self.hashes[at] == h[may], self.tier[at], 0)
        return tier


def overlap_needed(total, num: int, den: int):
    """The least overlap of two linked sets whose sizes add up to total."""
    return -(-num * total // (num + den))


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def product(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the first set of its component under the links of these sets. Counts of rare columns are added pair by pair, others as dense blocks."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    column = np.concatenate(sets)
    order = np.argsort(column, kind="stable")
    doc, column = np.repeat(np.arange(m, dtype=np.int32), size)[order], column[order]
    del order
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), column[1:] != column[:-1]])[: len(column)])
    df = np.diff(start, append=len(column))
    del column
    overlap = np.zeros((m, m), np.float32)
    for k in range(2, min(8, m) + 1):
        rows = doc[start[df == k][:, None] + np.arange(k)].astype(np.int64)
        for i in range(k if len(rows) else 0):
            for j in range(i + 1, k):
                overlap += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m).reshape(m, m)
    overlap += overlap.T
    dense = np.flatnonzero(df > 8)
    for lo in range(0, len(dense), 2048):
        part = dense[lo : lo + 2048]
        block = np.zeros((m, len(part)), np.float32)
        block[doc[ts.spread(start[part], df[part])], np.repeat(np.arange(len(part)), df[part])] = 1
        overlap += block @ block.T
    link = np.empty((m, m), bool)
    for lo in range(0, m, 256):
        link[lo : lo + 256] = (num + den) * overlap[lo : lo + 256].astype(np.int64) >= num * (size[lo : lo + 256, None] + size[None, :])
    del overlap
    np.fill_diagonal(link, True)
    label = np.arange(m)
    while True:
        new = np.concatenate([np.where(link[lo : lo + 256], label[None, :], m).min(axis=1) for lo in range(0, m, 256)])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def prefixes(table: pa.Table, common: Common, rows: np.ndarray, n: int, num: int, den: int):
    """(row, column hash, place of the column in the order, size of the set) of the prefixes of some rows of a group. Places may tie, but never swap."""
    table = hr.in_order(table)
    buf, off = ts.raw(table.column("text"))
    wanted = np.zeros(table.num_rows, bool)
    wanted[rows] = True
    for lo, hi in ts.groups(off):
        if not wanted[lo:hi].any():
            continue
        doc, h = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
        ok = wanted[lo + doc]
        doc, h = doc[ok], h[ok]
        tier = common.of(h)
        order = np.argsort((doc << 8) | tier, kind="stable")  # hashes ascend within a document and tier
        doc, h, tier = doc[order], h[order], tier[order]
        count = np.bincount(doc, minlength=hi - lo)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        ok = place < prefix_length(count[doc], num, den)
        yield doc[ok] + lo, h[ok], (tier[ok].astype(np.int64) << 56) | (h[ok] >> ts.U(8)).view(np.int64), count[doc[ok]]


def across(group: np.ndarray, unit: np.ndarray, n: np.ndarray, num: int, den: int, most: int = 1_000_000):
    """Pairs (i, j) of entries of one group and different units whose sizes may link, in parts of about `most` pairs."""
    if not len(group):
        return
    order = np.lexsort((unit, group))
    g, u = group[order], unit[order]
    last = np.append((g[1:] != g[:-1]), True)
    ends = np.flatnonzero(last) + 1
    group_end = np.repeat(ends, np.diff(np.append(0, ends)))
    stops = np.flatnonzero(last | np.append(u[1:] != u[:-1], True)) + 1
    after = np.repeat(stops, np.diff(np.append(0, stops)))  # where the next unit begins, or the group ends
    many = group_end - after
    total = np.cumsum(many)
    lo = 0
    while lo < len(g):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = ts.spread(after[lo:hi], many[lo:hi])
        i, j = order[i], order[j]
        ok = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
        yield i[ok], j[ok]
        lo = hi


class Join:
    """One join of `docs`; its steps share the grouped store of texts."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, group_bytes: int, tile: int, range_hashes: int, step_bits: int | None = None, carry: bool = False):
        self.n, self.num, self.den, self.tile = n, num, den, tile
        self.names = (id_col, text_col)
        others = [F.col(f"`{c}`") for c in docs.columns if c not in self.names]
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*others).alias("others")] if carry and others else []))
        self.total, count = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
        self.meeting = hr.Meeting(self.total // 40, (self.total + 16 * count) // group_bytes + 1, range_hashes, {"several": "u1"}, step_bits=step_bits)
        self.stored = hr.grouped_table(texts, "jaccard_texts", group_bytes, total=self.total)
        self.store = self.stored.select("doc_id", "text", "grp", "row")
        self.id_type = texts.schema["doc_id"].dataType.simpleString()

    def describe(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, rid, n, sig of each row; column, docs of columns that several documents of a group have)."""
        n, id_type = self.n, self.id_type

        def run(table: pa.Table) -> pa.Table:
            table = hr.in_order(table)
            buf, off = ts.raw(table.column("text"))
            grp = table.column("grp")[0].as_py()
            size, sig, seen = [], [], []
            for lo, hi in ts.groups(off):
                doc, h = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                count = np.bincount(doc, minlength=hi - lo)
                sums = []
                # a set is known by the sums of both families' hashes
                for d, x in ((doc, h), shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n, which=1)):
                    total = np.concatenate([np.zeros(1, ts.U), np.cumsum(ts.mix(x), dtype=ts.U)])
                    at = np.searchsorted(d, np.arange(hi - lo + 1))
                    sums.append(total[at[1:]] - total[at[:-1]])
                size.append(count)
                sig += [bytes(x) for x in np.stack(sums, axis=1)]
                seen.append(h)
            u, here = np.unique(np.concatenate(seen), return_counts=True)
            often = here >= COMMON_HERE
            u, here = u[often], here[often]
            rows, cols = table.num_rows, len(u)
            null = lambda k, kind: pa.nulls(k, kind)
            ids = table.column("doc_id").combine_chunks()
            cat = lambda a, b: pa.concat_arrays([a, b])
            return pa.table({
                "doc_id": cat(ids, null(cols, ids.type)), "rid": cat(pa.array((grp << 20) + np.arange(rows), pa.int64()), null(cols, pa.int64())), "n": cat(pa.array(np.concatenate(size), pa.int64()), null(cols, pa.int64())), "sig": cat(pa.array(sig, pa.binary()), null(cols, pa.binary())),
                "column": cat(null(rows, pa.int64()), pa.array(u.view(np.int64))), "docs": cat(null(rows, pa.int64()), pa.array(here, pa.int64()))})

        both = scratch.keep(self.store.groupBy("grp").applyInArrow(run, f"doc_id {id_type}, rid long, n long, sig binary, column long, docs long"), "jaccard-info")
        return both.where("rid is not null").select("doc_id", "rid", "n", "sig"), both.where("rid is null").select("column", "docs")

    def common(self, columns: DataFrame, documents: int) -> Common:
        """Columns that go last: those from a power of two of documents on, the least that isn't rare and that at most MOST_COMMON columns reach."""
        columns = scratch.keep(columns.groupBy("column").agg(F.sum("docs").alias("docs")), "jaccard-columns")
        tiers = {r["tier"]: r["n"] for r in columns.groupBy(F.floor(F.log2("docs")).alias("tier")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
        left, least, rare = MOST_COMMON, 63, int(np.ceil(np.log2(max(COMMON_HERE, min(documents / RARE, COLUMN_PART)))))
        while least > rare and left >= tiers.get(least - 1, 0):
            least -= 1
            left -= tiers.get(least, 0)
        got = columns.where(F.col("docs") >= 1 << least).toArrow()
        return Common(got.column("column").to_numpy().view(ts.U), got.column("docs").to_numpy())

    def candidates(self, reps: DataFrame, common: Common) -> DataFrame:
        """rid, n, last (place of the prefix's last column), columns (those of the prefix that another class has in its own) of each class's row with any."""
        shared = self.store.sparkSession.sparkContext.broadcast(common)
        meeting, how = self.meeting, (self.n, self.num, self.den)

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return meeting.none()
            rows = np.asarray(right.column("rid")) & 0xFFFFF
            hashes = [h for _, h, _, _ in prefixes(left, shared.value, rows, *how)]
            u, times = np.unique(np.concatenate(hashes), return_counts=True)
            return meeting.send(right.column("grp")[0].as_py(), u, several=times > 1)

        def repeated(h: np.ndarray, others: dict) -> tuple[np.ndarray, dict]:
            order = np.argsort(h, kind="stable")
            same = np.concatenate([[False], h[order][1:] == h[order][:-1], [False]])
            mask = np.zeros(len(h), bool)
            mask[order] = same[:-1] | same[1:]
            return mask | (others["several"] > 0), {}

        def take(left: pa.Table, right: pa.Table) -> pa.Table:
            rid, size, last, columns = [], [], [], []
            if left.num_rows and right.num_rows:
                rids = right.column("rid").drop_null()
                live, _ = meeting.answers(right.filter(right.column("rid").is_null()))
                if len(live) and len(rids):
                    rows = rids.to_numpy() & 0xFFFFF
                    grp = right.column("grp")[0].as_py()
                    for doc, h, place, count in prefixes(left, shared.value, rows, *how):
                        ok = hr.member(h, live)
                        if not ok.any():
                            continue
                        place = place[np.searchsorted(doc, doc[ok], "right") - 1]
                        doc, h, count = doc[ok], h[ok], count[ok]
                        new = np.flatnonzero(np.diff(doc, prepend=-1))
                        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(doc)], strict=True):
                            rid.append((grp << 20) + int(doc[a]))
                            size.append(int(count[a]))
                            last.append(int(place[a]))
                            columns.append(h[a:b].view(np.int64))
            return pa.table({"rid": pa.array(rid, pa.int64()), "n": pa.array(size, pa.int64()), "last": pa.array(last, pa.int64()), "columns": pa.array(columns, pa.list_(pa.int64()))})

        mine = reps.select(F.shiftright("rid", 20).alias("grp"), "rid")
        packets = self.store.groupBy("grp").cogroup(mine.groupBy("grp")).applyInArrow(probe, meeting.SCHEMA)
        side = meeting.met(packets, repeated).unionByName(mine, allowMissingColumns=True)
        return scratch.keep(self.store.groupBy("grp").cogroup(side.groupBy("grp")).applyInArrow(take, "rid long, n long, last long, columns array<long>"), "jaccard-candidates")

    def links(self, members: DataFrame, whole: bool = False) -> DataFrame:
        """u, v: a spanning forest of the links within each block of members(block, rid, n).

        Blocks are multiplied in tiles that share the block's least rid, or (whole) in pairs of tiles, so that every pair of rows meets. A tile is bounded by
        rows and by n-grams.
        """
        n, num, den, tile = self.n, self.num, self.den, self.tile
        sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total"), F.min("rid").alias("lead")).where("count > 1")
        sizes = sizes.withColumn("tiles", F.greatest(F.ceil((F.col("count") - F.lit(0 if whole else 1)) / tile), F.ceil(F.col("total") / TILE_HASHES)).cast("int"))
        placed = members.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
        if whole:
            # tile i meets tile j in block part (i, j); one tile meets itself
            other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
            pair = F.least("own", "other").cast("long") * F.col("tiles") + F.greatest("own", "other")
            wanted = placed.select("block", "rid", "own", "tiles", other).select("block", pair.alias("tile"), "rid")
        else:
            leads = sizes.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)).alias("tile"), F.col("lead").alias("rid"))
            wanted = placed.where("rid <> lead").select("block", F.col("own").cast("long").alias("tile"), "rid").unionByName(leads)
        wanted = wanted.select(F.shiftright("rid", 20).alias("grp"), "block", "tile", "rid")

        def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
            """Each wanted row's set once, with the places that it goes to: however many these are, texts and sets are those of the group."""
            rids, sets, places = [], [], pa.array([], PLACES)
            if left.num_rows and right.num_rows:
                right = right.sort_by("rid")
                rid = right.column("rid").to_numpy()
                new = np.flatnonzero(np.diff(rid, prepend=rid[0] - 1))
                rids, rows = rid[new], rid[new] & 0xFFFFF
                place = pa.StructArray.from_arrays([right.column(c).combine_chunks() for c in ("block", "tile")], ["block", "tile"])
                places = pa.ListArray.from_arrays(pa.array([*new, len(rid)], pa.int32()), place)
                texts = hr.in_order(left).column("text").take(pa.array(rows))
                buf, off = ts.raw(texts)
                for lo, hi in ts.groups(off):
                    doc, h = shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n, which=1)
                    at = np.searchsorted(doc, np.arange(hi - lo + 1))
                    sets += [np.int64(y - x).tobytes() + hr.dump(h[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return pa.table({"rid": pa.array(rids, pa.int64()), "columns": pa.array(sets, pa.binary()), "places": places})

        def multiply(table: pa.Table) -> pa.Table:
            table = table.sort_by("rid")
            rid = table.column("rid").to_numpy()
            sets = [hr.load(x[8:], int(np.frombuffer(x[:8], np.int64)[0])) for x in (x.as_py() for x in table.column("columns"))]
            label = product(sets, num, den)
            ok = label != np.arange(len(label))
            return pa.table({"u": pa.array(rid[ok]), "v": pa.array(rid[label[ok]])})

        fetched = self.store.groupBy("grp").cogroup(wanted.groupBy("grp")).applyInArrow(fetch, "rid long, columns binary, places array<struct<block: long, tile: long>>")
        fetched = fetched.select("rid", "columns", F.explode("places").alias("place")).select("place.block", "place.tile", "rid", "columns")
        return scratch.keep(fetched.groupBy("block", "tile").applyInArrow(multiply, "u long, v long"), "jaccard-links")

    def likely(self):
        """Whether a class shares so much of its prefix that most of its links are with others that do."""
        return F.size("columns") >= F.expr(f"{LIKELY} * (n - (n * {self.num} + {self.den - 1}) div {self.den} + 1)")

    def left_over(self, found: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What may still link: (block, rid of clusters, u and v of pairs).

        Columns that many likely classes share connect to clusters those that share several of them with the least class there; rows of a cluster must all meet. Other pairs that share a column and aren't connected are pairs
        if the columns that they share and those beyond the prefix that ends first may reach the overlap that their sizes need: a shared column is in both prefixes or beyond that one.
        """
        num, den = self.num, self.den
        entries = found.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", "n", "last", F.size("columns").cast("long").alias("shared"), self.likely().alias("likely"), F.coalesce("root", "rid").alias("root"), F.explode("columns").alias("column"))
        entries = scratch.keep(entries, "jaccard-entries")
        likely = F.col("likely")
        # counted by column and root first: a column that many share is combined before it meets
        by_root = entries.groupBy("column", "root").agg(F.count(F.lit(1)).alias("rows"), F.count_if("likely").alias("crowded"), F.min(F.when(F.col("likely"), F.col("rid"))).alias("lead"))
        open_ = by_root.groupBy("column").agg(F.min("root").alias("a"), F.max("root").alias("b"), (F.sum("crowded") > CROWD).alias("crowd"), F.min("lead").alias("lead"), F.sum("rows").alias("rows")).where("a <> b")
        entries = scratch.keep(entries.join(open_.drop("a", "b"), "column"), "jaccard-open-entries")
        crowds = entries.where("crowd and likely")
        alike = crowds.where("rid <> lead").groupBy("rid", "lead").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= CROWD_SHARES)
        clusters = components.components(alike.select(F.col("rid").alias("u"), F.col("lead").alias("v")))
        members = clusters.select(F.col("root").alias("block"), F.col("node").alias("rid")).unionByName(clusters.select(F.col("root").alias("block"), F.col("root").alias("rid")).distinct())
        members = scratch.keep(members.join(found.select("rid", "n"), "rid").select("block", "rid", "n"), "jaccard-clusters")
        # rows of one cluster meet there, those of one root are connected: rows of one unit needn't meet
        unit = F.coalesce(2 * F.col("cluster") + 1, 2 * F.col("root"))
        tasks = scratch.parts_for(entries.count(), 100_000, 8)
        entries = entries.join(members.select("rid", F.col("block").alias("cluster")), "rid", "left").select("rid", "n", "last", "shared", "root", "column", unit.alias("unit"), "rows")
        none = F.lit(0)
        light = entries.where(F.col("rows") <= COLUMN_PART).drop("rows").select("*", none.alias("own"), none.alias("p"), none.alias("q"), F.pmod(F.xxhash64("column"), F.lit(tasks)).alias("task"))
        # a column of many: the unit that most have is one side, which doesn't meet itself, and is dealt in parts as others are; each pair of parts is a task's
        heavy = entries.where(F.col("rows") > COLUMN_PART)
        by_unit = heavy.groupBy("column", "unit").agg(F.count(F.lit(1)).alias("of_unit")).groupBy("column").agg(F.sum("of_unit").alias("all"), F.max(F.struct("of_unit", "unit")).alias("main"))
        part = lambda rows: F.ceil(rows / COLUMN_PART).cast("int")
        sides = by_unit.where(F.col("all") > F.col("main.of_unit")).select("column", F.col("main.unit").alias("main"), part(F.col("main.of_unit")).alias("main_parts"), part(F.col("all") - F.col("main.of_unit")).alias("other_parts"))
        others = F.col("other_parts")
        own = F.when(F.col("unit") == F.col("main"), others + F.pmod(F.xxhash64("rid"), F.col("main_parts"))).otherwise(F.pmod(F.xxhash64("rid"), others)).cast("int")
        placed = heavy.join(sides, "column").withColumn("own", own)
        meets = F.when(F.col("own") >= others, F.sequence(none, others - 1)).otherwise(F.sequence(none, others + F.col("main_parts") - 1))
        placed = placed.withColumn("with", F.explode(meets)).select("rid", "n", "last", "shared", "root", "column", "unit", "own", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"))
        entries = light.unionByName(placed.withColumn("task", F.xxhash64("column", "p", "q")))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("column", "p", "q", "rid")])  # columns in parts are groups
            rid, n, last, shared, root, unit, column, own, p, q = (table.column(c).to_numpy() for c in ("rid", "n", "last", "shared", "root", "unit", "column", "own", "p", "q"))
            beyond = n - prefix_length(n, num, den)

            def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                """How many columns two prefixes must share."""
                after = np.where(last[i] < last[j], beyond[i], np.where(last[j] < last[i], beyond[j], np.maximum(beyond[i], beyond[j])))
                return overlap_needed(n[i] + n[j], num, den) - after

            group = np.cumsum((np.diff(column, prepend=column[:1]) != 0) | (np.diff(p, prepend=p[:1]) != 0) | (np.diff(q, prepend=q[:1]) != 0))
            ids, first, row = np.unique(rid, return_index=True, return_inverse=True)

            def combined(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                pair, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
                for lo in range(0, max(len(pair), 1), AT_ONCE):
                    a, b = np.divmod(pair[lo : lo + AT_ONCE], max(len(ids), 1))
                    i, j = first[a], first[b]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[i], rid[j], n[i], n[j], least(i, j), c[lo : lo + AT_ONCE])], ["u", "v", "nu", "nv", "least", "c"])

            parts, pending = [], 0
            for i, j in across(group, unit, n, num, den):
                may = np.minimum(shared[i], shared[j]) >= least(i, j)
                may &= root[i] != root[j]
                may &= (own[i] != own[j]) | (p[i] == q[i])  # two of one part meet in its part with itself
                a, b = row[i[may]], row[j[may]]
                parts.append(np.minimum(a, b) * len(ids) + np.maximum(a, b))
                pending += len(a)
                if pending > PENDING:
                    yield from combined(parts)
                    parts, pending = [], 0
            yield from combined(parts)

        pairs = entries.groupBy("task").applyInArrow(count, "u long, v long, nu long, nv long, least long, c long").groupBy("u", "v", "nu", "nv", "least").agg(F.sum("c").alias("c"))
        return members, pairs.where(F.col("c") >= F.col("least"))

    def run(self) -> DataFrame:
        info, columns = self.describe()
        classes = scratch.keep(info.where("n > 0").groupBy("sig", "n").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least")), "jaccard-classes")
        found = self.candidates(classes, self.common(columns, info.count()))
        links = self.links(found.where(self.likely()).select(F.array_min(F.transform("columns", lambda c: F.xxhash64(c))).alias("block"), "rid", "n"))
        members, pairs = self.left_over(found, components.components(links))
        links = links.unionByName(self.links(members, whole=True))
        # a block of each smaller row's partners
        pairs = scratch.keep(pairs, "jaccard-pairs")
        partners = pairs.select(F.col("u").alias("block"), F.col("v").alias("rid"), F.col("nv").alias("n"))
        links = links.unionByName(self.links(partners.unionByName(pairs.select(F.col("u").alias("block"), F.col("u").alias("rid"), F.col("nu").alias("n")).distinct())))
        roots = components.components(links)
        linked = classes.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        by_class = linked.join(names, "root").select("sig", F.col("n").alias("class_n"), "component_id", "root")
        out = info.join(by_class, (info["sig"] == by_class["sig"]) & (info["n"] == F.col("class_n")), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), info["rid"].alias("rid"), "root")

    def rows(self, kept: DataFrame, columns: list[str]) -> DataFrame:
        """The stored rows whose rid is in kept, as they came."""
        names = [c for c in self.stored.columns if c not in ("grp", "row")]

        def pick(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.select(names).slice(0, 0)
            return hr.in_order(left).select(names).take(pa.array(np.sort(np.asarray(right.column("rid")) & 0xFFFFF)))

        wanted = kept.select(F.shiftright("rid", 20).alias("grp"), "rid")
        schema = self.stored.select(*names).schema
        out = self.stored.groupBy("grp").cogroup(wanted.groupBy("grp")).applyInArrow(pick, schema)
        own = dict(zip(self.names, ("doc_id", "text"), strict=True))
        return out.select(*[F.col(own[c]).alias(c) if c in own else F.col(f"others.`{c}`").alias(c) for c in columns])


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, tile: int = TILE, range_hashes: int = RANGE_HASHES, step_bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two rows link when den * |intersection| >= num * |union| of their n-gram sets."""
    return Join(docs, n, num, den, id_col, text_col, group_bytes, tile, range_hashes, step_bits).run().drop("rid", "root")


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are their component's first: the least id, and of rows that share it the first stored. Rows with an empty set all stay.

    The join's store carries all columns, and kept rows are picked from it where they lie.
    """
    settings = {"group_bytes": GROUP_BYTES, "tile": TILE, "range_hashes": RANGE_HASHES} | options
    join = Join(docs, n, num, den, id_col, text_col, **settings, carry=True)
    found = scratch.keep(join.run(), "jaccard-components")
    # a component is named by its root row: ids may be null or repeated
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    kept = first.unionByName(found.where("n_shingles = 0").select("rid"))
    return join.rows(kept, docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scratch.settle(lambda: link(docs, n=4, num=85, den=100), "jaccard-result")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
c(r, q) AS (SELECT r, r FROM d UNION SELECT c.r, l.y FROM c JOIN l ON l.x = c.q)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE m.component_id END AS component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(e.doc_id) AS component_id FROM c JOIN d e ON e.r = c.q GROUP BY c.r) m USING (r)
"""

QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLE_SQL = {"op6_ngram_jaccard": SQL}
