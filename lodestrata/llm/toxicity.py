"""Toxicity by weak supervision.

Voters are lexicon entries (whole words, and beginnings of words, that labelled toxic texts have far more often than others), counts and densities
of the strongest entries and of all, and patterns of case and punctuation. A generative label model of a document's unknown class says how often each voter, and the label where there is one,
fires for either class (its accuracies), and how voters go together within a class: each voter's chance depends on one other voter, along the tree of
the strongest dependences in that class. Accuracies, trees and their pair chances are all fitted anew in each round of expectation maximisation over the votes of all documents that may be
learnt from. A logistic regression over entry counts is trained on the model's posterior labels, and scores every document.

Learnt from: `max_labelled` labelled rows (those with the least hashes) for the lexicon, votes of all rows not held out, and `max_train` of these rows' posteriors for the
regression. The lexicon has `max_entries` entries at most, the most telling ones; these numbers bound all that the driver holds. The LEXICON_VOTERS best entries vote each for itself, the
others through the counts of all. Held-out rows aren't learnt from in any way.

Null and empty texts have no entries and get a score like others. A null id is not held out and has no label. Repeated rows
are scored each for itself. Without labels of both kinds every score is the share of toxic labels (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, scratch
from lodestrata.llm import textscan as ts

BEGINNINGS = (4, 5, 6, 7, 8)
_WHOLE = np.uint64(0x9D39247E33776D41)
LEXICON_VOTERS = 40
#: Voters on whole documents, after those.
DOCUMENT_VOTERS = 18
VOTERS = LEXICON_VOTERS + DOCUMENT_VOTERS


def entries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, next shorter beginning's hash or 0) of each word and each of its beginnings; words of each document; a table of its characters' kinds."""
    w = ts.words(buf, off, ts.ALNUM, fold=True, hashed=False)
    doc = w.doc()
    docs, hashes, shorter, last = [], [], [], np.zeros(len(doc), np.uint64)
    for n in BEGINNINGS:
        ok = w.ends - w.starts >= n
        docs.append(doc[ok])
        hashes.append(ts.hash_pieces(w.buf, w.starts[ok], w.starts[ok] + n))
        shorter.append(last[ok])
        last[ok] = hashes[-1]
    docs.append(doc)
    hashes.append(ts.hash_pieces(w.buf, w.starts, w.ends) ^ _WHOLE)
    shorter.append(last)
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(shorter), w.counts(), _kinds(buf, off)


def _kinds(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Upper-case letters, exclamation and question marks, symbols, and all bytes of each document."""
    total = [np.concatenate([[0], np.cumsum(m)]) for m in ((buf >= 65) & (buf <= 90), (buf == 33) | (buf == 63), np.isin(buf, np.frombuffer(b"#*$%&|<>@", np.uint8)))]
    return np.stack([*(t[off[1:]] - t[off[:-1]] for t in total), np.diff(off)], axis=1)


class Lexicon:
    """Sorted hashes of entries and the precision of each."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weight = hashes[order], weight[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        best = np.argsort(-self.weight, kind="stable")[:LEXICON_VOTERS]
        self.voter = np.full(len(hashes), -1)
        self.voter[best] = np.arange(len(best))

    def hits(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, entry) of each occurrence of an entry."""
        c = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes):
            return c[:0], c[:0]
        at = np.minimum(np.searchsorted(self.hashes, h[c]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[c]
        return doc[c[ok]], at[ok]

    def read(self, buf: np.ndarray, off: np.ndarray):
        """(votes, document, entry, count): votes is a bit mask of each document, the others its entries."""
        doc, h, _, words, kinds = entries(buf, off)
        n = len(off) - 1
        d, e = self.hits(doc, h)
        key, count = np.unique(d * max(len(self.hashes), 1) + e, return_counts=True)
        d, e = key // max(len(self.hashes), 1), key % max(len(self.hashes), 1)
        strong = np.bincount(d, (self.voter[e] >= 0) * count, minlength=n) if len(e) else np.zeros(n)
        different = np.bincount(d, self.voter[e] >= 0, minlength=n) if len(e) else np.zeros(n)
        any_, kinds_of = (np.bincount(d, count, minlength=n), np.bincount(d, minlength=n)) if len(e) else (np.zeros(n), np.zeros(n))
        m, size = np.maximum(words, 1), np.maximum(kinds[:, 3], 1)
        fires = [different >= 1, different >= 2, different >= 4, different >= 8, strong / m >= 0.002, strong / m >= 0.01, strong / m >= 0.03, strong / m >= 0.08, kinds[:, 0] / size > 0.3, kinds[:, 1] / size > 0.03, kinds[:, 2] / size > 0.03, words < 30]
        fires += [kinds_of >= 3, kinds_of >= 6, kinds_of >= 12, any_ / m >= 0.02, any_ / m >= 0.05, any_ / m >= 0.12]
        mask = np.zeros(n, np.int64)
        for j, f in enumerate(fires):
            mask |= f.astype(np.int64) << (LEXICON_VOTERS + j)
        v = self.voter[e] if len(e) else e
        np.bitwise_or.at(mask, d[v >= 0], np.int64(1) << v[v >= 0])
        return mask, d, e, count


def spread_bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(VOTERS)) & 1).astype(float)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def mine(docs: DataFrame, labels: DataFrame, max_labelled: int, max_entries: int) -> Lexicon:
    """Entries by their frequency in labelled toxic and other texts; labels has doc_id and y."""
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    texts = docs.join(F.broadcast(sample), "doc_id").select("text", "y")

    def count(batches):
        have: dict[str, list] = {"h": [], "p": [], "pos": [], "neg": []}
        for batch in batches:
            buf, off = ts.raw(batch.column("text"))
            toxic = batch.column("y").to_numpy(zero_copy_only=False) > 0
            for lo, hi in ts.groups(off):
                doc, h, p, _, _ = entries(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                order = np.lexsort((doc, h))
                doc, h, p = doc[order], h[order], p[order]
                once = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(doc, prepend=-1) != 0))
                doc, h, p = doc[once], h[once], p[once]
                new = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
                if len(new):
                    of = toxic[lo + doc].astype(np.int64)
                    for k, v in (("h", h[new]), ("p", p[new]), ("pos", np.add.reduceat(of, new)), ("neg", np.add.reduceat(1 - of, new))):
                        have[k].append(v)
        if have["h"]:
            u, at, back = np.unique(np.concatenate(have["h"]), return_index=True, return_inverse=True)
            pos, neg = (np.bincount(back, np.concatenate(have[k])).astype(np.int64) for k in ("pos", "neg"))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate(have["p"])[at].view(np.int64)), pa.array(pos), pa.array(neg)], ["h", "p", "pos", "neg"])

    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    counted = texts.mapInArrow(count, "h long, p long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("p").alias("p")).where("pos >= 3")
    share = lambda c, y: (F.col(c) + 0.5) / F.lit(sizes.get(y, 0) + 1.0)
    p, q = share("pos", 1), share("neg", 0)
    # log odds in units of their error: frequent and precise entries first
    z = F.log(p / q) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    telling = counted.withColumn("z", z).where((F.col("z") > 2.5) & (p > 3 * q))
    # a word and its beginnings are up to six entries: the bound is kept after these are merged
    rows = telling.orderBy(F.desc("z"), "h").limit(8 * max_entries).toPandas()
    h, shorter = rows["h"].to_numpy(np.int64).view(np.uint64), rows["p"].to_numpy(np.int64).view(np.uint64)
    pos, neg, z = (rows[c].to_numpy(float) for c in ("pos", "neg", "z"))
    if not len(h):
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    order = np.argsort(h)
    h, pos, neg, z, shorter = h[order], pos[order], neg[order], z[order], shorter[order]
    # texts with an entry also have its beginnings: where one of these has the same numbers of texts, they are the same texts, and it is enough
    at = np.minimum(np.searchsorted(h, shorter), len(h) - 1)
    same = (h[at] == shorter) & (pos[at] == pos) & (neg[at] == neg)
    one = np.flatnonzero(~same)
    good = one if len(one) >= LEXICON_VOTERS else np.arange(len(h))
    good = good[np.argsort(-z[good], kind="stable")][:max_entries]
    return Lexicon(h[good], z[good])


class LabelModel:
    """For either class, each voter's parent in the tree (itself: none) and its chance to fire where that one doesn't and does; the share of class 1; how often labels are 1 in each class."""

    def __init__(self, parent: np.ndarray, fires: np.ndarray, share: float, label: np.ndarray):
        self.parent, self.fires, self.share, self.label = parent, fires, share, label

    def likelihood(self, x: np.ndarray, c: int) -> np.ndarray:
        """Log chance of each row of votes in class c."""
        p = np.where(x[:, self.parent[c]] > 0, self.fires[c, :, 1], self.fires[c, :, 0])
        return np.log(np.where(x > 0, p, 1 - p)).sum(axis=1)

    def posterior(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """y: the label, NaN where there is none."""
        odds = np.log(self.share / (1 - self.share)) + self.likelihood(x, 1) - self.likelihood(x, 0)
        say = np.where(np.isnan(y), 0.0, np.where(y > 0.5, np.log(self.label[1] / self.label[0]), np.log((1 - self.label[1]) / (1 - self.label[0]))))
        return 1 / (1 + np.exp(-np.clip(odds + say, -30, 30)))


def strongest_tree(both: np.ndarray, total: float) -> np.ndarray:
    """Parents in the tree of the largest mutual information between voters, from counts of voters that fire together; a root is its own parent."""
    n = len(both)
    one = np.diag(both)
    cells = np.stack([both, one[:, None] - both, one[None, :] - both, total - one[:, None] - one[None, :] + both])
    p = np.maximum(cells / max(total, 1e-9), 1e-12)
    share = np.clip(one / max(total, 1e-9), 1e-6, 1 - 1e-6)
    a, b = share[:, None], share[None, :]
    shared = (p * np.log(p / np.stack([a * b, a * (1 - b), (1 - a) * b, (1 - a) * (1 - b)]))).sum(axis=0)
    parent = np.arange(n)
    inside = np.zeros(n, bool)
    inside[0] = True
    best, of = shared[0].copy(), np.zeros(n, np.int64)
    for _ in range(n - 1):
        k = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[k], inside[k] = of[k], True
        closer = shared[k] > best
        best[closer], of[closer] = shared[k][closer], k
    return parent


def fitted(moments: np.ndarray, label: np.ndarray | None = None) -> LabelModel:
    """The model that fits weighted counts best: for either class, rows, rows with a label, labels that are 1, and pairs of voters that fire together."""
    s = moments.reshape(2, 3 + VOTERS * VOTERS)
    parents, fires = [], []
    for total, pairs in zip(s[:, 0], s[:, 3:].reshape(2, VOTERS, VOTERS), strict=True):
        parent, one, own = strongest_tree(pairs, total), np.diag(pairs), np.arange(VOTERS)
        alone = (one + 0.5) / (total + 1)
        with_ = (pairs[own, parent] + 2 * alone) / (one[parent] + 2)
        without = (one - pairs[own, parent] + 2 * alone) / (total - one[parent] + 2)
        root = parent == own
        parents.append(parent)
        fires.append(np.stack([np.where(root, alone, without), np.where(root, alone, with_)], axis=1))
    said = np.clip((s[:, 2] + 0.5) / (s[:, 1] + 1), 0.02, 0.98) if label is None else label
    return LabelModel(np.stack(parents), np.clip(np.stack(fires), 1e-4, 1 - 1e-4), float(np.clip(s[1, 0] / max(s[:, 0].sum(), 1), 1e-3, 1 - 1e-3)), said)


def counts_by_class(r: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What fitted() takes, of rows that are of class 1 with chance r."""
    known, said = ~np.isnan(y), np.nan_to_num(y)
    return np.concatenate([np.concatenate([[w.sum(), w[known].sum(), (w * said)[known].sum()], ((x * w[:, None]).T @ x).ravel()]) for w in ((1 - r) * n, r * n)])


def fit_label_model(votes: DataFrame, rounds: int = 6) -> LabelModel:
    """votes: mask, y (null: no label), n. Each round is one job that returns sums of fixed size, from which accuracies and correlations are fitted together."""

    def sums(chance) -> np.ndarray:
        width = 2 * (3 + VOTERS * VOTERS)

        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                mask, n = batch.column("mask").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                y = np.array([np.nan if v is None else float(v) for v in batch.column("y").to_pylist()])
                for a in range(0, len(mask), 20_000):
                    x, label = spread_bits(mask[a : a + 20_000]), y[a : a + 20_000]
                    r, weight = chance(x, label)
                    total += counts_by_class(r, x, label, weight * n[a : a + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], ["i", "v"])

        out = np.zeros(width)
        for r in votes.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    # begin with the labelled rows as they are labelled
    model = fitted(sums(lambda x, y: (np.nan_to_num(y), (~np.isnan(y)).astype(float))), np.array([0.05, 0.9]))
    for _ in range(rounds):
        model = fitted(sums(lambda x, y, model=model: (model.posterior(x, y), np.ones(len(y)))))
    return model


def fit_linear(doc: np.ndarray, entry: np.ndarray, value: np.ndarray, extra: np.ndarray, target: np.ndarray, size: int, ridge: float = 2.0, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression (entries, extra columns, bias) on soft labels, by accelerated gradient steps."""
    n = len(target)
    if not n:
        return np.zeros(size + extra.shape[1] + 1)

    def scores(w):
        return np.bincount(doc, w[entry] * value, minlength=n) + extra @ w[size:-1] + w[-1]

    # columns differ much in scale: steps are scaled by each one's curvature bound
    curve = np.concatenate([np.bincount(entry, value**2, minlength=size), (extra**2).sum(axis=0), [n]]) / 4 + ridge
    per_row = np.bincount(doc, value**2 > 0, minlength=n) + extra.shape[1] + 1
    rate = 1 / (curve * max(1.0, float(np.percentile(per_row, 99))))
    w = np.zeros(size + extra.shape[1] + 1)
    w[-1] = np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4))
    look, t = w.copy(), 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(scores(look), -30, 30))) - target
        grad = np.concatenate([np.bincount(entry, g[doc] * value, minlength=size), extra.T @ g, [g.sum()]]) + ridge * np.append(look[:-1], 0)
        new = look - rate * grad
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / s * (new - w), new, s
    return w


def features(lexicon: Lexicon, buf: np.ndarray, off: np.ndarray):
    """(votes, document, entry, value, extra columns): counts' logs, and what voters on whole documents say."""
    mask, d, e, count = lexicon.read(buf, off)
    return mask, d, e, np.log1p(count), spread_bits(mask)[:, LEXICON_VOTERS:]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_train: int = 20_000, max_entries: int = 4_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    texts = arrowmap.id_and_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    spark = docs.sparkSession
    shares = known.agg(F.avg("y"), F.count(F.lit(1))).first()
    if shares[0] in (None, 0.0, 1.0):
        constant = F.lit(float(shares[0] or 0.0))
        return texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), constant.alias("score"), (constant >= threshold).cast("int").alias("predicted"))
    lexicon = mine(texts, known, max_labelled, max_entries)
    shared = spark.sparkContext.broadcast(lexicon)
    learn = texts.where(~held_out(F.col("doc_id")))
    voted = arrowmap.with_text_columns(learn, "text", lambda b, o: (shared.value.read(b, o)[0],), {"_mask": "long"}, keep_text=False)
    votes = scratch.keep(voted.join(known, "doc_id", "left").groupBy(F.col("_mask").alias("mask"), "y").agg(F.count(F.lit(1)).alias("n")), "votes")
    model = fit_label_model(votes)

    sample = learn.join(known, "doc_id", "left").select("text", "y", F.xxhash64("doc_id", "text").alias("at"))
    total = votes.agg(F.sum("n")).first()[0] or 1
    few = sample.where(F.pmod("at", F.lit(1 << 30)) < int(min(1.0, max_train / total) * (1 << 30)))

    def collect(batches):
        for batch in batches:
            buf, off = ts.raw(batch.column("text"))
            for lo, hi in ts.groups(off):
                mask, d, e, v, _ = features(shared.value, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at = np.searchsorted(d, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("at").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(mask), pa.array([e[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64())), pa.array([v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.float64()))], ["at", "y", "mask", "e", "v"])

    # rows that repeat share a hash: the bound holds for rows
    rows = few.mapInArrow(collect, "at long, y int, mask long, e array<long>, v array<double>").orderBy("at", "y", "mask").limit(max_train).toPandas()
    mask = rows["mask"].to_numpy(np.int64)
    target = model.posterior(spread_bits(mask), rows["y"].to_numpy(float))
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows["e"]])
    flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in rows[c]]) if len(rows) else np.zeros(0, kind)
    size = max(len(lexicon.hashes), 1)
    weights = spark.sparkContext.broadcast(fit_linear(doc, flat("e", np.int64), flat("v", float), spread_bits(mask)[:, LEXICON_VOTERS:], target, size))

    def scored(buf, off):
        _, d, e, v, extra = features(shared.value, buf, off)
        w = weights.value
        z = np.bincount(d, w[e] * v, minlength=len(off) - 1) + extra @ w[size:-1] + w[-1]
        return (1 / (1 + np.exp(-np.clip(z, -30, 30))),)

    out = arrowmap.with_text_columns(texts, "text", scored, {"_score": "double"}, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
