"""Quality rules: gradient-boosted trees over document statistics.

Statistics of each whole text come from one pass over its bytes. The trees are grown on histograms of at most
`max_labelled` labelled rows (the ones with the smallest hashes of their ids, labels and documents both), with monotonic constraints on chosen statistics,
and flattened into node arrays, with which tasks score whole batches at once.

Null text has no words. Null and repeated ids: each row is judged for itself; labels with a null id or a null label
aren't learnt from. Without labels of both kinds every document that the base rules pass is kept. An empty table gives an empty result.
Extra columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap
from lodestrata.llm import textscan as ts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that trees see, and the direction in which quality may go as each grows (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "punctuation_share": 0, "exclamation_share": -1, "non_ascii_share": 0, "line_words": 0, "distinct_trigrams": 1}
_SPACE, _NEWLINE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _EXCLAIM, _PUNCT, _CONT, _LEAD = range(10)


def _class(b: int) -> int:
    if b == 10:
        return _NEWLINE
    if not ts.SPACED[b]:
        return _SPACE
    if b >= 128:
        return _CONT if b < 192 else _LEAD
    c = chr(b)
    return _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit() else _SYMBOL if c in "#*$%&|<>" else _EXCLAIM if c == "!" else _PUNCT


_CLASSES = np.array([_class(b) for b in range(256)], np.int64)


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base statistics, features): a row for each document."""
    docs = len(off) - 1
    w = ts.words(buf, off, hashed=False)
    n = w.counts()
    kind = np.zeros(docs * 10, np.int64)
    for a in range(0, len(buf), 1 << 22):  # a very long document goes a part at a time
        part = buf[a : a + (1 << 22)]
        doc = np.searchsorted(off, np.arange(a, a + len(part)), "right") - 1 if docs > 1 else 0
        kind += np.bincount(doc * 10 + _CLASSES[part], minlength=docs * 10)
    kind = kind.reshape(docs, 10)
    chars = kind[:, _UPPER:].sum(axis=1) - kind[:, _CONT]

    breaks = np.flatnonzero(buf == 10)
    starts = np.union1d(breaks + 1, off[:-1])
    starts = starts[starts < len(buf)]
    ends = np.empty(len(starts), np.int64)
    nxt = np.append(starts[1:], len(buf))
    ends[:] = nxt
    closing = nxt[(nxt > 0)] - 1
    ends -= (buf[closing] == 10) & (nxt > starts)
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(off, starts, "right") - 1
    _, later = ts.again(ts.classes(buf, starts, ends), line_doc)
    lines = np.bincount(line_doc, minlength=docs)
    dup = np.bincount(line_doc[later], minlength=docs)

    said = ts.classes(buf, w.starts, w.ends)
    at = ts.spread(w.first[:-1], np.maximum(n - 2, 0))
    at_doc = np.searchsorted(w.first, at, "right") - 1
    again, repeated = ts.again(ts.runs_of(said, at, 3), at_doc)
    repeat = ts.per_document(ts.covered(at[again], 3, len(w.starts)), w.first)
    windows = np.bincount(at_doc, minlength=docs)
    distinct = windows - np.bincount(at_doc[repeated], minlength=docs)

    base = np.stack([n, chars, kind[:, _SYMBOL], dup, repeat], axis=1)
    c, m = np.maximum(chars, 1), np.maximum(n, 1)
    features = np.stack([np.log1p(n), chars / m, kind[:, _SYMBOL] / c, dup / np.maximum(lines, 1), repeat / m, kind[:, _UPPER] / c, kind[:, _DIGIT] / c, kind[:, _PUNCT] / c, kind[:, _EXCLAIM] / c, kind[:, _LEAD] / c, n / np.maximum(lines, 1), distinct / np.maximum(windows, 1)], axis=1)
    return base.astype(np.int64), features


class Trees:
    """Node arrays of all trees; a leaf's children are itself."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.roots, self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], [], []

    def node(self) -> int:
        i = len(self.feature)
        for a, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, i), (self.right, i), (self.value, 0.0)):
            a.append(v)
        return i

    def flatten(self) -> Trees:
        for name in ("roots", "feature", "threshold", "left", "right", "value"):
            setattr(self, name, np.asarray(getattr(self, name)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 20, ridge: float = 1.0) -> Trees:
    """Logistic boosting on histograms. A split against a direction is not made, and the subtrees of one along it are held on their sides of its middle."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))), depth)
    f = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)

        def grow(rows: np.ndarray, level: int, lo: float, hi: float, g=g, h=h) -> int:
            i = model.node()
            gs, hs = g[rows].sum(), h[rows].sum()
            own = float(np.clip(gs / (hs + ridge), lo, hi))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, v, minlength=len(e) + 1))[:-1] for v in (g[rows], h[rows], None))
                    vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip((gs - gl) / (hs - hl + ridge), lo, hi)
                    gain = vl * gl - 0.5 * vl**2 * (hl + ridge) + vr * (gs - gl) - 0.5 * vr**2 * (hs - hl + ridge) - (own * gs - 0.5 * own**2 * (hs + ridge))
                    gain[(nl < least) | (len(rows) - nl < least) | (directions[j] * (vr - vl) < 0)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                model.value[i] = rate * own
                f[rows] += rate * own
                return i
            j, k, vl, vr = best[1]
            goes = binned[rows, j] <= k
            mid = (vl + vr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[directions[j]]
            model.feature[i], model.threshold[i] = j, float(edges[j][k])
            model.left[i] = grow(rows[goes], level + 1, *bounds[0])
            model.right[i] = grow(rows[~goes], level + 1, *bounds[1])
            return i

        model.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    return model.flatten()


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Trees | None:
    """Trees fitted on at most max_labelled labelled rows; None without labels of both kinds."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    texts = arrowmap.id_and_text(docs, id_col, text_col).join(F.broadcast(rows), "doc_id")
    added = {f"_{f}": "double" for f in FEATURES}
    read = arrowmap.with_text_columns(texts, "text", lambda b, o: tuple(statistics(b, o)[1].T.copy()), added, keep_text=False)
    # an id may be that of many rows: the bound holds for rows too
    got = read.orderBy(F.xxhash64("doc_id", "y", *added), "doc_id", "y", *added).limit(max_labelled).toPandas()
    y = got["y"].to_numpy()
    if not (y > 0.5).any() or not (y <= 0.5).any():
        return None
    return fit(got[list(added)].to_numpy(), y, list(FEATURES.values()), **options)


def judge(docs: DataFrame, model: Trees | None, threshold: float = 0.5, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with _quality_<base statistic>, _quality_base_failed, _quality_score and _quality_kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {f"_quality_{c}": "long" for c in BASE} | {"_quality_score": "double"}

    def make(buf, off):
        base, features = statistics(buf, off)
        trees = shared.value
        return *(base[:, i].copy() for i in range(len(BASE))), trees.score(features) if trees is not None else np.ones(len(base))

    out = arrowmap.with_text_columns(docs, text_col, make, added, keep_text)
    failed = (F.col("_quality_n_words") < 50) | (100 * F.col("_quality_n_repeat_words") > 50 * F.col("_quality_n_words"))
    return out.withColumn("_quality_base_failed", failed).withColumn("_quality_kept", ~failed & (F.col("_quality_score") >= threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = arrowmap.id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = judge(docs, model, keep_text=False)
    return judged.select("doc_id", *[F.col(f"_quality_{c}").alias(c) for c in (*BASE, "base_failed", "kept", "score")])


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {}
