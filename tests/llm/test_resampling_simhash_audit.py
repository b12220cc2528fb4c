"""The operators on target distributions, SimHash and filter interactions against plain versions of their definitions."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from lodestrata.llm import filter_audit, simhash, skew, target_resampling
from lodestrata.llm import textscan as ts
from tests.llm.test_text_operators import ALIKE, corpus, crafted, fold, rows, words_of


@pytest.fixture(scope="module")
def table(spark):
    more = [(300 + i, t) for i, t in enumerate(["A B c!", "#$ % & x", "UPPER CASE TEXT " * 80, "w " * 400, *(w for pair in ALIKE[:10] for w in pair)])]
    return [*corpus(), *more, *crafted()[:4], (5, corpus()[5][1]), (None, corpus()[3][1]), (None, None), (7, "another text of an id")]


@pytest.fixture(scope="module")
def docs(spark, table):
    r = random.Random(2)
    return spark.createDataFrame([(i, t, r.choice(["a", "b", None]), 1, 2, "x") for i, t in table], "doc_id long, text string, source string, n long, mask long, part string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_crc_matrices():
    r = np.random.default_rng(0)
    buf = r.integers(0, 256, 3000, dtype=np.uint8)
    starts = r.integers(0, 2900, 400)
    ends = starts + r.integers(0, 100, 400)
    want = [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert target_resampling.crc32_matrix(buf, starts, ends).tolist() == want == target_resampling.crc32_matrix(buf, starts, ends, cells=64).tolist()


def plain_resample(table, target, percent, least):
    features = lambda t: [" ".join(w[i : i + k]) for w in [fold(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in table], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, x in table:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(fold(x))))
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = collections.defaultdict(list)
    for k, x in enumerate(able[: percent * len(able) // 100]):
        ranks[x].append(k + 1)
    drawn = [(*x[:4], k) for x, ks in ranks.items() for k in ks]
    left = collections.Counter(out) - collections.Counter({x: len(k) for x, k in ranks.items()})
    return sorted([*drawn, *((*x[:4], None) for x in left.elements())], key=repr)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_target_resampling(spark, docs, table, empty, percent):
    target = [table[3][1], "the of süßbei x", None, ""]
    bench = spark.createDataFrame([(k, t, 0) for k, t in enumerate(target)], "item_id long, text string, weight long")
    got = target_resampling.resample(docs, bench, percent=percent)
    assert rows(got.select("doc_id", "n_features", "weight", "score", "rank")) == plain_resample(table, target, percent, 20)
    if percent == 5:
        assert rows(target_resampling.resample(empty, bench)) == []
        assert rows(target_resampling.resample(docs, bench.limit(0)).select("doc_id", "n_features", "weight", "score", "rank")) == plain_resample(table, [], 5, 20)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as score").repartition(5)
    got = {r.id: r.place for r in target_resampling.numbered(df, [df.score.desc(), df.id.asc()], "place").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)))}
    assert target_resampling.numbered(df.where("id < 0"), [df.score.desc(), df.id.asc()], "place").count() == 0


def plain_fingerprint(text, n=4):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(len(w) - n, 0) + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_links(bits, most):
    root = {b: b for b in bits}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(bits, 2):
        if (a ^ b).bit_count() <= most:
            root[find(a)] = find(b)
    return {b: find(b) for b in bits}


def near(seed, groups=30, each=12):
    """Fingerprints: random ones, and some around each within a few bits of one another."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63, 15}
    for _ in range(groups):
        base = r.getrandbits(64)
        for _ in range(each):
            for bit in r.sample(range(64), r.randint(0, 4)):
                base ^= 1 << bit
            out.add(base)
    return sorted(out)


def test_fingerprints():
    texts = [t or "" for _, t in corpus(4)] + ["a b " * 70_000]
    data = [t.encode() for t in texts]
    got = simhash.fingerprints(*simhash.shingle_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 4))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_counts_bound_the_bits():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    b[:2500] = a[:2500] ^ (np.uint64(1) << r.integers(0, 64, 2500).astype(np.uint64))
    plain = lambda x: [(x >> (2 * i) & 3).bit_count() for i in range(32)]
    want = [sum(abs(p - q) for p, q in zip(plain(x), plain(y), strict=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    got = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b)).tolist()
    assert got == want and all(x <= (p ^ q).bit_count() for x, p, q in zip(got, a.tolist(), b.tolist(), strict=True))
    for agree in (1, 2, 3):
        masks = simhash.grid(4, agree)
        assert len(masks) == math.comb(4 + agree, agree) and sum(m.bit_count() for m in masks) == 64 * math.comb(3 + agree, agree - 1)
    assert [simhash.agreeing(n, 4) for n in (0, 10_000, 10**7, 10**9)] == [1, 1, 2, 4] and simhash.agreeing(1 << 60, 4, 1) <= 28


def test_forest_connects_what_links():
    for seed in range(5):
        bits = near(seed)
        u, v = simhash.forest(np.array(bits, np.uint64), 4)
        want = plain_links(bits, 4)
        assert all((bits[i] ^ bits[j]).bit_count() <= 4 for i, j in zip(u, v, strict=True)) and len(u) == len(bits) - len(set(want.values()))


@pytest.mark.parametrize(("part", "agree"), [(4096, 1), (3, 1), (5, 2), (4096, 3)])
def test_links_over_the_grid(spark, part, agree):
    bits = near(9, groups=12, each=9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(b),) for b in bits], "bits long"), 4, part=part, agree=agree).collect()
    want, own = plain_links(bits, 4), {b: b for b in bits}
    for r in got:
        u, v = r.u % (1 << 64), r.v % (1 << 64)
        assert (u ^ v).bit_count() <= 4
        a, b = own[u], own[v]
        own = {k: a if x == b else x for k, x in own.items()}
    assert len(set(own.values())) == len(set(want.values())) and len({(own[b], want[b]) for b in bits}) == len(set(want.values()))


def test_simhash(spark, docs, table, empty):
    bits = [plain_fingerprint(t) for _, t in table]
    root = plain_links(sorted(set(bits)), 4)
    least = collections.defaultdict(set)
    for (i, _), b in zip(table, bits, strict=True):
        least[root[b]] |= {i} - {None}
    want = [(i, b - (1 << 64) if b >> 63 else b, min(least[root[b]], default=None)) for (i, _), b in zip(table, bits, strict=True)]
    assert rows(simhash.dedup(docs)) == sorted(want, key=repr)
    assert rows(simhash.dedup(empty)) == []


def plain_audit(table, labels):
    first = {}
    for i, t, _ in table:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    cells = []
    for i, t, part in table:
        t = t or ""
        w = words_of(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        mine = [x for x in labels if x[0] == i and i is not None]
        cells.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {c[0] for c in cells}:
        own, shapley, made = [c for c in cells if c[0] == part], collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [c for c in left if c[1][f]]
                left = [c for c in left if not c[1][f]]
                shapley[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), sum(c[1][f] for c in own) - len(gone), sum(c[1][f] and sum(c[1].values()) == 1 for c in own), sum(c[2] for c in gone), sum(c[3] for c in gone), f))
        out += [(*x[:9], shapley[x[9]]) for x in made]
    return sorted(out, key=repr)


def test_filter_audit(spark, docs, empty):
    labels = [(i, i % 2, (i % 3) // 2) for i in range(0, 60, 2)] + [(4, 0, 1), (5, None, None), (None, 1, 1), (999, 1, 1)]
    marked = spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, text string")
    table = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    cells = filter_audit.cells(docs, marked)
    assert rows(filter_audit.audit(cells)) == plain_audit(table, labels)
    assert rows(filter_audit.audit(filter_audit.cells(empty, marked))) == []
    assert rows(filter_audit.audit(filter_audit.cells(docs, marked.limit(0))).drop("filter_order")) == rows(spark.createDataFrame([(x[0], *x[2:]) for x in plain_audit(table, [])], "part string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"))


def test_failures_of_large_groups():
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:199]), " ".join(words[:100] * 3), "ABC" * 100, "a|b", "", "é" * 10 + "A"]
    data = [t.encode() for t in texts]
    assert filter_audit.own_failures(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])).tolist() == [0, 1, 2, 5, 9, 1, 5]


def test_frequent_keys_have_an_absolute_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_ROWS", 50)
    df = spark.range(100_000).selectExpr("case when id < 60 then 1 else id end as k", "id as v")
    table = df.groupBy("k").agg({"v": "max", "*": "count"}).toDF("k", "most", "n")
    got = skew.look_up(df, table, ["k"], "n", "inner")
    assert got.count() == 100_000 and got.where("k = 1").agg({"most": "max"}).first()[0] == 59
    assert ">= 50" in got._jdf.queryExecution().toString()
