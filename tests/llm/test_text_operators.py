"""Each operator against a plain version of its definition, on small texts with nulls, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import arrowmap, components, decontamination, hashruns, jaccard_join, line_dedup, packing, quality, radix, resampling, scratch, skew, substring_dedup, token_counts, tokens, toxicity, warc
from lodestrata.llm import textscan as ts

SPACED = re.compile("[^\x20\x09-\x0d]+")
VOCABULARY = [a + b for a in ("the", "of", "süß", "naïve", "x", "ré") for b in ("", "a", "bei", "chen", "ñ", "7", "—")]


def words_of(text):
    return SPACED.findall(text or "")


def corpus(seed=1, n=60):
    """Random texts, copies, near copies, shared passages and odd ones, as (doc_id, text)."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(VOCABULARY) for _ in range(k))
    passage = say(70)
    texts = [say(r.randint(0, 150)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[7] + " more", f"{say(20)} {passage} {say(10)}", f"{passage}\n{say(30)}", f"{say(5)}\t{passage}", None, "", " \n\t ", "word", "a" * 5000, "w " * 400, say(3000)]
    texts += [None, "", texts[5].upper()]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "q", 1.5, i) for i, t in corpus()]
    return spark.createDataFrame([*rows, (5, rows[5][1], "q", 1.5, 5), (None, rows[3][1], "q", 1.5, 0), (None, None, "q", 1.5, 0)], "doc_id long, text string, grp string, score double, row long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def swapped(k):
    """Two texts of 2**k bytes that any polynomial hash modulo 2**64 takes for one: abba baab ... and its complement."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


#: As words, lines and whole documents, of the length at which hashing goes another way and below.
CRAFTED = [w for k in (5, 8, 9, 10, 12, 17) for w in swapped(k)]


def changed_in_three_bits(seed, n):
    """Pairs of different ASCII words of 16 characters that differ in three bits, two of them that a hash which undoes a change in the next eight bytes takes for one."""
    r = random.Random(seed)
    out = [("6zc4pz0xx9xfl6gv", "6zc4pz08x9xfn6g6")]
    while len(out) < n:
        a = bytearray(r.choice(b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))
        b = bytearray(a)
        for i, bit in ((7, 6), (r.randrange(8, 16), r.randrange(6)), (r.randrange(16), r.randrange(6))):
            b[i] ^= 1 << bit
        if a != b and all(33 <= c < 127 for c in b):
            out.append((a.decode(), b.decode()))
    return out


ALIKE = changed_in_three_bits(4, 400)
#: Lines of 64 bytes that one fast hash takes for one under two seeds.
ALIKE_LINES = ("XkktmSCl the quick brown fox jumbAfvFFyh the quick brown fox jum", "XkktmSCZ the quick brown fox jumbAf5of18 the quick brown fox jum")


def test_words_that_differ_little():
    words = [w for pair in changed_in_three_bits(9, 4000) for w in pair]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.arange(0, len(buf), 16)
    for which in (0, 1):
        assert len(set(ts.hash_pieces(buf, at, at + 16, which).tolist())) == len(set(words))


def test_pieces_are_numbered_by_their_bytes(monkeypatch):
    r = random.Random(3)
    said = [r.choice(["a", "b", "ab", "abc", "x" * 300, "x" * 299 + "y", ""]) for _ in range(400)]
    buf, ends = np.frombuffer("".join(said).encode(), np.uint8), np.cumsum([len(x) for x in said])
    starts = ends - [len(x) for x in said]
    within = np.repeat(np.arange(4), 100)
    for hashed in (ts.hash_pieces, lambda buf, starts, ends, which=0: (ends - starts).astype(np.uint64) % np.uint64(2)):
        monkeypatch.setattr(ts, "hash_pieces", hashed)
        got = ts.classes(buf, starts, ends).tolist()
        assert len(set(zip(got, said, strict=True))) == len(set(got)) == len(set(said))
        got = ts.classes(buf, starts, ends, within).tolist()
        assert len(set(zip(got, said, within.tolist(), strict=True))) == len(set(got)) == len(set(zip(said, within.tolist(), strict=True)))
    many = np.array([r.randrange(1 << 30) for _ in range(50)] * 2)
    runs = ts.runs_of(many, np.arange(96), 5).tolist()
    assert len(set(runs)) == len({tuple(many[i : i + 5].tolist()) for i in range(96)}) == 50


@pytest.fixture(scope="module")
def alike(spark):
    say = " ".join(VOCABULARY[:11])
    texts = [x for a, b in ALIKE[:60] for x in (a, b, f"{a} {say}", f"{b} {say}", f"{a}\n{b}\n{a} x {say} {b} x\n{b}")]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_operators_tell_words_apart_that_differ_little(alike):
    table = [tuple(x) for x in alike.collect()]
    assert rows(substring_dedup.removed_and_kept(alike, window=10)) == plain_substring(table, 10)
    assert rows(jaccard_join.link(alike, n=4, num=85, den=100)) == plain_components(table, 4, 85, 100)
    judged = quality.judge(alike, None).select("doc_id", "_quality_n_dup_lines", "_quality_n_repeat_words").collect()
    want = []
    for i, t in table:
        lines, w = [x for x in t.split("\n") if words_of(x)], words_of(t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        want.append((i, len(lines) - len(set(lines)), len({k + j for x in at.values() if len(x) > 1 for k in x for j in range(3)})))
    assert rows(alike.sparkSession.createDataFrame(judged)) == sorted(want, key=repr)


def test_line_dedup_tells_lines_apart_that_one_hash_does_not(spark):
    a, b = ALIKE_LINES
    table = [(1, f"{a}\nx\ny"), (2, f"{b}\nx\ny"), (3, f"{b}\nx\ny\nz"), (4, "\n".join(w for w, _ in ALIKE)), (5, "\n".join(w for _, w in ALIKE))]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(line_dedup.dedup(df, words=None).select("doc_id", "_line_kept_text", "_line_lines", "_line_removed")) == plain_lines(table, 3)


def crafted(say=VOCABULARY):
    texts = [x for w in CRAFTED for x in (w, f"{w} {w}\nx y\n{w}", " ".join(say + [w] + say + say))]
    return [(2000 + i, t) for i, t in enumerate(texts)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_and_windows():
    texts = [t or "" for _, t in corpus(2)]
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)])
    buf = np.frombuffer(b"".join(data), np.uint8)
    for lo, hi in ts.groups(off, 500):
        part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        w = ts.words(part, o)
        assert [[part[a:b].tobytes().decode() for a, b in zip(w.starts[x:y], w.ends[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)] == [words_of(t) for t in texts[lo:hi]]
        at, h = ts.windows(w.hash, w.first, 3)
        plain = [tuple(words_of(t)[i : i + 3]) for t in texts[lo:hi] for i in range(len(words_of(t)) - 2)]
        assert len(set(zip(plain, h.tolist(), strict=True))) == len(set(plain)) == len(set(h.tolist()))
    for which in (0, 1):
        w = ts.words(*ts.raw(pa.array([" ".join(CRAFTED)])))
        assert len(set(ts.hash_pieces(w.buf, w.starts, w.ends, which).tolist())) == len(CRAFTED)
        # windows of two words in the same patterns: each is another
        h = w.second() if which else w.hash
        for k in (5, 10):
            at, x = ts.windows(np.concatenate([h[[0 if c == "a" else 1 for c in t]] for t in swapped(k)]), np.array([0, 1 << k, 2 << k]), 1 << k, which)
            assert len(at) == 2 == len(set(x.tolist()))
    one = np.frombuffer(("ab cd " * 2_000_000).encode(), np.uint8)
    assert len(set(ts.words(one, np.array([0, len(one)])).hash.tolist())) == 2


def test_token_counts(spark, docs, empty):
    t = tokens.tokenizer(tokens.default_path())
    odd = [(900, "a<|endoftext|>b  <|endoftext|>\n"), (901, "x  　 y  \n z"), (902, "tabs\t\tand  spaces   \n\n end "), (903, "日本語 テキスト 😀 👍🏽 "), (904, " " * 3000 + "x"), (905, "it's we'll 12345 ½ ٣٤")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd + crafted(), "doc_id long, text string"))
    want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for i, x in table.collect()), key=repr)
    assert rows(token_counts.count_tokens(table, tokens.default_path(), limit=100)) == want
    # many chunks, and overlaps that hold no boundary at first
    assert rows(token_counts.count_tokens(table, tokens.default_path(), limit=100, chunk_chars=90, huge_chars=100, overlap=3)) == want
    assert rows(token_counts.count_tokens(empty, tokens.default_path())) == []


def test_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(50):
        size = r.choice([1, 7, 64, 100])
        lengths = np.array([r.randint(1, size) for _ in range(r.randint(1, 60))])
        window, offset = packing.best_fit_decreasing(lengths, size)
        open_, want = [], 0  # the plain rule: the fullest window that fits
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [x for x in open_ if x >= n]
            want += not fits
            x = min(fits, default=size)
            open_ = [*open_, x - n] if not fits else [*(open_[: (k := open_.index(x))]), x - n, *open_[k + 1 :]]
        assert len(set(window.tolist())) == want
        for k in set(window.tolist()):
            at = sorted((o, n) for o, n, v in zip(offset.tolist(), lengths.tolist(), window.tolist(), strict=True) if v == k)
            assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0 and sum(at[-1]) <= size


def test_pieces_of_one_hash(monkeypatch):
    # whatever the hash says, pieces are compared
    monkeypatch.setattr(ts, "hash_pieces", lambda buf, starts, ends, which=0: (ends - starts).astype(np.uint64) % np.uint64(3))
    t, cache = tokens.tokenizer(tokens.default_path()), tokens.PieceCache(tokens.default_path(), slots=4, pool=2000)
    for seed in range(3):
        texts = [x or "" for _, x in corpus(seed)] + [w for w in CRAFTED if len(w) < 5000]
        ids, at = cache.encode(*ts.raw(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(spark, docs, empty):
    t = tokens.tokenizer(tokens.default_path())
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(spark.createDataFrame(crafted(), "doc_id long, text string"))
    got = packing.pack(table, tokens.default_path(), size=64, group_pieces=40).toPandas()
    for i, text in table.select("doc_id", "text").collect():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1].tolist()] and mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 64
    assert rows(packing.pack(empty, tokens.default_path())) == []


def test_packing_deals_equal_rows_over_groups(spark):
    same = spark.createDataFrame([(None, None)] * 2000, "doc_id long, text string").repartition(4)
    got = packing.pack(same, tokens.default_path(), size=64, group_pieces=100).toPandas()
    of = (got.sequence_id // packing.GROUP_IDS).value_counts()
    assert len(got) == 2000 and len(of) == 20 and of.max() < 200 and (got.groupby("sequence_id").length.sum() <= 64).all()


def plain_substring(table, k):
    """doc_id -> kept words, by the definition, for every row."""
    first = {}
    for i, t in table:
        w = words_of(t)
        for a in range(len(w) - k + 1) if i is not None else ():
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in table:
        w = words_of(t)
        gone = {p for a in range(len(w) - k + 1) if i is not None and first[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "step_bits"), [(10, None), (50, None), (10, 2), (20, 1)])
def test_substring_dedup(spark, docs, empty, window, step_bits):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(crafted(), "doc_id long, text string"))
    got = substring_dedup.removed_and_kept(df, window=window, group_bytes=9000, range_hashes=500, step_bits=step_bits)
    assert rows(got) == plain_substring([tuple(r) for r in df.collect()], window)
    assert rows(substring_dedup.removed_and_kept(empty)) == []


def test_substring_dedup_of_text_ids(spark):
    table = [(f"id{i}" if i is not None else None, t) for i, t in [*corpus(), (5, corpus()[3][1]), (None, corpus()[3][1])]]
    got = substring_dedup.removed_and_kept(spark.createDataFrame(table, "doc_id string, text string").repartition(3), window=10)
    assert rows(got) == plain_substring(table, 10)


def test_packets_follow_the_bytes():
    """A group of documents sends about as many packets whatever the number of groups, and packets stay large."""
    r = np.random.default_rng(1)
    h = np.sort(r.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2))
    for groups in (8, 1_000, 1_000_000, 1_000_000_000):
        meeting = hashruns.Meeting(groups * len(h), groups, 100_000, {"x": "u1"}, step_bits=6)
        packets = meeting.send(3, h, x=np.ones(len(h)))
        assert packets.num_rows <= 1 << max(6, -(-meeting.bits // 2)) and 1 << meeting.bits >= groups
        if meeting.coarse < meeting.bits:
            # a task that deals further: so many groups, each with its share of a range
            block, share = groups / meeting.blocks, len(h) / (1 << meeting.coarse)
            assert block * share <= 2.1 * 100_000 and block * share / (1 << meeting.bits - meeting.coarse) >= share / 2


def plain_components(table, n, num, den):
    sets = []
    for _, t in table:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(table)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a in range(len(table)):
        if sets[a] and table[a][0] is not None:
            least[find(a)].append(table[a][0])
    return sorted(((i, len(s), min(least[find(a)], default=None) if s else i) for a, ((i, _), s) in enumerate(zip(table, sets, strict=True))), key=repr)


def edited(seed, groups=6, copies=40, words=60):
    """Groups of near copies around the similarity at which documents link."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [r.choice(VOCABULARY) + str(r.randint(0, 30)) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(words)] = f"edit{r.randint(0, 9)}"
            out.append(" ".join(w[: r.randint(words - 6, words)]))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("crowd", "likely", "tile", "part", "step_bits"), [(64, 0.4, 1000, 2048, None), (5, 0.4, 7, 4, 1), (1000, 2.0, 5, 9, None), (3, 0.9, 3, 1, None)])
def test_jaccard_join(spark, docs, monkeypatch, crowd, likely, tile, part, step_bits):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "LIKELY", likely)
    monkeypatch.setattr(jaccard_join, "COLUMN_PART", part)
    monkeypatch.setattr(jaccard_join, "TILE_HASHES", 20 * tile)
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in edited(4)] + crafted()
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert rows(jaccard_join.link(df, n=4, num=85, den=100, group_bytes=8000, tile=tile, range_hashes=300, step_bits=step_bits)) == plain_components(table, 4, 85, 100)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_jaccard_join_of_a_column_of_many(spark, monkeypatch, most):
    """One n-gram in texts that are otherwise unlike each other, and a few near copies among them, some of one group: dealt in parts."""
    monkeypatch.setattr(jaccard_join, "COLUMN_PART", 10)
    monkeypatch.setattr(jaccard_join, "MOST_COMMON", most)
    r = random.Random(12)
    texts = [" ".join(["all", "of", "them", "say"] + [f"{i}{chr(97 + k)}" for k in range(r.choice([3, 8]))]) for i in range(150)]
    texts += [texts[0] + " " + " ".join(f"z{k}" for k in range(20))] * 3 + [f"all of them say {'so ' * 3}{' '.join(f'w{k}' for k in range(40))} {i}" for i in range(60)]
    r.shuffle(texts)
    table = list(enumerate(texts))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for num, den in ((85, 100), (10, 100)):
        assert rows(jaccard_join.link(df, n=4, num=num, den=den)) == plain_components(table, 4, num, den)


@pytest.mark.parametrize("shares", [1, 8])
def test_jaccard_join_of_a_crowd(spark, monkeypatch, shares):
    """Near copies that crowd on columns, and texts that only chance columns chain to them: sets leave their group once, pairs are handed over in small parts, and chains are no clusters."""
    monkeypatch.setattr(jaccard_join, "CROWD", 5)
    monkeypatch.setattr(jaccard_join, "CROWD_SHARES", shares)
    monkeypatch.setattr(jaccard_join, "MOST_COMMON", 0)
    monkeypatch.setattr(jaccard_join, "PENDING", 50)
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 7)
    r = random.Random(21)
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(f"e{k}" if r.random() < 0.03 else w for w in base) for k in range(30)]
    phrases = [" ".join(f"p{k}x{i}" for i in range(8)) for k in range(12)]
    texts += [f"{phrases[k]} {k}a{i} {phrases[(k + 1) % 12]}" for k in range(12) for i in range(10)]
    r.shuffle(texts)
    table = list(enumerate(texts))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    clusters, keep = [], scratch.keep

    def kept(df, name):
        out = keep(df, name)
        clusters.extend([r["count"] for r in out.groupBy("block").count().collect()] if name == "jaccard-clusters" else [])
        return out

    monkeypatch.setattr(scratch, "keep", kept)
    assert rows(jaccard_join.link(df, n=4, num=85, den=100, tile=10)) == plain_components(table, 4, 85, 100)
    assert max(clusters) == 30 if shares == 8 else max(clusters) > 40


def test_product_in_little_memory():
    """Two tiles at once: no more than a few times their counts of 16 MB."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 700).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 350), r.integers(0, 1 << 62, 700).astype(np.uint64)])) for _ in range(1999)]
    sets.append(sets[7])
    tracemalloc.start()
    label = jaccard_join.product(sets, 85, 100)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert label[1999] == 7 and (label[:1999] == np.arange(1999)).all()


def test_pairs_across_units():
    r = np.random.default_rng(2)
    for _ in range(30):
        m = int(r.integers(0, 60))
        group, unit, n = r.integers(0, 4, m), r.integers(0, 5, m), r.integers(1, 30, m)
        got = [(min(i, j), max(i, j)) for a, b in jaccard_join.across(group, unit, n, 80, 100, most=7) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == [(i, j) for i in range(m) for j in range(i + 1, m) if group[i] == group[j] and unit[i] != unit[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])]


def test_jaccard_keep_first(spark, docs, empty):
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = jaccard_join.keep_first(docs, n=5, num=80, den=100, group_bytes=4000)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    want = [c for i, n, c in plain_components(table, 5, 80, 100) if n == 0] + list({c for _, n, c in plain_components(table, 5, 80, 100) if n})
    assert got == sorted(want, key=repr)
    assert rows(jaccard_join.link(empty)) == [] and rows(jaccard_join.keep_first(empty)) == []


def test_look_up(spark):
    r = random.Random(16)
    rows_ = [(r.choice(["hot", "hot", "hot", "a", "b", None, f"k{i}"]), i, f"v{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows_, "k string, i int, `a.b` string").repartition(3)
    table = df.where("k is not null and k <> 'b'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most"))
    most = {}
    for k, i, _ in rows_:
        most[k] = max(most.get(k, 0), i)
    for share in (2, 1000):
        want = [(k, i, v, None if k in (None, "b") else most[k]) for k, i, v in rows_]
        assert rows(skew.look_up(df, table, ["k"], "n", share=share)) == sorted(want, key=repr)
        assert rows(skew.look_up(df, table, ["k"], "n", "inner", share=share)) == sorted((w for w in want if w[3] is not None), key=repr)


def test_maybe_in_never_denies(spark):
    df = spark.range(3000).withColumn("h", F.when(F.col("id") % 11 > 0, F.xxhash64("id"))).withColumn("a.b", F.col("id"))
    keys = df.where("id % 7 = 0").select(F.col("h").alias("g"))
    for bits in (skew.FILTER_BITS, 1 << 10, 1):
        got = skew.maybe_in(df, keys, F.col("h"), F.col("g"), "said", bits)
        assert got.columns == ["id", "h", "a.b", "said"] and got.count() == 3000
        assert got.where("not said and id % 7 = 0 and h is not null").isEmpty() and got.where("said and h is null").isEmpty()
        assert (got.where("said and id % 7 > 0").count() < 10) == (bits == skew.FILTER_BITS)
    assert skew.maybe_in(df, keys.limit(0), F.col("h"), F.col("g"), "said").where("said").isEmpty()


def test_line_dedup_shuffles_only_texts_that_lose_lines(spark, monkeypatch):
    """With a filter of one bit all texts meet their lines, with the usual one those that lose some; results are the same."""
    table = [(i, f"a{i}\nb{i}\nc{i}\nd{i}" if i % 5 else "x\ny\nz\nown" + str(i)) for i in range(100)] + [(None, "x\ny\nz"), (200, None)]
    df, sent, make = spark.createDataFrame(table, "doc_id long, text string").repartition(3), [], skew.maybe_in

    def counted(bits, rows, keys, of, its, flag):
        out = make(rows, keys, of, its, flag, bits)
        sent.append(out.where(flag).count())
        return out

    for bits in (skew.FILTER_BITS, 1):
        monkeypatch.setattr(skew, "maybe_in", lambda *a, bits=bits: counted(bits, *a))
        assert rows(line_dedup.dedup(df).select("doc_id", "_line_kept_text", "_line_lines", "_line_removed")) == plain_lines(table, 3)
    # each run filters positions first, then texts
    assert sent[1] == 20 and sent[3] == len(table) and sent[0] < sent[2]


def test_what_is_kept_is_dropped(spark):
    from pathlib import Path

    before, tables = list(scratch._made), {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = scratch.settle(lambda: substring_dedup.removed_and_kept(docs, window=10), "settled")
    mine, left = scratch._made[len(before) :], {t.name for t in spark.catalog.listTables()}
    assert len(mine) == 1 and got.count() == len(corpus()) and {t for t in left - tables if t.startswith("substring_texts")} == set()
    scratch.drop(mine)
    assert scratch._made == before and not Path(mine[0][1].removeprefix("file://")).exists()


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(300)]
    root = {v: v for e in edges for v in e}
    for _ in range(300):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: v for k, v in root.items() if k != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("most", [16 << 20, 150])
def test_decontamination(spark, docs, empty, most):
    texts = [t for _, t in corpus()]
    items = [(1, texts[61]), (2, " ".join(words_of(texts[8])[3:20]).upper()), (10, "thea, süß!"), (11, None), (12, "--"), (2, "thea süß"), (None, texts[9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.mark(docs, bench, k=10, max_item_bytes=most)
    assert got.columns[: len(docs.columns)] == docs.columns
    keys = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        for a in range(max(len(w) - 10, 0) + 1 if w else 0):
            keys[tuple(w[a : a + 10])].add(i)
    want = []
    for r in docs.collect():
        w = fold(r.text)
        at = [(a, k) for k in {len(x) for x in keys} for a in range(len(w) - k + 1) if tuple(w[a : a + k]) in keys]
        hit = {p for a, k in at for p in range(a, a + k)}
        found = sorted({str(i) for a, k in at for i in keys[tuple(w[a : a + k])] if i is not None})
        want.append((r.doc_id, r.text, len(w), len(hit), found))
    assert sorted(((r.doc_id, r.text, r._decon_words, r._decon_hit, list(r._decon_items)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    clean = decontamination.clean(docs, bench, k=10, max_item_bytes=most)
    assert clean.columns == docs.columns and clean.count() == sum(w[3] == 0 for w in want)
    spans = decontamination.clean(docs, bench, remove="spans", k=10, max_item_bytes=most)
    assert sorted(((r.doc_id, len(fold(r.text))) for r in spans.collect()), key=repr) == sorted(((i, n - h) for i, _, n, h, _ in want), key=repr)
    assert rows(decontamination.mark(empty, bench)) == [] and decontamination.clean(docs, bench.limit(0)).count() == docs.count()


def plain_lines(table, run, words=None):
    order = lambda i, a: (i is None, i or 0, a)

    def windows(t):
        c = [(a, x) for a, x in enumerate((t or "").split("\n")) if words_of(x)]
        for size in range(1 if words else run, run + 1):
            for k in range(len(c) - size + 1):
                w = c[k : k + size]
                if size == run or sum(len(words_of(x)) for _, x in w) >= words:
                    yield tuple(x for _, x in w), [a for a, _ in w]

    first = {}
    for i, t in table:
        for key, at in windows(t):
            first[key] = min(first.get(key, order(i, at[0])), order(i, at[0]))
    out = []
    for i, t in table:
        gone = {a for key, at in windows(t) if order(i, at[0]) > first[key] for a in at}
        out.append((i, None if t is None else "\n".join(x for a, x in enumerate(t.split("\n")) if a not in gone), 0 if t is None else len(t.split("\n")), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(spark, empty, run):
    r = random.Random(6)
    lines = ["one", "two two", "", "three", "  ", "fôur", "five", "two two"]
    table = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(60)] + [(None, "one\nthree\nfive\none"), (61, None), (62, ""), (63, "\n\n"), (5, "one\nthree\nfôur\nfive\none"), (64, "one\n" * 300)]
    table += [table[7], table[7]]
    df = spark.createDataFrame([(i, t, "x") for i, t in table], "doc_id long, text string, gone string").repartition(3)
    got = line_dedup.dedup(df, run=run)
    assert got.columns[:3] == ["doc_id", "text", "gone"]
    assert rows(got.select("doc_id", "_line_kept_text", "_line_lines", "_line_removed")) == plain_lines(table, run)
    assert rows(line_dedup.dedup(empty)) == []


def test_line_dedup_of_long_passages_in_few_lines(spark):
    said = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    table = [
        (1, said("a", 60)), (2, said("a", 60)),  # a copied document of one line
        (3, said("b", 25) + "\n\n" + said("c", 25)), (4, "own\n" + said("b", 25) + "\n" + said("c", 25) + "\nend"),  # two lines of 50 words
        (5, said("d", 25) + "\n" + said("e", 24)), (6, said("d", 25) + "\n" + said("e", 24)),  # 49: too few
        (7, said("f", 49)), (8, said("f", 49)), (9, said("g", 50) + "\n" + said("g", 50)),
        (10, "x\ny\nz"), (11, "x\ny\nz"),
    ]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r._line_kept_text, r._line_removed) for r in line_dedup.dedup(df).collect()}
    changed = {2: ("", 1), 4: ("own\nend", 2), 9: (said("g", 50), 1), 11: ("", 3)}
    assert got == {i: changed.get(i, (t, 0)) for i, t in table}
    assert rows(line_dedup.dedup(df, words=None).select("doc_id", "text", "_line_kept_text", "_line_lines", "_line_removed").drop("text")) == plain_lines(table, 3)


@pytest.mark.parametrize("words", [3, 7, 50])
def test_line_dedup_of_windows_by_words(spark, words):
    r = random.Random(words)
    lines = ["one", "two two", "", "three 3 three", "  ", "four " * 4, "w " * 55, "long " * 300]
    table = [(i, "\n".join(r.choice(lines) + r.choice(["", "", f" {r.randint(0, 3)}"]) for _ in range(r.randint(1, 9)))) for i in range(80)] + [(90, "x " * 100_000 + "\none"), (91, "x " * 100_000 + "\none"), (None, "one\ntwo two\none")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for run in (1, 3):
        assert rows(line_dedup.dedup(df, run=run, words=words).select("doc_id", "_line_kept_text", "_line_lines", "_line_removed")) == plain_lines(table, run, words)


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_statistics(spark, docs):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, "\n".join([*CRAFTED, t, " ".join(CRAFTED[4:8] * 2)])) for i, t in crafted()[:6]], "doc_id long, text string"))
    got = arrowmap.with_text_columns(table, "text", lambda b, o: tuple(quality.statistics(b, o)[0].T.copy()), {f"_{c}": "long" for c in quality.BASE})
    for r in got.collect():
        t = r.text or ""
        w = words_of(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if words_of(x):
                dup += x in seen
                seen.add(x)
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again))


def test_quality_training_is_bounded_by_rows(spark, monkeypatch):
    """Ids that many rows share, and ids with several labels: no more rows than the bound reach the driver."""
    docs = spark.createDataFrame([(i % 7, f"text {i} " + "word " * (i % 90)) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, directions, **_: seen.append(len(y)))
    quality.train(docs, labels, max_labelled=500)
    assert seen == [500]


def test_trees_are_monotonic_and_fit():
    r = np.random.default_rng(7)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (r.random(3000) < 0.1)).astype(float)
    model = quality.fit(x, y, [1, -1, 0], trees=20)
    assert ((model.score(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.95
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(r.random((50, 3)), 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(model.score(grid).reshape(50, 40), axis=1) * sign >= -1e-12).all()
    # the flat arrays against a plain walk from each root
    for row, got in zip(x[:200], model.score(x[:200]), strict=True):
        total = model.base
        for at in model.roots.tolist():
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, least=2)
    judged = quality.judge(docs, model)
    assert judged.columns[: len(docs.columns)] == docs.columns and judged.count() == docs.count()
    assert judged.where("_quality_kept and _quality_n_words < 50").isEmpty()
    assert quality.train(docs, labels.limit(0)) is None and quality.judge(docs, None).where("_quality_score < 1").isEmpty()
    assert rows(quality.judge(empty, model)) == []


def test_ordered_longs(spark):
    r = random.Random(13)
    values = [r.gauss(0, 10.0 ** r.randint(-3, 6)) for _ in range(300)] + [1.0, 1.0000004, 1.0 + 2**-52, 0.0, -1e-12, 1e-12, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(c.alias(n) for c, n in zip(radix.ordered_longs(F.col("v")), "ab", strict=True)))
    got = df.collect()
    assert [x.v for x in sorted(got, key=lambda x: (x.a, x.b))] == sorted(values)
    assert all((x.a, x.b) != (y.a, y.b) for x, y in zip(got, got[1:], strict=False) if x.v != y.v)


def test_kth_largest(spark):
    r = random.Random(8)
    values = [r.choice([r.randint(-(1 << 63), (1 << 63) - 1), r.randint(-3, 3)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 7, 150, 300):
        t, m = radix.kth_largest(df, "x", k)
        ordered = sorted(values, reverse=True)
        assert t == ordered[k - 1] and m == k - sum(v > t for v in values)
    assert radix.kth_largest(df, "x", 301)[0] == -(1 << 63)


def test_resampling(spark, docs, empty):
    """Weights, keys and choice recomputed from their definitions."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(50)] + [(None, 1), (999, 1), (3, None)], "doc_id long, quality int")
    k, buckets, orders = 20, 50, (1, 2)
    table = resampling.resample(docs, labels, k=k, buckets=buckets).toPandas()
    assert len(table) == docs.count()
    fold_ = lambda t: words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda t: [" ".join(fold_(t)[i : i + n]) for n in orders for i in range(len(fold_(t)) - n + 1)]
    cell: dict[str, int] = {}
    for text in {g for r in docs.collect() for g in grams(r.text)}:  # an n-gram is hashed alone
        n = len(text.split(" "))
        cell[text] = int(resampling.grams(*ts.raw(pa.array([text])), (n,), buckets)[1][0])
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in docs.collect():
        at = [cell[g] for g in grams(r.text)]
        raw += np.bincount(at, minlength=buckets)
        target += np.bincount(at, minlength=buckets) * (r.doc_id is not None and r.doc_id % 2 == 1 and r.doc_id < 50)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    hashed = {(r.doc_id, r.text): r for r in docs.select("doc_id", "text", F.xxhash64(F.lit(42), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).alias("u"), F.xxhash64("doc_id", F.xxhash64("text")).alias("tie")).collect()}
    want = []
    for r in docs.collect():
        at, h = [cell[g] for g in grams(r.text)], hashed[r.doc_id, r.text]
        draw = (((h.u % (1 << 64)) >> 12) + 0.5) / (1 << 52)
        want.append((r.doc_id, len(at), ratio[at].sum(), ratio[at].sum() - np.log(-np.log(draw)), h.tie))
    want.sort(key=lambda x: repr((x[0], x[1])))
    got = sorted(table.itertuples(index=False), key=lambda x: repr((None if x.doc_id != x.doc_id else int(x.doc_id), x.n_grams)))
    for g, w in zip(got, want, strict=True):
        assert g.n_grams == w[1] and abs(g.log_weight - w[2]) < 1e-9 and abs(g.gumbel_key - w[3]) < 1e-9
    best = sorted(((g.gumbel_key, w[4]) for g, w in zip(got, want, strict=True)), reverse=True)[k - 1]
    assert [g.kept for g in got] == [(g.gumbel_key, w[4]) >= best for g, w in zip(got, want, strict=True)]
    again = resampling.resample(docs.repartition(5), labels, k=k, buckets=buckets).toPandas()
    as_rows = lambda t: sorted(map(repr, t[["doc_id", "n_grams", "gumbel_key", "kept"]].round(9).itertuples(index=False, name=None)))
    assert as_rows(again) == as_rows(table)
    assert not resampling.resample(docs, labels, k=0).toPandas().kept.any() and resampling.resample(docs, labels, k=10**6).toPandas().kept.all()
    assert resampling.resample(docs, labels.limit(0)).where("log_weight <> 0").isEmpty()
    assert rows(resampling.resample(empty, labels)) == []


def test_resampling_separates_what_it_learnt(spark):
    r = random.Random(14)
    texts = [(i, " ".join(r.choice(VOCABULARY[:20] if i % 4 == 0 else VOCABULARY[15:]) for _ in range(40))) for i in range(800)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 800, 3)], "doc_id long, quality int")
    got = resampling.weigh(docs, labels).toPandas()
    held = got[got.doc_id % 3 != 0]
    good, other = held.log_weight[held.doc_id % 4 == 0].to_numpy(), held.log_weight[held.doc_id % 4 != 0].to_numpy()
    assert (good[:, None] > other[None, :]).mean() > 0.99  # AUC of rows without a label


def test_toxicity_learns_and_holds_out(spark, empty):
    r = random.Random(9)
    texts, labels = [], []
    for i in range(1500):
        toxic = r.random() < 0.2
        w = [r.choice(VOCABULARY) for _ in range(40)]
        for _ in range(3 if toxic else 0):
            w[r.randrange(40)] = r.choice(["vilest", "awfuls", "hatred", "scumbag"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, y).join(y, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert ((got.predicted == got.toxic)[got.held_out]).mean() > 0.97
    # what is held out changes nothing
    flipped = y.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again[got.doc_id].to_numpy(), got.score.to_numpy())
    odd = spark.createDataFrame([(None, None), (None, "vilest"), (2, ""), (2, "")], "doc_id long, text string")
    assert toxicity.score(docs.unionByName(odd), y).count() == 1504
    assert rows(toxicity.score(empty, y)) == [] and toxicity.score(docs, y.limit(0)).where("score <> 0").isEmpty()


def test_label_model_fits_accuracies_and_correlations():
    """Votes drawn from a known tree: chances, tree and classes come back."""
    r = np.random.default_rng(5)
    n = 40_000
    y = r.random(n) < 0.3
    x = np.zeros((n, toxicity.VOTERS))
    x[:, 0] = r.random(n) < np.where(y, 0.8, 0.1)
    for j in range(1, 6):  # a chain that repeats the first voter
        x[:, j] = np.where(r.random(n) < 0.9, x[:, j - 1], r.random(n) < 0.5)
    for j in range(6, 10):
        x[:, j] = r.random(n) < np.where(y, 0.7, 0.2)
    known = np.where(np.arange(n) < 2000, y, np.nan)
    model = toxicity.fitted(toxicity.counts_by_class(np.nan_to_num(known), x, known, (~np.isnan(known)).astype(float)), np.array([0.05, 0.9]))
    for _ in range(6):
        model = toxicity.fitted(toxicity.counts_by_class(model.posterior(x, known), x, known, np.ones(n)))
    assert abs(model.share - 0.3) < 0.03 and ((model.posterior(x, np.full(n, np.nan)) > 0.5) == y).mean() > 0.85
    for c, chance in ((0, 0.2), (1, 0.7)):
        assert {tuple(sorted((j, int(model.parent[c, j])))) for j in range(6) if model.parent[c, j] != j and model.parent[c, j] < 6} == {(j, j + 1) for j in range(5)}
        marginal = x[y == c][:, 6:10].mean(axis=0)
        assert np.abs(marginal - chance).max() < 0.02
    # without correlations in the model, the five repeats are taken for five voters
    free = toxicity.LabelModel(np.stack([np.arange(toxicity.VOTERS)] * 2), np.stack([np.stack([np.clip(x[y == c].mean(axis=0), 1e-4, 1 - 1e-4)] * 2, axis=1) for c in (0, 1)]), 0.3, model.label)
    loss = lambda m: -np.mean(np.log(np.where(y, p := np.clip(m.posterior(x, np.full(n, np.nan)), 1e-9, 1 - 1e-9), 1 - p)))
    assert loss(model) < 0.9 * loss(free)


def test_toxicity_of_ties_repeats_and_long_texts(spark):
    r = random.Random(15)
    say = lambda k: " ".join(r.choice(VOCABULARY) for _ in range(k))
    texts = [(i, say(20) + (" scumbag vilest" if i % 5 == 0 else "")) for i in range(400)] + [(7, "same text")] * 200 + [(1000, say(60_000)), (1001, "x" * 3_000_000), (1002, "scumbag " * 50_000)]
    docs, y = spark.createDataFrame(texts, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] * 2, "doc_id long, toxic int")
    got = toxicity.score(docs, y, max_labelled=150, max_train=100).toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all() and got[got.doc_id == 7].score.nunique() <= 2
    assert (got[got.doc_id == 1002].predicted == 1).all() and (got[got.doc_id.isin([1000, 1001])].predicted == 0).all()


def test_toxicity_keeps_unrelated_words_that_tie(spark):
    # the k-th of 60 words marks its own texts only: numbers of texts are different but for the last six, of which each has 20
    r = random.Random(11)
    word = lambda k: chr(97 + k // 10) + chr(97 + k % 10) + "zzqzzq"
    marks = [k for k in range(60) for _ in range(20 if k >= 54 else 21 + k)]
    texts = [(i, " ".join([r.choice(VOCABULARY), word(k), r.choice(VOCABULARY)])) for i, k in enumerate(marks)]
    docs = spark.createDataFrame(texts + [(len(texts) + i, " ".join(r.choice(VOCABULARY) for _ in range(5))) for i in range(4000)], "doc_id long, text string")
    lexicon = toxicity.mine(docs, docs.select("doc_id", (F.col("doc_id") < len(texts)).cast("int").alias("y")), 20_000, 4_000)
    buf, off = ts.raw(pa.array([word(k) for k in range(60)]))
    doc, entry = lexicon.hits(*toxicity.entries(buf, off)[:2])
    assert sorted(doc) == list(range(60)) and len(set(entry)) == 60  # one entry each: its beginning of four


def test_warc_round_trip(spark):
    table = [(1, "u", "a"), (2, "v", "a"), (3, None, None), (4, "w", ""), (None, "x", "b"), (5, "y\r\nWARC-Type: request", "c"), (5, "y", "c"), (None, None, "a"), (9, "z", "é" * 100_000)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    for options in ({"compression": "gzip", "max_file_bytes": 300}, {"compression": "none"}):
        path = scratch.new_path(spark, "warc-test")
        warc.archive(pages, path, **options)
        got = warc.read(spark, path)
        assert got.where("record_type = 'revisit'").count() == 3
        sha = lambda t: "sha1:" + base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        assert sorted(r[0] for r in got.where("record_type <> 'warcinfo'").select("payload_digest").collect()) == sorted(sha(t) for _, _, t in table)
        assert got.where("record_id = '<urn:page:9>'").first()["payload"] == table[-1][2].encode()
        pushed = warc.read(spark, path, payload="false").where("record_type = 'revisit' and target_uri like 'u%'")
        assert "Filter (" not in pushed._jdf.queryExecution().executedPlan().toString() and [r["record_id"] for r in pushed.collect()] == ["<urn:page:1>"]
    path = scratch.new_path(spark, "warc-test")
    warc.archive(pages.limit(0), path)
    assert warc.read(spark, path).where("record_type <> 'warcinfo'").count() == 0


def test_warc_smaller_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bbbb"), (4, "bbbb")], "page_id long, html string")
    path = scratch.new_path(spark, "warc-test")
    warc.archive(pages, path, revisit_bytes=3)
    assert rows(warc.read(spark, path).where("record_type = 'revisit'").select("record_id", "refers_to")) == [("<urn:page:3>", "<urn:page:4>")]


def test_warc_columns_with_clashing_names(spark):
    """The query's own columns, from a table with columns named as the operator's own."""
    table = [(1, "u", "a", "x", "q"), (2, "v", "a", "x", "q"), (3, "w", None, "x", "q")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, payload string, sha string").withColumns({"n": F.lit(1), "keeper": F.lit(9), "record_type": F.lit("z")})
    path = scratch.new_path(spark, "warc-test")
    warc.archive(pages, path)
    assert rows(warc.read(spark, path).where("record_type <> 'warcinfo'").select("record_id", "record_type", "refers_to")) == [("<urn:page:1>", "revisit", "<urn:page:2>"), ("<urn:page:2>", "response", None), ("<urn:page:3>", "response", None)]


def test_warc_query_columns(spark, tmp_path):
    table = [(1, "u", "a"), (2, "v", "a"), (3, None, None), (4, "w", ""), (5, "x", "é" * 50_000)]
    spark.createDataFrame(table, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    keeper = {"a": 2, "": 4}
    want = [(i, len((t or "").encode()), b32(t), "revisit" if keeper.get(t or "", i) != i else "response", keeper[t or ""] if keeper.get(t or "", i) != i else None) for i, _, t in table]
    got = warc.op1_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and rows(got) == sorted(want, key=repr)


def test_warc_of_others(spark, tmp_path):
    """Header names in any case; a record that is cut off is refused whether or not its payload is read."""
    import gzip

    head = b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id: <a>\r\nWARC-TARGET-URI: http://x\r\ncontent-length: 5\r\n\r\nhello"
    good, cut = tmp_path / "good", tmp_path / "cut"
    good.mkdir()
    cut.mkdir()
    (good / "a.warc").write_bytes(head + b"\r\n\r\n")
    (good / "b.warc.gz").write_bytes(gzip.compress(head + b"\r\n\r\n"))
    (good / "c.warc").write_bytes(head)  # without the empty lines at the end
    assert rows(warc.read(spark, str(good)).where("record_type = 'response' and target_uri = 'http://x'").selectExpr("record_id", "cast(payload as string)")) == [("<a>", "hello")] * 3
    for data in (head[:-2], gzip.compress(head[:-2]), gzip.compress(head)[:-12], warc.member(head, 1)[:-3]):
        (cut / ("a.warc.gz" if data[:1] == b"\x1f" else "a.warc")).write_bytes(data)
        for payload in ("true", "false"):
            for kept in ("true", "record_type = 'request'"):
                with pytest.raises(Exception, match="cut off"):
                    warc.read(spark, str(cut), payload=payload).where(kept).collect()
        for f in cut.iterdir():
            f.unlink()


def test_foreign_gzip_members(spark, tmp_path):
    import gzip

    a, b = (warc.block([("WARC-Type", t), ("WARC-Record-ID", f"<{t}>")], x) for t, x in (("response", b"x" * 100_000), ("request", b"y")))
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b) + gzip.compress(a))
    assert rows(warc.read(spark, str(tmp_path)).selectExpr("record_id", "octet_length(payload)")) == [("<request>", 1), ("<response>", 100_000), ("<response>", 100_000)]
