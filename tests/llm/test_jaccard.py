"""The parity-sketch join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.components import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Least reachable doc_id by row, over an inverted index (a pair without a common shingle cannot link)."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for ids in index.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    i = len(sets[a] & sets[b])
                    if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}


def make(seed, sizes, vocabulary=5000):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    rows, shared = [], [word() for _ in range(60)]
    for n in sizes:
        base = [word() for _ in range(n)]
        if r.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = shared
        rows.append(base)
        for _ in range(r.randint(0, 4)):  # copies about the threshold: each edit breaks up to five shingles, each addition changes the size
            copy = list(base)
            for _ in range(r.randint(0, max(1, n // 30))):
                copy[r.randrange(len(copy))] = word()
            copy += [word() for _ in range(r.randint(0, n // 5))]
            rows.append(copy)
    r.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = make(seed, [r.choice([1, 3, 5, 8, 12, 20, 40, 62, 66, 70, 90, 125, 130, 180, 250, 260, 400, 1000]) for _ in range(160)])
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_prefixes_of_linked_sets_meet():
    """The pigeonhole step alone: no linked pair is without a common word, whatever the sizes and the order."""
    import numpy as np

    g = np.random.default_rng(3)
    hot = np.packbits(g.random(1 << jaccard.HOT_BITS) < 0.3)
    for _ in range(2500):
        n = int(g.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 20, 31, 50, 62, 64, 66, 80, 120, 127, 129, 200, 260, 600, 1100, 3900, 4090, 4100, 4300, 5200, 8000, 8300, 10_900]))
        a = g.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + g.integers(0, 2, n).astype(np.uint64)
        most = g.random() < 0.5  # as different as linked sets can be, all from one side or the other
        drop = n // 4 if most and g.random() < 0.5 else int(g.integers(0, n // 4 + 1))
        more = n // 3 if most and drop == 0 else int(g.integers(0, n // 3 + 1))
        b = np.concatenate([a[drop:], g.integers(0, 1 << 63, more).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        i = len(np.intersect1d(a, b))
        if 100 * i >= 75 * (len(a) + len(b) - i):
            (v, p), (w, q) = jaccard.prefix(a, hot), jaccard.prefix(b, hot)
            common, x, y = np.intersect1d(v, w, return_indices=True)
            assert common.size
            (la, ha), (lb, hb) = jaccard.partners(np.full(len(x), len(a)), p[x]), jaccard.partners(np.full(len(y), len(b)), q[y])
            met = (la <= len(b)) & (len(b) <= ha) & (lb <= len(a)) & (len(a) <= hb) & (7 * (p[x].astype(int) + q[y]) <= len(a) + len(b))
            assert met.any()
            x, y = sorted((jaccard.bit_sketch(a), jaccard.bit_sketch(b)), key=len)
            y = y if len(y) == len(x) else y[: len(x)] ^ y[len(x) :]
            parity = np.unpackbits((x ^ y).view(np.uint8)).sum()
            assert parity <= len(a) + len(b) - 2 * i


def test_large_sets_and_band_edges(spark):
    """Copies about the threshold of sets of 3,000 to 20,000 shingles, and of sizes about powers of two."""
    r = random.Random(7)
    rows, word = [], lambda: f"w{r.randrange(100_000)}"
    for n in (3_000, 4_090, 4_110, 5_400, 8_180, 8_200, 10_500, 16_300, 20_000, 250, 256, 262, 340, 510, 515, 1_020, 1_030, 1_360, 2_045, 2_060):
        base = [word() for _ in range(n)]
        rows.append(base)
        for kind in range(4):
            copy = list(base)
            if kind in (0, 2):  # runs of new words, each of which also changes the four shingles before it
                at = r.randrange(len(copy) // 2)
                copy[at : at + int(n * r.uniform(0.10, 0.17))] = [word() for _ in range(int(n * r.uniform(0.10, 0.17)))]
            if kind in (1, 2):
                copy += [word() for _ in range(int(n * r.uniform(0.0, 0.36)))]
            if kind == 3:
                copy = copy[int(n * r.uniform(0.2, 0.28)) :]
            rows.append(copy)
    r.shuffle(rows)
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    groups = len({c for _, c in want.values()})
    assert 20 < groups < 100


def test_without_broadcasts_and_with_split_words(spark, monkeypatch):
    """Joins by shuffle only; a passage that most documents share, in words that are split; classes over the limit."""
    from tessera import store

    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        own = [f"w{r.randrange(400)}" for _ in range(r.choice([0, 8, 14, 20, 30]))]
        rows.append(passage[: r.choice([60, 58, 50])] + own)
    rows += [["same", "words", "here", "and", "there", "again"]] * 40
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(df) == want
    for name, value in (("HEAVY", 10), ("ENTRIES", 500)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "HOT_SHARE", 0.5)
    sets = jaccard.written_sets(df)
    known = sets.select("doc_id", F.col("doc_id").alias("component"), F.col("doc_id").alias("pivot"), F.lit(0).cast("long").alias("radius"))
    _, split = jaccard._hot(sets, known, 4)
    assert split.shape[1] > 10 and (split[1] > 1).all() and (split[0][1:] > split[0][:-1]).all()
    assert got(df) == want
    monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
    assert got(df) == want
    assert sorted(x.doc_id for x in jaccard.representatives(df).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_pivots_lose_no_link(spark, monkeypatch):
    """Groups of copies at growing distances from their text, and others about the threshold from some of a group only: links that only documents behind pivots have, and few pairs for many that have none."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(100_000)}"
    rows = []
    for _ in range(6):
        base = [word() for _ in range(150)]
        for edits in [0] * 4 + [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 8]:
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(150)] = word()
            rows.append(copy + [word() for _ in range(r.randrange(3))])
        for cut in range(20, 70, 2):  # partly the text, partly others of the kind
            rows.append(base[: 150 - cut] + [word() for _ in range(cut)])
    r.shuffle(rows)
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    opened, asked = jaccard.open_pairs, []

    def counted(*x):
        out = opened(*x)
        asked.append(sum(x.count() for x in out))
        return out

    monkeypatch.setattr(jaccard, "open_pairs", counted)
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert asked[0] > 0 and len({c for _, c in want.values()}) > 20


@pytest.mark.parametrize("seed", [3, 4])
def test_links_behind_pivots(spark, seed):
    """Sets behind any pivots, near and far: what is linked for certain or by candidates ties the same components as all pairs of sets do."""
    r = random.Random(seed)
    fresh = lambda k: [r.getrandbits(64) for _ in range(k)]
    sets, pivot = {}, {}
    for _ in range(5):
        base, kept = fresh(120), fresh(15)
        for size in (25, 25, 8, 3, 1, 1, 1, 1, 1, 1):  # groups of one text whose pivots are at several distances from it
            own = r.sample(base, 120 - r.randrange(24)) + fresh(r.randrange(24)) + kept[: r.randrange(16)]
            first = len(sets)
            for k in range(size):
                i = len(sets)
                x = set(own) if not k else set(r.sample(own, len(own) - r.randrange(9))) | set(kept[: r.randrange(8)]) | set(fresh(r.randrange(8)))
                sets[i], pivot[i] = x, first if len(x ^ set(own)) * 7 <= len(x) + len(own) else i
    base, other, n = fresh(120), fresh(19), len(sets)
    for i, (p, k) in enumerate([(n, 0), (n, 1), (n, 2), (n + 3, 19), (n + 3, 10)], n):  # the last links to the first of them, and its pivot does not
        sets[i], pivot[i] = set(base[k:]) | set(other[:k]), p
    pivot = {i: p if pivot[p] == p else i for i, p in pivot.items()}
    root = dict(pivot)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ties = lambda pairs: [root.update({max(find(a), find(b)): min(find(a), find(b))}) for a, b in pairs if find(a) != find(b)]
    linked = lambda a, b: len(sets[a] ^ sets[b]) * 7 <= len(sets[a]) + len(sets[b])
    heads = sorted(set(pivot.values()))
    gaps = [(a, b, len(sets[a] ^ sets[b])) for a in heads for b in heads if a < b and sets[a] & sets[b]]
    ties([(a, b) for a, b, _ in gaps if linked(a, b)])
    before = {i: find(i) for i in sets}
    table = spark.createDataFrame([(i, len(x), bytearray(jaccard.pack(jaccard.np.array(sorted(x), "uint64")))) for i, x in sets.items()], "doc_id long, n int, hashes binary")
    known = spark.createDataFrame([(i, i, p, len(sets[i] ^ sets[p]), len(sets[i])) for i, p in pivot.items()], "doc_id long, component long, pivot long, radius long, n long")
    apart, tied = spark.createDataFrame(gaps, "a long, b long, gap long"), spark.createDataFrame(list(before.items()), "node long, component long")
    sure, behind = ([(x.a, x.b) for x in t.collect()] for t in jaccard.open_pairs(apart, known, tied, table))
    assert sure and behind and all(linked(a, b) for a, b in sure) and all(before[a] != before[b] for a, b in sure + behind)
    ties(sure + [(a, b) for a, b in behind if linked(a, b)])
    mine = {i: find(i) for i in sets}
    root.update(before)
    ties([(a, b) for a in sets for b in sets if a < b and linked(a, b)])
    assert mine == {i: find(i) for i in sets} != before


def test_texts_are_read_once_and_never_shuffled(spark):
    df = spark.createDataFrame([(i, f"a b c d e f g h {i % 7}") for i in range(50)], "doc_id long, text string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    sets = jaccard.written_sets(df)
    assert "text" not in sets.columns and "text" not in plan(jaccard.link(df))
    assert sets.inputFiles()  # written


def test_hashes_pack_whole():
    import numpy as np
    import pyarrow as pa

    for n in (1, 2, 1000):
        h = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert (jaccard.unpack(jaccard.pack(h)) == h).all()
        back = jaccard._sets(pa.array([None, jaccard.pack(h)], pa.binary()))
        assert len(back[0]) == 0 and back[1].dtype == np.uint64 and (back[1] == h).all()


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Too short"), (5, "too  SHORT\n"), (6, "é É"), (7, "É É"), (8, "one two three four five"), (8, "one two three four five"), (9, "ONE two three four five"), (None, "one two three four five"), (10, " "), (11, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(1)).withColumn("component", F.lit(2))
    out = sorted(map(tuple, jaccard.link(df).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (8, 1, 8), (9, 1, 8), (None, 1, None), (10, 1, 10), (11, 1, 11)]
    assert out == sorted(want, key=str)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 2, 3, 4, 6, 7, 8, None, 10, 11], key=str)
    assert jaccard.link(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(180)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            root[max(x, y)] = min(x, y)
    want = {i: find(i) for e in edges for i in e if e[0] != e[1]}
    assert {r.node: r.component for r in components(df).collect()} == want


def test_sets_that_share_a_passage_make_no_pairs(spark, monkeypatch):
    """300 documents with 75 words in common and 25 of their own cannot link; two of them have a near copy."""
    monkeypatch.setattr(jaccard, "_hot", lambda *_: (np.zeros(1 << jaccard.HOT_BITS >> 3, np.uint8), jaccard._WHOLE))  # common words are not put last
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(75))
    texts = [passage + " " + " ".join(str(rng.random()) for _ in range(25)) for _ in range(300)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:2]]
    base = jaccard.written_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    known = base.selectExpr("doc_id", "doc_id as component", "doc_id as pivot", "0L as radius")
    pairs = {(r.a, r.b) for r in jaccard.candidates(base.select("doc_id", "n", "low", "hashes"), known, 100 * len(texts)).collect()}
    assert {(0, 300), (1, 301)} <= pairs and len(pairs) < 9_000  # of 45,000


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200))
@settings(max_examples=50, deadline=None)
def test_parities_differ_in_no_more_than_the_sets(a, b):
    x, y = (jaccard.parities(np.array(sorted(s), np.uint64)) for s in (a, a ^ b))
    assert np.bitwise_count(x ^ y).sum() <= len(b)


def test_small_batches_are_dealt_together():
    import pyarrow as pa

    sets = [jaccard.shingles(pa.scalar(" ".join(f"{k}w{i}" for i in range(n + 4)))) for k, n in enumerate([3, 40_000, 1, 900_000, 1_200_000, 5, 7] + [30_000] * 60)]
    rows = pa.table({"doc_id": range(len(sets)), "hashes": pa.array([jaccard.pack(h) for h in sets], pa.binary())})
    for size in (1, 3, len(sets)):  # rows a batch
        parts = list(jaccard._parts(iter(rows.to_batches(size))))
        assert pa.Table.from_batches(parts).equals(rows.combine_chunks())
        sizes = [sum(len(x) for x in p.column("hashes").to_pylist()) for p in parts]
        assert all(s <= jaccard.DEALT_BYTES or p.num_rows == 1 for s, p in zip(sizes, parts))
        assert all(a + b > jaccard.DEALT_BYTES for a, b in zip(sizes, sizes[1:])) and max(p.num_rows for p in parts) > 20
    assert not list(jaccard._parts(iter([rows.to_batches()[0].slice(0, 0)])))


def test_workers_get_small_batches(spark, monkeypatch):
    """What executors hold outside the heap follows the batches: all that the join writes is made in a session of small ones, which then is as before."""
    from tessera import store

    seen, write = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, name: (seen.append((name, spark.conf.get(store._BATCH))), write(df, name))[1])
    before = spark.conf.get(store._BATCH)
    rows = make(5, [40] * 12)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert {"sets", "sketches", "links", "pairs", "differences"} <= {name for name, _ in seen} and {x for _, x in seen} == {str(store.BATCH_BYTES)}
    assert spark.conf.get(store._BATCH) == before
    spark.conf.set(store._BATCH, "64k")  # what is smaller stays
    try:
        with store.bounded_batches(spark):
            assert spark.conf.get(store._BATCH) == "64k"
    finally:
        spark.conf.set(store._BATCH, before)


def test_a_task_leaves_its_worker_small():
    import subprocess
    import sys

    code = """
import os, pathlib, sys
sys.path.insert(0, os.getcwd())
from tessera.llm.common import thrifty
anon = lambda: int(next(x.split()[1] for x in pathlib.Path('/proc/self/status').read_text().splitlines() if x.startswith('RssAnon'))) >> 10
def task(batches):
    for n in batches:
        held = [bytes(2_000) for _ in range(n)]  # below malloc's threshold for maps of their own
        last = bytes(2_000)  # what stays on top keeps all below
        del held
        yield last
before = anon()
kept = list(thrifty(task)([50_000]))
print(anon() - before)
"""
    root = jaccard.__file__.rsplit("/tessera/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(out) < 30  # of 100 MB
