"""Goldens, differential and property tests of the relational, run-length and neighbour modules."""

import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import metrics, minhash
from tessera.functions.minhash import LARGEST, jaccard, keyword_hash, signature
from tessera.operators import neighbors as nn
from tessera.operators import relational as rel
from tessera.operators import rle
from tessera.plans.queries import ORACLES, QUERIES
from tessera.sources import catalog

SF = "/root/testdata/sf0.001"
FILMS = [
    ("Star Wars", ["space", "force", "jedi", "empire", "lightsaber"]),
    ("The Lord of the Rings", ["fantasy", "hobbit", "orcs", "swords"]),
    ("Ghost in the Shell", ["cyberpunk", "anime", "hacker"]),
]
GOLDEN = {21: (99766, 4722, 53951), 22: (67943, 31621, 27051), 23: (10410, 14613, 28224)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", GOLDEN)
def test_signature_goldens(spark, seed):
    got = dict(rows(catalog.keyword_list(spark, FILMS).select("id", signature(F.col("keywords"), seed))))
    assert got == dict(zip([n for n, _ in FILMS], GOLDEN[seed], strict=True))


def test_hash_over_supplementary_characters(spark):
    """Python's own UTF-16 units give the reference value."""

    def want(word, seed):
        units = (word + str(seed)).encode("utf-16-be")
        h = 0
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        signed = lambda x: (x & 0xFFFFFFFF) - (1 << 32) * ((x & 0xFFFFFFFF) >> 31)
        h = signed(signed(h) * -862048943) >> 15
        return abs(signed(h * 461845907) >> 13)

    words = ["a", "né", "日本", "😀x", "x" * 300, ""]
    got = [r[0] for r in catalog.keyword_list(spark, [(str(i), [w]) for i, w in enumerate(words)]).orderBy("id").select(signature(F.col("keywords"), 7)).collect()]
    assert got == [want(w, 7) for w in words]
    df = catalog.keyword_list(spark, [(str(i), [w]) for i, w in enumerate(words)]).orderBy("id")
    assert [r[0] for r in df.select(keyword_hash(F.col("keywords")[0], 7)).collect()] == got
    assert max(got) <= LARGEST


@pytest.mark.parametrize("make", [lambda p: nn.BaseLSH(p, 43), lambda p: nn.BroadcastLSH(p, 43), lambda p: nn.BalancedLSH(p, 43, 3), lambda p: nn.ExactNN(p, 0.7), nn.precise, nn.thorough])
def test_reflexive_and_empty(spark, make):
    p = catalog.keyword_list(spark, FILMS)
    assert rows(make(p).eval(p)) == sorted((n, n) for n, _ in FILMS)
    assert make(p).eval(catalog.keyword_list(spark, [])).count() == 0
    assert make(catalog.keyword_list(spark, [])).eval(p).count() == 0


def _sets(n=120, seed=5):
    r = random.Random(seed)
    return [(f"p{i}", r.sample([f"w{k}" for k in range(14)], r.randint(1, 6))) for i in range(n)] + [("empty", [])]


def test_exact_against_all_pairs(spark):
    data = _sets()
    p = catalog.keyword_list(spark, data)
    for t in (0.0, 0.3, 0.5, 0.75):
        want = [(a, b) for a, x in data for b, y in data if x and y and len({*x} & {*y}) / len({*x} | {*y}) > t]
        assert rows(nn.ExactNN(p, t).eval(p)) == sorted(want, key=repr)


def test_lookups_agree_and_compose(spark):
    p = catalog.keyword_list(spark, _sets())
    base = rows(nn.BaseLSH(p, 43).eval(p))
    assert len(base) > 121
    assert rows(nn.BroadcastLSH(p, 43).eval(p)) == base
    assert rows(nn.BroadcastLSH(p, 43, limit=3).eval(p)) == base
    for n in (1, 2, 8, 60):
        assert rows(nn.BalancedLSH(p, 43, n).eval(p)) == base
    other = rows(nn.BaseLSH(p, 44).eval(p))
    assert rows(nn.AndOf([nn.BaseLSH(p, 43), nn.BaseLSH(p, 44)]).eval(p)) == sorted({*base} & {*other}, key=repr)
    assert rows(nn.OrOf([nn.BaseLSH(p, 43), nn.BaseLSH(p, 44)]).eval(p)) == sorted({*base} | {*other}, key=repr)
    h = nn.hashed(p)
    for point in (p, h):
        for kind, want in ((nn.AndOf, {*base} & {*other}), (nn.OrOf, {*base} | {*other})):
            assert rows(kind([nn.BaseLSH(point, 43), nn.BaseLSH(point, 44)]).eval(point)) == sorted(want, key=repr)
    third = rows(nn.BaseLSH(h, 45).eval(h))
    assert rows(nn.OrOf([nn.BaseLSH(h, s) for s in (43, 44, 45)]).eval(h)) == sorted({*base} | {*other} | {*third}, key=repr)
    exact = rows(nn.ExactNN(p, 0.3).eval(p))
    assert rows(nn.AndOf([nn.OrOf([nn.BaseLSH(h, 43), nn.BaseLSH(h, 44)]), nn.ExactNN(p, 0.3)]).eval(p)) == sorted(({*base} | {*other}) & {*exact}, key=repr)
    want = {}
    for q, n in base:
        want.setdefault(q, set()).add(n)
    assert {r.query_id: r.neighbors for r in nn.grouped(nn.BaseLSH(p, 43).eval(p)).collect()} == {q: sorted(n) for q, n in want.items()}


def test_hot_signature_is_spread(spark):
    """A third of all points are alike: their queries go to several partitions, and no partition has much over its share."""
    data = [(f"h{i}", ["same"]) for i in range(400)] + [(f"p{i}", [f"w{i}"]) for i in range(800)]
    h = nn.hashed(catalog.keyword_list(spark, data))
    lookup = nn.BalancedLSH(h, 43, 12)
    keyed = nn.signatures(h, 43).select(F.col("id").alias("query_id"), "sig")
    out = lookup._lookup(keyed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("exchange ") == 2 and "passthrough" in plan and "Python" not in plan and "NestedLoop" not in plan
    sizes = [r["count"] for r in out.select("query_id", "pid").distinct().groupBy("pid").count().collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 2 * 100 and len([s for s in sizes if s]) >= 12
    assert rows(lookup.eval(h)) == rows(nn.BaseLSH(h, 43).eval(h))


def test_points_are_hashed_once(spark):
    p = catalog.keyword_list(spark, _sets())
    python = lambda df: _plan(df).count("ArrowEvalPython")
    h = nn.hashed(p)
    for c in (nn.BaseLSH(h, 43), nn.BroadcastLSH(h, 43), nn.BalancedLSH(h, 43, 4), nn.precise(h), nn.thorough(h), nn.AndOf([nn.BaseLSH(h, 43), nn.BroadcastLSH(h, 44)])):
        assert python(c.eval(h)) == 0
    assert python(nn.signatures(p, 43).where("sig is not null").join(spark.range(3).toDF("j"), F.col("sig") == F.col("j"))) == 1
    assert _plan(nn.precise(h).eval(h)).count("Join") == 1


def test_quality_of_lookups(spark):
    """Thresholds and orders that hold for every corpus of near copies: AND is more precise with fewer results, OR finds more."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))
    docs = catalog.table(spark, "/root/testdata/sf0.01", "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), words.alias("keywords"))
    p = docs.where(F.size("keywords") > 0)
    h = nn.hashed(p)
    truth = nn.ExactNN(p, 0.3).eval(p)
    made = {"one": nn.BaseLSH(h, 42), "and": nn.AndOf([nn.BaseLSH(h, 42), nn.BaseLSH(h, 43)]), "or": nn.OrOf([nn.BaseLSH(h, 42), nn.BaseLSH(h, 43)]), "precise": nn.precise(h), "thorough": nn.thorough(h)}
    got = {k: (c.eval(h).count(), metrics.quality(truth, c.eval(h)).first()) for k, c in made.items()}
    q = {k: v[1] for k, v in got.items()}
    assert all(v["recall"] >= 0.8 for v in q.values()) and q["thorough"]["recall"] > 0.95
    assert q["and"]["precision"] > q["one"]["precision"] > q["or"]["precision"] and q["precise"]["precision"] > q["and"]["precision"]
    assert got["and"][0] < got["one"][0] < got["or"][0] and q["or"]["recall"] >= q["one"]["recall"] >= q["and"]["recall"]


def test_store(spark):
    from tessera import store

    df = spark.createDataFrame([(1, "x" * 100, ["a", "b"], [1, 2])], "a int, b string, c array<string>, d array<long>")
    assert store.fits(df, 300) and not store.fits(df, 100) and not store.fits(spark.range(100), 100)
    assert "hint broadcast" in store.small(df)._jdf.queryExecution().logical().toString().lower()
    kept = store.cut(df, "one")
    path = kept.inputFiles()[0].removeprefix("file://")
    import os

    assert kept.schema == df.schema and os.path.exists(path) and spark.sparkContext.applicationId in path
    store.drop_cut(kept)
    assert not os.path.exists(path)


def test_misses_are_kept_on_request(spark):
    p, q = catalog.keyword_list(spark, FILMS), catalog.keyword_list(spark, [("new", ["nothing", "alike"])])
    assert rows(nn.BaseLSH(p, 43, "keep").eval(q)) == [("new", None)]
    assert rows(nn.BaseLSH(p, 43).eval(q)) == []


def test_boundaries_fold(spark):
    r = random.Random(1)
    counts = sorted((s, r.randint(1, 9)) for s in r.sample(range(1000), 60))
    cuts, left, want = [], 0, -(-sum(c for _, c in counts) // 7)
    for i, (s, c) in enumerate(counts):
        left += c
        if left >= want or i == len(counts) - 1:
            cuts.append(s + 1)
            left = 0
    df = spark.createDataFrame(counts, "sig int, count long")
    assert nn.boundaries(df, 7).first()["bounds"] == cuts


def test_lists_are_hashed_in_parts():
    """20 MB of words in one batch, with nulls; as one they took over 400 MB."""
    lists = pa.array([[f"{i} word" * 20, "é", None] if i % 3 else None for i in range(200_000)], pa.list_(pa.string()))
    tracemalloc.start()
    got = minhash._list_hashes(lists)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20 and len(got) == len(lists)
    assert got.slice(150_000).equals(minhash._part_hashes(lists.slice(150_000)))


def _looked_up(spark):
    """Points with copies, near sets, a frequent word, odd words, and some without a word."""
    rng = random.Random(7)
    sets = [["a", *rng.sample("bcdefghijklmnop", rng.randint(0, 6)), *rng.sample(["", "é", "x" * 80, None], rng.randint(0, 2))] for _ in range(150)]
    return spark.createDataFrame([(str(i), s * (1 + i % 2)) for i, s in enumerate(sets + sets[:40] + [sets[0]] * 30)] + [("none", []), ("null", None)], "id string, keywords array<string>")


def test_lookups_measured_without_pairs(spark, monkeypatch):
    p = _looked_up(spark)
    truth, found = nn.ExactNN(p, 0.3).eval(p), nn.BaseLSH(p, 43).eval(p)
    words = {r.id: {*r.keywords} for r in p.where("size(keywords) > 0").collect()}
    assert {tuple(r) for r in truth.collect()} == {(x, y) for x in words for y in words if len(words[x] & words[y]) / len(words[x] | words[y]) > 0.3}
    assert nn.ExactNN(p, 0.3).eval(p.select("*")).exceptAll(truth).isEmpty()
    assert metrics.lookup_quality(p, 0.3, 43).first() == pytest.approx(metrics.quality(truth, found).first(), abs=1e-12)
    want = metrics.mean_distance(p, p, found).first()[0]
    assert 0 < want < 1 and metrics.lookup_distance(p, 43).first()[0] == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(metrics, "SHARE", 5)
    monkeypatch.setattr(metrics, "CELLS", 300)
    assert metrics.lookup_distance(p, 43).first()[0] == pytest.approx(want, abs=1e-12)
    none = p.where("id = 'none'")
    assert metrics.lookup_quality(none, 0.3, 43).first()[:] == (None, None, None) and metrics.lookup_distance(none, 43).first()[0] is None


@pytest.mark.parametrize("name", ["nn_recall", "nn_precision", "nn_mean_distance"])
def test_metrics_shuffle_no_pairs(spark, tmp_path, name):
    """2,000 documents in 40 groups of near copies have 100,000 pairs or more; what is shuffled follows the sentences."""
    rng = random.Random(3)
    texts = [". ".join([f"w{i % 40} {j}" for j in range(9)] + [f"own {rng.random()}"]) for i in range(2000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables are larger
    try:
        assert len(QUERIES[name](spark, str(tmp_path)).collect()) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(v for k, v in stages().items() if k not in before) < 80_000


def test_metrics(spark):
    pairs = lambda *x: spark.createDataFrame(x, "query_id string, neighbor_id string")
    got = metrics.quality(pairs(("a", "1"), ("a", "2"), ("b", "1"), ("c", "9")), pairs(("a", "1"), ("a", "3"), ("a", "4"), ("b", "1"), ("z", "1"))).first()
    assert got["recall"] == pytest.approx(0.75) and got["precision"] == pytest.approx((1 / 3 + 1) / 2) and got["coverage"] == pytest.approx(2 / 3)
    p = catalog.keyword_list(spark, [("a", ["x", "y"]), ("b", ["x"])])
    assert metrics.mean_distance(p, p, pairs(("a", "a"), ("a", "b"))).first()[0] == pytest.approx(0.25)
    assert spark.range(1).select(jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] is None


# --- run-length frames


def test_run_example(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("AAAAABBBAABAC")], "i int, c string")
    got = sorted(rle.encode(df, ["c"], ["i"]).runs.collect())
    assert [(r.c, r.length) for r in got] == [("A", 5), ("B", 3), ("A", 2), ("B", 1), ("A", 1), ("C", 1)]
    assert [r.start_vid for r in got] == [0, 5, 8, 10, 11, 12]


def test_reconstruct_example(spark):
    a = rle.RLEFrame(spark.createDataFrame([(2, 2, "a", None), (20, 1, "c", 7)], "start_vid long, length long, x string, y int"), ("x", "y"))
    b = rle.RLEFrame(spark.createDataFrame([(0, 11, 3.0), (18, 1000, 6.0)], "start_vid long, length long, z double"), ("z",))
    assert sorted(map(tuple, a.reconstruct(b).runs.collect())) == [(2, 2, "a", None, 3.0), (20, 1, "c", 7, 6.0)]


def test_join_multiplies_lengths(spark):
    run = lambda n: rle.RLEFrame(spark.createDataFrame([(0, n, 1)], "start_vid long, length long, k int"), ("k",))
    assert run(2).join(run(3), [("k", "k")]).decode(positions=False).count() == 6


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([None, 1, 2]), max_size=40), st.integers(2, 9))
def test_round_trip_over_block_edges(spark, values, block):
    kept, rle.BLOCK, rle.CHUNK = (rle.BLOCK, rle.CHUNK), block, 3
    try:
        df = spark.createDataFrame(list(enumerate(values)), "i long, v int")
        frame = rle.encode(df, ["v"], vid="i")
        assert [r.v for r in sorted(frame.decode().collect())] == values
        assert frame.runs.count() == sum(i == 0 or values[i] != values[i - 1] for i in range(len(values)))
        weighted = frame.agg(["v"], n=("count", "*"), s=("sum", "v"), c=("count", "v"), a=("avg", "v")).collect()
        assert {r.v: (r.n, r.c) for r in weighted} == {v: (values.count(v), values.count(v) if v is not None else 0) for v in {*values}}
    finally:
        rle.BLOCK, rle.CHUNK = kept


def test_long_run_decodes_in_chunks(spark):
    frame = rle.RLEFrame(spark.createDataFrame([(5, 100_000, 1)], "start_vid long, length long, k int"), ("k",))
    got = frame.decode().agg(F.count("*"), F.min("vid"), F.max("vid"), F.countDistinct("vid")).first()
    assert tuple(got) == (100_000, 5, 100_004, 100_000)


# --- relational


def test_null_keys_and_order(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"), spark.createDataFrame([(1, 2), (None, 3)], "j int, w int")
    assert rows(rel.join(a, b, [("k", "j")])) == [(1, "x", 1, 2)]
    assert rows(rel.join(a, b, [("k", "j")], broadcast_bytes=1 << 20)) == [(1, "x", 1, 2)]
    assert [r.k for r in rel.sort(a, [("k", "desc")]).collect()] == [1, None]
    assert [r.k for r in rel.sort(a, [("k", "asc")], offset=1).collect()] == [None]
    assert rel.sort(a, [("k", "asc")], fetch=0).count() == 0
    none = rel.where(a, "k < 0")
    assert rel.aggregate(none, [], F.count("*").alias("n")).collect()[0].n == 0
    assert rel.aggregate(none, ["v"], F.count("*").alias("n")).count() == 0
    assert rel.project(a, "v").columns == ["v"]


def test_sources(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|2|3|4|5.00|6.00|0.10|0.20|A|F|1994-01-02|1994-01-03|1994-01-04|x|y|z\n")
    df = catalog.delimited(spark, str(tmp_path / "t.tbl"), catalog.LINEITEM_FIELDS, view="own_lines")
    assert spark.sql("select l_quantity * 2 as q, l_shipdate - interval '1' day as d from own_lines").first()["q"] == 10
    assert len(df.columns) == 16
    (tmp_path / "k.txt").write_text("a|x|y\nb|z||\nc\n")
    assert rows(catalog.keyword_text(spark, str(tmp_path / "k.txt"))) == [("a", ["x", "y"]), ("b", ["z"]), ("c", [])]
    (tmp_path / "many.txt").write_text("".join(f"{i}\n" for i in range(1000)))
    catalog.sample_text(spark, str(tmp_path / "many.txt"), str(tmp_path / "out"), 0.3, seed=3)
    got = [int(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert 200 < len(got) < 400 and len({*got}) == len(got) and len(list((tmp_path / "out").glob("part-*"))) == 1


def test_stream_lookup(spark, tmp_path):
    from tessera.streaming.lookup import stream_lookup

    p = catalog.keyword_list(spark, FILMS)
    p.write.json(str(tmp_path / "in"))
    out = stream_lookup(spark.readStream.schema(p.schema).json(str(tmp_path / "in")), p, 43)
    q = out.writeStream.format("memory").queryName("looked_up").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("looked_up")) == sorted((n, n) for n, _ in FILMS)


# --- plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q6 = _plan(QUERIES["tpch_q6_like"](spark, SF))
    assert "PushedFilters: [" in q6 and "l_shipdate" in q6 and "l_orderkey" not in q6
    assert "TakeOrderedAndProject" in _plan(QUERIES["topk"](spark, SF))
    p = catalog.keyword_list(spark, FILMS)
    for make in (lambda: nn.BaseLSH(p, 43).eval(p), lambda: nn.ExactNN(p, 0.3).eval(p)):
        assert "Cartesian" not in _plan(make()) and "NestedLoop" not in _plan(make())
    runs = rle.RLEFrame(spark.createDataFrame([(0, 2, 1)], "start_vid long, length long, k int"), ("k",))
    assert "Generate" not in _plan(runs.agg(["k"], n=("count", "*")))
    assert "Generate" not in _plan(runs.join(runs, [("k", "k")]).where("k > 0").runs)
    assert "Cartesian" not in _plan(runs.reconstruct(runs).runs) and "NestedLoop" not in _plan(runs.reconstruct(runs).runs)


def _normal(v):
    return round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    ran = con.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    want = sorted((tuple(_normal(x) for x in r) for r in ran.fetchall()), key=repr)
    assert sorted((tuple(_normal(r[c]) for c in names) for r in df.collect()), key=repr) == want
