"""The pipeline: stages keep columns, act on what came before, and agree with their operators."""

import corpus_pipeline
from test_jaccard import brute

from tessera.llm import decontaminate, language, pieces, quality
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before, kept = docs.columns, {r.doc_id: r for r in docs.collect()}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
        assert all(now[i][c] == before[i][c] for i in now for c in columns)
        kept[k] = before, now
        before = now
    was, now = kept[2]
    assert sorted(now) == sorted(i for i, (_, c) in brute([(i, r.text) for i, r in was.items()]).items() if i == c)
    was, now = kept[3]
    leaks = decontaminate.leaks(spark.createDataFrame([(i, r.text) for i, r in was.items()], "doc_id long, text string"), table(spark, SF, "benchmark"))
    assert {*was} - {*now} == {r.doc_id for r in leaks.collect()}
    was, now = kept[0]
    scores = {r.doc_id: r.predicted for r in quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert {*now} == {i for i in was if scores[i]}
    was, now = kept[1]
    assert all(language.words_of(r.text) for r in now.values())
    model = pieces.Model.load()
    import numpy as np

    assert all(pieces.decode(model, np.array(r.piece_ids, np.int32)) == r.text.replace("▁", " ") and r.n_pieces == len(r.piece_ids) for r in kept[4][1].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {*kept[4][1]}


def test_stages_hand_on_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessera import store

    def size(x: pa.Array) -> pa.Array:
        return pa.array([x.nbytes] * len(x), pa.int64())

    before = spark.conf.get(store._BATCH)
    docs = table(spark, SF, "documents")
    long = spark.range(3_000, numPartitions=1).select(F.repeat(F.lit("some words "), 400).alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.set(store._BATCH, before)
        try:
            stage(spark, docs, SF)
            most = long.select(F.arrow_udf(size, "long")("text").alias("n")).agg(F.max("n")).first()[0]
        finally:
            spark.conf.set(store._BATCH, before)
        assert most <= 1.1 * store.BATCH_BYTES, name
