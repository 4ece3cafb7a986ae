from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C

from .brute import jaccard_components, tile_coverage
from .test_texts import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    kept = docs
    for name, stage in C.STAGES[:-1]:
        before, kept = {r.doc_id: r for r in kept.collect()}, stage(spark, kept, SF)
        assert kept.columns == docs.columns
        after = {r.doc_id: r for r in kept.collect()}
        assert after.keys() < before.keys()
        assert all(after[i] == before[i] for i in after)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            right = [(i in after) == bool(q) for i, q in labels.items()]
            assert np.mean(right) > 0.9
        if name == "near_duplicates":
            parts = jaccard_components({i: r.text for i, r in before.items()}, 5, 80)[1]
            assert set(after) == set(parts.values())
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
            assert set(after) == {i for i, r in before.items() if all(tile_coverage(x, r.text, 4) < 0.6 for x in items)}
    place = {i: k for k, i in enumerate(sorted(after))}
    packed = [SimpleNamespace(**r.asDict() | {"doc_id": place[r.doc_id]}) for r in C.packing(spark, kept, SF).collect()]
    check_packing(packed, [after[i].text for i in sorted(after)])


def test_run_is_the_stages(spark):
    out = C.run(spark, SF)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and per.where("n > 4096").count() == 0


def test_odd_rows_pass(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, None, None, None, None), (3, "a b c d e f g " * 5000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
