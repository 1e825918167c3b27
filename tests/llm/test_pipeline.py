"""The pipeline's stages: order, columns, and that what each decides takes effect."""

from __future__ import annotations

import corpus_pipeline
from conftest import SF
from granary.llm import decontaminate


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert rows and max(map(sum, by.values())) <= 2048


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns and empty tables: no stage stops, and what has no text stays."""
    d = str(tmp_path)
    text = " ".join(f"word{i % 97}x{i}" for i in range(120))
    item = " ".join(f"item{i}" for i in range(40))
    kinds = "doc_id long, text string, lang string, source string, n_chars int, key string, h long, line int"
    rows = [(1, text), (1, text), (2, text + " more"), (3, None), (4, ""), (None, text), (None, None), (5, " ".join(["head", *item.split()[:7]])), (6, "before " + item + " after"), (7, " ".join(f"long{i}" for i in range(60_000)) + "\n" + text)]
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", 1, 1) for i, t in rows], kinds)
    spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (0, item), (None, None), (1, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for start in (docs, docs.where("false")):
        kept = start
        for name, apply in corpus_pipeline.STAGES[:-1]:
            kept = apply(spark, kept, d)
            assert kept.columns == docs.columns, name
            kept = spark.createDataFrame(kept.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, d)
        if start is docs:
            ids = [r.doc_id for r in kept.collect()]
            assert sorted(set(ids) - {None}) == [1, 3, 4, 5, 7] and ids.count(None) == 2 and ids.count(1) == 2
            assert "word1x1" not in next(r.text for r in kept.collect() if r.doc_id == 7)
            assert packed.where("piece = 0").count() == len(ids)
        else:
            assert kept.count() == packed.count() == 0
