"""The pipeline's stages against their operators' rules, and the registry."""

import corpus_pipeline
from __spark_entry__ import queries
from tests.llm.test_jaccard import by_all_pairs

NUMBERED = [f"op{n}_" for n in range(1, 14)]


def test_registry():
    names = list(queries())
    assert "pipeline" in names and all(sum(n.startswith(p) for n in names) == 1 for p in NUMBERED)


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    benchmark = docs.where("doc_id = 5").selectExpr("1L AS item_id", "text")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, now, str(tmp_path))
        if name != "pack":
            assert out.columns == now.columns
        location = f"{tmp_path}/{name}"
        out.write.parquet(location)
        now, seen[name] = spark.read.parquet(location), {r["doc_id"] for r in out.collect()}
    assert not {200, 201, 202, 208} & seen["language_id"] and {0, 5, 207} <= seen["language_id"]
    assert 203 in seen["language_id"] and not {203, 204} & seen["quality_rules"] and {0, 5, 12, 207} <= seen["quality_rules"]
    assert 5 in seen["near_copies"] and 5 not in seen["benchmark_passages"]
    assert {205, 206} & seen["quality_rules"] and not {205, 206} & seen["near_copies"]
    assert seen["pack"] == seen["benchmark_passages"]


def test_near_copies_keep_one_of_each_group(spark, docs, texts):
    out = corpus_pipeline.near_copies(spark, docs, "").collect()
    heads = {c for _, n, c in by_all_pairs(texts) if c is not None}
    assert {r["doc_id"] for r in out if r["doc_id"] is not None} == heads
    assert sum(r["doc_id"] is not None for r in out) == len(heads)
    assert sum(r["doc_id"] is None for r in out) == sum(i is None for i, _ in texts)


def test_empty_tables(spark, none, tmp_path):
    none.selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = none
    for _, function in corpus_pipeline.STAGES:
        now = function(spark, now, str(tmp_path))
        assert now.count() == 0
        now = now if "text" in now.columns else none
