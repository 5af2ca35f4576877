"""The registered queries on the smallest tables, and the pipeline against its stages' promises."""

import os

import duckdb
import pytest

import corpus_pipeline
from poolwise.llm import registry
from poolwise.llm.near_dedup import near_classes
from poolwise.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"


def rows(table):
    names = sorted(table.column_names)
    return sorted(repr(tuple(r[c] for c in names)) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    assert rows(registry.queries()[name](spark, SF).toArrow()) == rows(con.sql(registry.oracle_sql()[name]).to_arrow_table())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = {}
    for name, work in corpus_pipeline.STAGES:
        after = work(spark, before, SF)
        if name != "packing":
            assert after.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before = after
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(kept["toxicity"]) == {r["doc_id"] for r in scores if not r["predicted"]}
    bare = {}
    for i in sorted(kept["toxicity"]):
        bare.setdefault("".join(kept["toxicity"][i].split(None)), []).append(i)
    assert len(kept["exact_dedup"]) == len(bare) and all(set(g) & set(kept["exact_dedup"]) for g in bare.values())
    classes = near_classes(spark.createDataFrame(list(kept["exact_dedup"].items()), "doc_id long, text string")).collect()
    assert set(kept["near_dedup"]) == {r["class_id"] for r in classes}
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and all(texts[i].startswith(t) for i, t in kept["mixing"].items())
    assert {r["doc_id"] for r in before.collect()} == set(kept["mixing"])
