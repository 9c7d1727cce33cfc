"""The pipeline on whole small tables and on the edge cases; registered queries against their SQL."""

import pytest
from compare import duck, same

import corpus_pipeline
from citegrain.llm import queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF_DIR), duck(SF_DIR), queries.ORACLES[name]) is None


@pytest.mark.parametrize("table", ["cases", "nothing"])
def test_stages_on_edge_cases(spark, request, table):
    docs = request.getfixturevalue(table)
    docs = docs[0] if table == "cases" else docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        found = stage(spark, docs, SF_DIR)
        rows = found.count()
        if name != "sequence_packing":
            assert found.columns == docs.columns and rows <= 3 * docs.count()
            docs = spark.createDataFrame(found.collect(), found.schema)
        assert (rows > 0) == (table == "cases")


def test_pipeline_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    marks = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 0").select("doc_id")
    assert docs.join(marks, "doc_id", "left_semi").count() == 0
    packed = corpus_pipeline.run(spark, SF_DIR)
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
