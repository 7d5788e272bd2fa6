"""Registered queries against their DuckDB statements, and the pipeline's stages."""

import pytest
from check_oracle import compare, duck

import corpus_pipeline
from panelflow.llm.queries import QUERIES
from panelflow.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_matches_duckdb(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]).startswith("ok")


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", ["op1_chat_format", "op7_decontamination", "op10_sharding"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, SF).count() > 0
