"""The physical plans that the queries must keep."""

import re

import pytest

from blockloom.queries import catalog, engine_queries, hot_key_queries

PROBLEMS = {n: q for m in catalog.modules() for n, q in m.QUERIES.items() if re.match(r"p\d+_", n)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PROBLEMS)
def test_no_pair_products(spark, data, name):
    text = plan(PROBLEMS[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_segments_take_one_sort(spark, data):
    text = plan(hot_key_queries.p6_found(spark, data))
    assert text.count("Sort [") == 1 and text.count("Exchange hashpartitioning") == 2


def test_pushdown(spark, data):
    e = engine_queries.engine(spark, data)
    text = plan(e.table("logs", ["log_id"], ["block_number >= 1000030", "topic1 IS NOT NULL"]))
    assert "GreaterThanOrEqual(block_number,1000030)" in text and "IsNotNull(topic1)" in text
    assert re.search(r"ReadSchema: struct<log_id:bigint,block_number:bigint,topic1:binary>", text)
    text = plan(e.sql("SELECT number FROM eth.blocks WHERE number >= current_block('eth') - 5"))
    assert "GreaterThanOrEqual(number," in text and "ReadSchema: struct<number:bigint>" in text


def test_sql_reads_only_surviving_files(spark, data):
    e = engine_queries.engine(spark, data)
    every = e.sql("SELECT * FROM logs").inputFiles()
    some = e.sql("SELECT count(*) AS n FROM logs WHERE floor(block_number / 500) = 2000 OR block_number < 0").inputFiles()
    assert 0 < len(some) <= len(every)
