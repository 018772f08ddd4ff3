"""Plans: pruned scans, pushed filters, bounded top-k, no products of tables."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import ingest, retrieval
from lodestone.plans.ingest import pages


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_products(name, spark, sf):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF\\b|BatchEvalPython", plan(catalog.QUERIES[name](spark, sf)))


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("verified_scan", r"PushedFilters: \[[^\]]*EqualTo\(p_brand,Brand#2\)[^\]]*\]\nReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_size:int>"),
        ("vector_topk", "TakeOrderedAndProject"),
        ("vector_topk_batch", "WindowGroupLimit"),
        ("history_window", "WindowGroupLimit"),
        ("dup_ids", r"ReadSchema: struct<conv_id:bigint>"),
        ("eval_rates", "HashAggregate"),
    ],
)
def test_plan(name, wanted, spark, sf):
    assert re.search(wanted, plan(catalog.QUERIES[name](spark, sf)))


def fold(text, limit):
    """The chunker, a line at a time."""
    out, held, para, first, letter = [], "", None, None, ""
    for line in (x.strip(" ") for x in text.split("\n")):
        if not line:
            continue
        major, minor = re.fullmatch(r"[A-Z]\.", line), re.fullmatch(r"\d+(\.[A-Za-z0-9]+)*", line)
        if (major or minor) and len(held) // 4 > limit:
            out.append((held, first or para))
            held, first = "", None
        if major:
            letter = line[0]
        elif minor:
            para = f"{letter}.{line}" if letter else line
            first = first or para
        held = f"{held}\n{line}" if held else line
    return out + [(held, first or para)] * bool(held)


def test_chunker_on_the_documents(spark, sf):
    rows = pages(spark, sf).select("text", ingest.split_page(F.col("text"), 60).alias("chunks")).collect()
    assert any(len(r.chunks) > 1 for r in rows)
    for r in rows:
        assert [tuple(c) for c in r.chunks] == fold(r.text, 60)


def test_query_blocks_without_a_broadcast_use_every_slot(spark, monkeypatch):
    """With queries beyond the limit no join key is constant, and the rows are the same."""
    rows = spark.range(300).select(F.col("id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"))
    queries = rows.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = sorted(map(tuple, retrieval.vector_topk_batch(rows, queries, 5).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    found = retrieval.vector_topk_batch(rows, queries, 5, block=4)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 50
    slots = retrieval.in_blocks(queries, rows, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in slots and "block = block" not in slots
