"""Stored vector index against the exact search, pruning, and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.operators import vector_index as V

from .test_plans import plan


def clustered(n=6000, groups=30, d=32):
    """Vectors around a few directions; a third of them around the first."""
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(groups, d))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    return (heads[at] + 0.35 * rng.normal(size=(n, d))).tolist()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    odd = [(90_001, None), (90_002, [0.0] * 32), (90_003, [float("nan")] + [1.0] * 31), (90_004, [1.0] * 5), (None, [1.0] * 32), (90_005, [None] + [1.0] * 31)]
    good = spark.createDataFrame([(i, v) for i, v in enumerate(clustered())], "id long, embedding array<double>")
    chunks = good.unionByName(spark.createDataFrame(odd, "id long, embedding array<double>")).withColumn("cell", F.lit("clash"))
    folder = tmp_path_factory.mktemp("vectors")
    chunks.write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    quantisers = V.fit(good, 10)
    V.store(chunks, quantisers, f"{folder}/index")
    queries = chunks.where("id % 40 = 0 OR id > 90000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return f"{folder}/index", chunks.select("id", "embedding"), queries, quantisers


def test_recall_and_pruning(spark, made):
    path, chunks, queries, quantisers = made
    found = V.search(path, chunks, queries, 10).collect()
    want = {(r.query_id, r.id): r.distance for r in R.vector_topk_batch(chunks, queries.where("query_id < 90000"), 10).collect()}
    assert len({r.query_id for r in found}) == 150 and all(r["rank"] <= 10 for r in found)
    assert len(want.keys() & {(r.query_id, r.id) for r in found}) >= 0.95 * len(want)
    assert all(abs(want[r.query_id, r.id] - r.distance) < 2e-6 for r in found if (r.query_id, r.id) in want)
    # one query reads the partitions of its own cells only
    assert quantisers.probes < len(quantisers.centres) / 2
    one = V.candidates(V.open_store(spark, path)[0], quantisers, queries.where("query_id = 40"), quantisers.probes, 40)
    text = plan(one)
    assert "dynamicpruning" in text and "number of partitions read" not in text
    one.collect()
    read = [int(m) for m in re.findall(r"number of partitions read: ([\d,]+)", _metrics(one))]
    assert read and max(read) <= quantisers.probes


def _metrics(df):
    """Metrics of the scans of an executed plan, as lines."""
    out = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if "FileSourceScan" in name:
            metric = node.metrics().get("numPartitions")
            if metric.isDefined():
                out.append(f"number of partitions read: {metric.get().value()}")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return "\n".join(out)


def test_all_cells_are_exact(spark, made):
    path, chunks, queries, quantisers = made
    some = queries.where("query_id % 400 = 0")
    found = V.search(path, chunks, some, 7, probes=len(quantisers.centres), keep=7000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.vector_topk_batch(chunks, some, 7).select("query_id", "rank", "id", "distance").collect()))


def test_every_usable_row_is_indexed_once(spark, made):
    blocks, _ = V.open_store(spark, made[0])
    ids = blocks.select(F.explode("ids").alias("id"))
    assert ids.count() == 6000 and ids.distinct().count() == 6000 and blocks.where(F.size("ids") > V.BLOCK).isEmpty()
    with pytest.raises(ValueError):
        V.fit(made[1].limit(0))


def test_exact_batch_of_odd_vectors(spark):
    """Null, zero and shorter vectors, ties, fewer rows than k: both ways of the exact search agree."""
    rows = [(i, [1.0, float(i % 3)]) for i in range(20)] + [(50, None), (51, [0.0, 0.0]), (52, [1.0]), (53, [1.0, float("nan")])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [3.0, 3.0])], "query_id string, query_vector array<double>")
    found = sorted(map(tuple, R.vector_topk_batch(chunks, queries, 9).select("query_id", "rank", "id", "distance").collect()))
    want = []
    for q, v in (("a", [1.0, 0.0]), ("b", [2.0]), ("e", [3.0, 3.0])):
        near = sorted((round(1 - float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), i) for i, x in rows if x and len(x) == len(v) and any(x) and not np.isnan(x).any())
        want += [(q, r, i, d) for r, (d, i) in enumerate(near[:9], 1)]
    assert [(q, r, i) for q, r, i, _ in found] == [(q, r, i) for q, r, i, _ in sorted(want)]
