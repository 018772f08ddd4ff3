"""Small graphs cost few tasks, and near-dedup's shuffle files go as its steps end."""

import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import common, components  # noqa: E402


def test_small_graphs_lie_in_few_partitions(spark, monkeypatch):
    """A chain, a star and a cycle, dealt over more partitions than they need."""
    edges = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64", "false")):
        spark.conf.set(n, v)
    try:
        found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(40))
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert {r.node: r.root for r in found.collect()} == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 151), 100), **dict.fromkeys(range(200, 209), 200)}
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_shuffles_are_freed_inside_only(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with common.shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
