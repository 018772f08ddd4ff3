"""Keyed tables: edits touch their partitions only and may be run twice."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.sources.keyed import KeyedTable, load

SCHEMA = "k long, name string, n int"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


@pytest.fixture()
def table(spark, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, parts=16)
    made.create(spark.createDataFrame([(i, f"n{i}", i) for i in range(200)] + [(None, "nameless", 0)], SCHEMA))
    return made


@pytest.mark.parametrize(
    "edit, change",
    [
        (lambda t, new: t.upsert(new, "n"), lambda d: d | {3: ("three", 9), 500: ("new", 1), None: ("still", 5)}),
        (lambda t, new: t.insert_missing(new, "n"), lambda d: d | {500: ("new", 1)}),
        (lambda t, new: t.update(F.col("k") == 7, {"name": F.lit("seven")}), lambda d: d | {7: ("seven", 7)}),
        (lambda t, new: t.update(F.col("n").isNull(), {"name": F.lit("none")}), lambda d: d),
        (lambda t, new: t.replace(F.col("k").between(20, 21), new, "n"), lambda d: {k: v for k, v in d.items() if k not in (20, 21)} | {3: ("three", 9), 500: ("new", 1), None: ("still", 5)}),
        (lambda t, new: t.replace(F.col("k") == 9), lambda d: {k: v for k, v in d.items() if k != 9}),
    ],
)
def test_edits(spark, table, edit, change):
    new = spark.createDataFrame([(3, "old", 1), (3, "three", 9), (500, "new", 1), (None, "still", 5)], SCHEMA).withColumn("part", F.lit("clash"))
    want = sorted([(k, *v) for k, v in change({r.k: (r.name, r.n) for r in table.read().collect()}).items()], key=str)
    before = files(table.path)
    touched = edit(table, new)
    after = files(table.path)
    assert rows(table) == want
    same = {p for p in before if after.get(p) == before[p]}
    assert touched <= 5 and len({Path(p).parent for p in before.keys() - same}) <= touched and len(same) >= len(before) - touched
    edit(table, new)
    assert rows(table) == want


def test_without_an_order_the_choice_is_the_same(spark, table):
    new = spark.createDataFrame([(3, "b", 1), (3, "a", 9)], SCHEMA)
    table.upsert(new)
    table.upsert(new.orderBy("n"))
    assert [r for r in rows(table) if r[0] == 3] == [(3, "b", 1)]
    with pytest.raises(ValueError):
        table.update(F.lit(True), {"k": F.lit(1)})


def test_partitions_that_lose_all_rows(spark, table):
    table.replace(F.col("k") >= 0)
    assert rows(table) == [(None, "nameless", 0)]
    table.upsert(spark.createDataFrame([(1, "again", 1)], SCHEMA))
    assert rows(table) == [(1, "again", 1), (None, "nameless", 0)]
    table.create(spark.createDataFrame([], SCHEMA))
    assert rows(table) == []


def test_load(spark, tmp_path):
    some = spark.range(25).coalesce(1)
    path = str(tmp_path / "x")
    load(some, path, per_file=10)
    assert len(files(path)) == 3
    load(some, path)
    assert spark.read.parquet(path).count() == 50
    load(some, path, force=True)
    load(some, path, force=True)
    assert spark.read.parquet(path).count() == 25
