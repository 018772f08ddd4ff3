"""Language detection on a held-out part, and the interval join against the exact test."""

import random

from pyspark.sql import functions as F

from lodestone.operators import detection, intervals
from lodestone.operators import tables as O


def test_detection_on_a_held_out_part(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("lang IS NOT NULL")
    model = detection.fit(docs.where("doc_id % 5 <> 0"))
    rest = docs.where("doc_id % 5 = 0")
    found = rest.join(detection.detect(rest.select("doc_id", "text"), model, ["doc_id"]), "doc_id")
    right, n, sure = found.select(F.sum((F.col("lang") == F.col("language")).cast("int")), F.count(F.lit(1)), F.min("confidence")).first()
    assert n >= 0.95 * rest.count() and right >= 0.95 * n and sure >= 0.5
    assert model.groupBy("lang").count().where(F.col("count") > detection.GRAMS * 5).isEmpty()


def test_the_model_speaks_only_where_markers_are_even(spark):
    words = spark.createDataFrame([("en", "thickness of bottom plating and frames"), ("id", "tebal pelat alas dan gading gading lambung")] * 3, "lang string, text string")
    model = detection.fit(words)
    asked = [(1, "berapa tebal pelat yang"), (2, "what is the thickness"), (3, "gading lambung"), (4, "bottom frames"), (5, ""), (6, None), (7, "123 456")]
    got = {r.q: (r.language, r.confidence) for r in detection.language(spark.createDataFrame(asked, "q int, text string"), model, ["q"]).collect()}
    assert got[1] == ("id", 1.0) and got[2] == ("en", 1.0)
    assert got[3][0] == "id" and got[3][1] >= 0.7 and got[4][0] == "en" and got[4][1] >= 0.7
    assert got[5] == got[6] == ("other", 0.0) and got[7][1] == 0.0
    assert detection.detect(spark.createDataFrame([], "q int, text string"), model, ["q"]).collect() == []


def test_interval_join_is_the_exact_test(spark):
    rng = random.Random(2)
    number = lambda: rng.choice([rng.uniform(-50, 50), float(rng.randrange(-50, 50)), 1e-10, 0.0])
    cells = []
    for i in range(400):
        a, b = sorted((number(), number()))
        cells.append((i, rng.choice(["hot", "hot", "a", None]), rng.choice([f"<= {a}", f"> {a}", f"{a} < x <= {b}", f"{a}", f"{b} or less", "words", f"{b} < x < {a}", f">= {a}"])))
    values = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, number(), number(), number()])) for i in range(300)]
    cell = spark.createDataFrame(cells, "cell int, key string, text string").withColumn("p", O.row_predicate(F.col("text")))
    value = spark.createDataFrame(values, "id int, key string, value double")
    want = sorted(tuple(r) for r in value.join(cell, "key").where(O.contains(F.col("p"), F.col("value"))).select("id", "cell").collect())
    joined = intervals.interval_join(value, cell, ["key"])
    assert sorted(tuple(r) for r in joined.select("id", "cell").collect()) == want and len(want) > 3000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "__bin" in plan
    assert intervals.interval_join(value.limit(0), cell, ["key"]).collect() == []


def test_interval_join_broadcasts_no_bins(spark):
    """The files' size says nothing of the rows after the bins: 16 a value, up to 32 an interval."""
    value = spark.range(50).selectExpr("id", "id % 2 AS key", "double(id) AS value")
    cell = spark.range(20).selectExpr("id AS cell", "id % 2 AS key", "'< ' || id AS text").select("cell", "key", O.row_predicate(F.col("text")).alias("p"))
    joined = intervals.interval_join(value, cell, ["key"])
    assert len(joined.collect()) == sum(v % 2 == c % 2 and v < c for v in range(50) for c in range(20))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_covers_are_small_and_whole(spark):
    rng = random.Random(5)
    last = (1 << (intervals.LEVELS - 1)) - 1
    ends = [(0, last), (0, 0), (last, last), (5, 4)] + [tuple(sorted((rng.randrange(last + 1), rng.randrange(last + 1)))) for _ in range(200)]
    df = spark.createDataFrame(ends, "lo long, hi long").withColumn("c", F.expr(intervals._cover("lo", "hi")))
    for r in df.collect():
        assert len(r.c) <= 2 * intervals.LEVELS
        held = sorted((b.bin << b.size, ((b.bin + 1) << b.size) - 1) for b in r.c)
        at = r.lo
        for a, b in held:
            assert a == at
            at = b + 1
        assert at == max(r.hi + 1, r.lo)


def test_trigrams_are_counted_where_the_texts_are(spark, monkeypatch):
    """Against a plain count: short, empty, null and repeated texts, letters of many scripts, parts that are cut; no row a trigram is made."""
    import re
    from collections import Counter

    rows = [(1, "Ab abc"), (1, "abc"), (2, None), (2, ""), (3, "é1ß\U0001F600x\U00010400 Ωmega"), (4, "日本語日本語"), (None, "ab cd"), (5, "x" * 50), (6, "a")]
    want = Counter()
    for k, t in rows:
        x = re.sub(r"([\U00010000-\U0010FFFF]|[\W\d_])+", " ", (t or "").lower())
        want.update((k, x[i : i + 3]) for i in range(len(x) - 2))
    df = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    for letters, counters in ((1_000_000, 1 << 23), (10, 1 << 23), (10, 0)):
        monkeypatch.setattr(detection, "LETTERS", letters)
        monkeypatch.setattr(detection, "COUNTERS", counters)
        assert {(r.k, r.gram): r.n for r in detection.trigram_counts(df, ["k"]).collect()} == want
        pooled = detection.trigram_counts(df.where("k is not null"), ["k"], pooled=True)
        assert {(r.k, r.gram): r.n for r in pooled.collect()} == {k: n for k, n in want.items() if k[0] is not None}
    assert "Generate" not in pooled._jdf.queryExecution().optimizedPlan().toString()
