"""The stream of conversations against the batch functions, also after a restart."""

import random

from pyspark.sql import functions as F

from lodestone.operators import analysis
from lodestone.streaming import conversations as S
from lodestone.streaming.queries import SCHEMA


def test_stream_equals_batch_after_a_restart(spark, sf, tmp_path):
    said = spark.read.parquet(f"{sf}/conversations.parquet")
    facts = F.concat_ws(" ", F.concat(F.lit("L="), (F.col("conv_id") % 7 + F.col("turn")).cast("string"), F.lit(" m")), "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("T: "), F.col("turn").cast("string"))))
    rows = [tuple(r) for r in said.withColumn("text", facts).select("conv_id", "turn", "role", "text").collect()] + [(None, 1, "user", "x"), (1, None, "user", "x")]
    random.Random(3).shuffle(rows)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    parts = [rows[k::5] for k in range(5)]

    def arrive(some):
        for part in some:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    arrive(parts[:3])
    S.start(spark, source, target, checkpoint, files_per_trigger=1).awaitTermination(120)
    arrive(parts[3:])
    S.start(spark, source, target, checkpoint, files_per_trigger=1).awaitTermination(120)
    got = {r.conv_id: r for r in S.states(spark, target).collect()}
    turns = spark.createDataFrame([r for r in rows if None not in r[:2]], SCHEMA)
    window = {}
    for r in analysis.history_window(turns).collect():
        window.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == {c: sorted(w) for c, w in window.items()}
    want = {}
    for r in analysis.history_facts(turns, turns.select("conv_id").distinct().withColumn("query", F.lit(""))).orderBy("conv_id", "place").collect():
        want.setdefault(r.conv_id, []).append(r.fact)
    assert {c: r.facts for c, r in got.items()} == want and all(len(w) >= 2 for w in want.values())
    assert sum(r.seen for r in got.values()) == len(rows) - 2
