"""Places among any number of hits, without a window over all hits of a query."""

import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import scoring, vector_index


def test_places_are_dealt_by_score(spark):
    hits = spark.range(400).selectExpr("if(id % 9 = 0, null, id % 3) AS query_id", "if(id % 7 = 0, null, double(id * 31 % 11)) AS score", "id", "int(id) AS pos", "id = 5 AS selected")
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    want = {r.id: r.n for r in hits.withColumn("n", F.row_number().over(whole)).collect()}
    placed = scoring.resorted(hits)
    assert {r.id: r.pos for r in placed.collect()} == want and dict(placed.dtypes)["pos"] == "int"
    boosted = scoring.unique_table_boost(hits)
    assert {r.id for r in boosted.join(hits.select("id", F.col("score").alias("old")), "id").where("score <> old").collect()} == {5}
    for df in (placed, boosted):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert "windowspecdefinition(query_id" not in plan or plan.count("windowspecdefinition(query_id") == plan.count("sum(n")


def test_a_task_holds_a_bounded_number_of_candidates(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * j) % 13 - 6) for j in range(8)]) for i in range(300)]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>")
    made = vector_index.fit(vecs, 5)
    queries = vecs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = []
    for held in (vector_index.HELD, 0):
        monkeypatch.setattr(vector_index, "HELD", held)
        path = f"{tempfile.mkdtemp()}/v"
        vector_index.store(vecs, made, path)
        found.append(sorted(tuple(r) for r in vector_index.search(path, vecs, queries, 5).collect()))
    assert found[0] == found[1] and len(found[0]) == 75
