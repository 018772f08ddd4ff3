"""What is shuffled and written on the way to a result."""

import glob
import random
import re

from pyspark.sql import functions as F

from lodestone.functions import stemming
from lodestone.operators import fulltext as T
from lodestone.operators import intervals
from lodestone.operators import tables as O
from lodestone.sources.stored import deal, save_bucketed

from .test_plans import plan


def shuffled(spark, act):
    """Bytes and rows that ``act`` writes for shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return [sum(f(stages.apply(i)) for i in range(stages.size())) for f in (lambda s: s.shuffleWriteBytes(), lambda s: s.shuffleWriteRecords())]

    before = total()
    act()
    return [b - a for a, b in zip(before, total())]


def test_one_word_is_stemmed_as_the_columns_do(spark, sf):
    rng = random.Random(4)
    ends = [*stemming.SECOND, *stemming.THIRD, *stemming.FOURTH, "sses", "ied", "ies", "us", "s", "eedly", "eed", "ingly", "edly", "ing", "ed", "e", "ll", "y", "logi", "sion", "tion"]
    made = {"".join(rng.choice("aeiouybdlstwxznré") for _ in range(rng.randrange(6))) + "".join(rng.choices(ends, k=rng.randrange(1, 3))) for _ in range(4000)}
    known = [*stemming.OWN, *stemming.STAYING, *stemming.STAYING_LATER, "generate", "communism", "arsenal", "herrings", "y", "yyy", "日本語", "\U00010428\U00010428ing", "123s"]
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    words = texts.union(spark.createDataFrame([(w,) for w in [*made, *known]], "word string")).distinct()
    rows = stemming.with_stem(words).collect()
    assert len(rows) > 5000 and {r.word: r.stem for r in rows} == {r.word: stemming.stem_of(r.word) for r in rows}


def test_texts_and_words_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Running runs {i} " + "of the relations " * (i % 4)) for i in range(40)] + [(None, "runs"), (50, None), (51, ""), (52, "the")], "doc_id long, text string")
    once = sorted(map(tuple, T.postings(docs).select("id", "stem", "positions").collect()), key=str)
    assert "Exchange" not in plan(T.postings(docs))
    assert (None, "run", [1]) in once and (3, "run", [1, 2]) in once and (3, "relat", [6, 9, 12]) in once and {r[0] for r in once} == {None, *range(40)}
    # many runs of texts, one of them longer than a run may be
    monkeypatch.setattr(T, "WORDS", 5)
    monkeypatch.setattr(T, "REMEMBERED", 2)
    assert sorted(map(tuple, T.postings(docs).select("id", "stem", "positions").collect()), key=str) == once
    twice = docs.union(docs.where("doc_id = 3 or doc_id is null"))
    merged = {(r.id, r.stem): r.positions for r in T.postings(twice).collect()}
    assert merged[None, "run"] == [1, 1] and merged[3, "run"] == [1, 1, 2, 2] and merged[2, "run"] == [1, 2] and len(merged) == len(once)


def test_packed_rows_come_to_their_buckets(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("concat('k', id % 50) AS stem", "int(id % 3) AS part", "if(id % 7 = 0, null, id) AS id", "if(id % 11 = 0, null, array(int(id), 1)) AS positions").union(
        spark.createDataFrame([(None, 1, 5, [])], T.INDEX)
    )
    want = sorted(map(tuple, rows.collect()), key=str)
    for size in (48_000_000, 0):
        monkeypatch.setattr("lodestone.sources.stored.PACK_BYTES", size)
        dealt = deal(rows, ["stem", "part"], 5)
        assert sorted(map(tuple, dealt.collect()), key=str) == want and dealt.schema == rows.schema
        assert dealt.where(F.spark_partition_id() != F.pmod(F.hash("stem", "part"), F.lit(5))).isEmpty()
    assert deal(rows.limit(0), ["stem", "part"], 5).collect() == []
    table = save_bucketed(rows, str(tmp_path / "t"), ["stem", "part"], 5)
    assert sorted(map(tuple, table.collect()), key=str) == want and len(glob.glob(str(tmp_path / "t" / "*.parquet"))) == 5
    assert "Exchange" not in re.sub("BroadcastExchange", "", plan(table.groupBy("stem", "part").count()))


def test_the_stored_index_is_shuffled_packed(spark, sf, tmp_path):
    """Bytes shuffled for the index, against its rows one by one (before: these, and the texts)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = T.postings(docs).cache()
    rows.count()
    plain = shuffled(spark, lambda: rows.repartition(4, "stem", "part").write.format("noop").mode("overwrite").save())[0]
    packed = shuffled(spark, lambda: T.store_index(docs, str(tmp_path / "i"), buckets=4))[0]
    rows.unpersist()
    assert 0 < packed < plain / 1.7


def test_equal_values_and_intervals_are_joined_as_packs(spark, monkeypatch):
    value = spark.range(3000).selectExpr("if(id % 9 = 0, null, id) AS id", "if(id % 500 = 7, null, id % 2) AS key", "if(id % 13 = 0, null, double(id % 11)) AS value", "'x' || id AS name")
    text = "CASE id % 5 WHEN 0 THEN '< ' || id % 7 WHEN 1 THEN id % 7 || ' < x <= 9' WHEN 2 THEN '= ' || id % 7 WHEN 3 THEN '>= ' || id % 7 ELSE 'words' END"
    cell = spark.range(400).selectExpr("if(id % 8 = 0, null, id) AS cell", "if(id % 100 = 3, null, id % 2) AS key", f"{text} AS text").withColumn("p", O.row_predicate(F.col("text")))
    exact = lambda v, c: v.join(c, "key").where(O.contains(F.col("p"), F.col("value")))
    ordered = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    few, some = value.where("length(name) < 4"), cell.where("cell < 90 or cell is null")
    want = ordered(exact(few, some))
    assert len(want) > 500 and exact(few, some).columns == intervals.interval_join(few, some, ["key"]).columns
    for pack, grouped in ((1024, 1 << 20), (3, 1 << 20), (2, 10)):
        monkeypatch.setattr(intervals, "PACK", pack)
        monkeypatch.setattr(intervals, "GROUPED", grouped)
        assert ordered(intervals.interval_join(few, some, ["key"])) == want
    assert intervals.interval_join(few.select("key", "value"), some.select("key", "p"), ["key"]).count() == len(want)
    monkeypatch.undo()
    v, c = value.select("id", "key", "value").localCheckpoint(), cell.select("cell", "key", "p").localCheckpoint()
    n = exact(v, c).count()
    joined = []
    _, rows = shuffled(spark, lambda: joined.append(intervals.interval_join(v, c, ["key"]).count()))
    # before, 16 rows a value
    assert joined == [n] and n > 100_000 and rows < 3000
