"""One-pass phrase matching against the folds that try every phrase."""

import random

from pyspark.sql import functions as F

from lodestone.operators import analysis, rules

SIGNS = ["deck", "Deck", "main", "plate", "bilge keel", "keel", "a.b", "ß", "É", "é", "x_y", "-", " ", " ", "  ", ",", "\n", "kapal", "$1", "\\"]


def texts(n=400):
    rng = random.Random(4)
    return [None, ""] + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_long_glossary_is_the_fold(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [("main deck", "keel plate"), ("deck", "main"), ("keel plate", "bilge keel"), ("bilge keel", "$1 \\ deck"), ("a.b", "É"), ("é", "kapal main"), ("kapal", "deck"), ("main main", "plate")]
    pairs += [("".join(rng.choice(SIGNS[:9]) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 4))).strip(), rng.choice(SIGNS[:9])) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    found = df.select("t", analysis.apply_glossary(F.col("t"), pairs).alias("x")).collect()
    monkeypatch.setattr(analysis, "SHORT_GLOSSARY", len(pairs))
    want = df.select("t", analysis.apply_glossary(F.col("t"), pairs).alias("x")).collect()
    assert found == want and sum(r.t != r.x for r in want) > 200


def test_all_terms_are_found_in_one_pass(spark, monkeypatch):
    terms = [("a", "Deck"), ("a", "in"), ("b", "main plate"), ("b", "E"), ("c", "EE"), ("c", ""), ("d", "keel"), ("d", "keel"), ("e", "l k")]
    rows = [(i, t, None if i % 3 else "keel in  EE main-plate ee") for i, t in enumerate(texts(60))] + [(None, "deck", "in")]
    asked = spark.createDataFrame(rows, "query_id int, query string, query_en string")
    table = spark.createDataFrame(terms, "topic string, term string").withColumn("gate", F.lit("clash"))
    both = {"x": (table, "combined", ["topic"]), "y": (table, "original", ["topic", "term"])}
    plain = sorted((str(r.query_id), r.gate, r.key) for r in rules.tagged_hits(rules.texts(asked), both).collect())
    needles, want = [tuple(r) for r in table.select("topic", rules.needle(F.col("term")), "term").collect()], []
    for r in rules.texts(asked).collect():
        for gate, text in (("x", r.combined), ("y", r.original)):
            for topic, needle, term in needles:
                if needle is not None and needle in text:
                    want.append((str(r.query_id), gate, f'{{"topic":"{topic}"}}' if gate == "x" else f'{{"topic":"{topic}","term":"{term}"}}'))
    assert plain == sorted(want) and plain
    monkeypatch.setattr(rules, "MACHINE_TERMS", 3)
    assert sorted((str(r.query_id), r.gate, r.key) for r in rules.tagged_hits(rules.texts(asked), both).collect()) == plain
    assert rules.tagged_hits(rules.texts(asked), {"x": (table.limit(0), "combined", ["topic"])}).collect() == []

