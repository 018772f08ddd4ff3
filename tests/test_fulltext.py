"""Stemmer, positional index and search."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.stemming import with_stem
from lodestone.operators import fulltext as T

from .test_plans import plan

#: Examples that were published with the algorithm, and some of each step.
STEMS = {
    "consign": "consign", "consigned": "consign", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "consoles": "consol", "consolingly": "consol",
    "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir", "constables": "constabl", "constancy": "constanc", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish",
    "kneaded": "knead", "kneeling": "kneel", "knightly": "knight", "knitted": "knit", "knives": "knive", "knocker": "knocker", "knockers": "knocker", "knopp": "knopp", "skies": "sky", "dying": "die", "ties": "tie",
    "generally": "general", "communication": "communic", "relational": "relat", "hopping": "hop", "hoping": "hope", "cried": "cri", "gas": "gas", "gaps": "gap", "say": "say", "by": "by", "enjoying": "enjoy",
    "youth": "youth", "exceeding": "exceed", "falling": "fall", "bed": "bed", "rationalization": "ration", "news": "news", "a": "a", "yes": "yes", "ñandúes": "ñandú",
}


def test_stems(spark):
    rows = with_stem(spark.createDataFrame([(w,) for w in [*STEMS, None]], "word string")).collect()
    assert {r.word: r.stem for r in rows} == STEMS | {None: None}


DOCS = [
    (1, "The relational databases of Berlin; databases relate, and relating is what databases do."),
    (2, "Sad cats sat. A fat rat and a sad cat met the fat rats."),
    (3, "cat " + "filler " * 150 + "rat"),
    (4, None),
    (5, ""),
    (6, "rat of the cat"),
    (7, "fat cats are not sad, fat rats are"),
    (None, "a nameless cat and rat"),
    (8, "rat cat rat cat"),
    (8, "rat cat rat cat"),
]
ASKED = {
    1: "cat rat", 2: '"sad cat" or "fat rat"', 3: "cats -fat", 4: '"rat of the cat"', 5: '"rat cat"', 6: "relations database", 7: "the of", 8: "-cat", 9: '"fat rat" -"sad cat"', 10: None, 11: "zebra or relate", 12: "zebra relate", 13: "cat or rat -fat",
}


def brute(stem, docs, text):
    """(id, score) of the documents that match, by the rules of the docstring."""
    alternatives = T.parse_search(text)
    asked = {stem[w] for a in alternatives for _, words in a for w, _ in words}
    out = []
    for doc_id, content in docs:
        at = {}
        for i, w in enumerate(re.findall(r"[^\W_]+", (content or "").lower())):
            if w not in T.STOP_WORDS:
                at.setdefault(stem[w], []).append(i + 1)
        stands = lambda words: any(all(p + o in at.get(stem[w], []) for w, o in words) for p in at.get(stem[words[0][0]], []))
        if not any(all(stands(words) != banned for banned, words in a) for a in alternatives):
            continue
        held = {s: at[s] for s in asked if s in at}
        if len(alternatives) == 1 and len(asked) > 1:
            left = 1.0
            for a in held:
                for b in held:
                    if a < b:
                        for p in held[a]:
                            for q in held[b]:
                                if abs(p - q) <= T.REACH:
                                    left *= 1 - T.WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
            score = 1 - left
        else:
            score = T.WEIGHT * sum(1 / j**2 for p in held.values() for j in range(1, len(p) + 1)) / T.SUM_OF_SQUARES / len(asked)
        out.append((doc_id, round(score, 6)))
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fulltext") / "index")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("stem", F.lit("clash"))
    return T.store_index(docs, path, buckets=3), path


def found(index, spark, asked, k=50):
    return T.search(index, spark.createDataFrame(list(asked.items()), "query_id int, query string"), k)


def test_search_by_positions(spark, index):
    words = {w for _, t in DOCS for w in re.findall(r"[^\W_]+", (t or "").lower())} | {w for t in ASKED.values() for w in re.findall(r"[a-z]+", t or "")}
    stem = {r.word: r.stem for r in with_stem(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    # documents of one id are one entry of the index
    once = [d for d in DOCS if d[0] not in (8,)]
    got = {}
    for r in found(index[0], spark, ASKED).collect():
        if r.id != 8:
            got.setdefault(r.query_id, []).append((r.id, r.score))
    for q, text in ASKED.items():
        assert sorted(got.get(q, []), key=str) == sorted(brute(stem, once, text), key=str), text
    # in 8, other words stand at that distance
    assert sorted(r.id for r in found(index[0], spark, {1: ASKED[4]}).collect()) == [6, 8]
    # two stop words stand between: the words alone don't make the phrase
    assert 6 not in [r.id for r in found(index[0], spark, {1: ASKED[5]}).collect()]


def test_reopened_index(spark, index):
    again = T.open_index(spark, index[1], buckets=3)
    assert sorted(map(tuple, found(again, spark, ASKED, 3).collect()), key=str) == sorted(map(tuple, found(index[0], spark, ASKED, 3).collect()), key=str)


def test_the_index_is_not_shuffled(spark, index, monkeypatch):
    """Even if searches are not broadcast, only they are dealt to the index's buckets; texts are not read."""
    monkeypatch.setattr(T, "BROADCAST_ROWS", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        text = plan(found(index[0], spark, ASKED))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    scan = re.search(r"\((\d+)\) Scan parquet.*?\n.*?Bucketed: true", text, re.S)
    assert scan and "ReadSchema: struct<stem:string,part:int,id:bigint,positions:array<int>>" in text
    # from the scan up to its join there is no exchange
    tree = text.split("\n\n")[0]
    lines = tree.split("\n")
    at = next(i for i, x in enumerate(lines) if "Scan parquet spark_catalog.default.stored" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < level:
            level = depth(x)
            above.append(x)
            if "Join" in x:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)


def test_a_frequent_stem_is_dealt_to_parts(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"))
    assert {r.part for r in T.postings(docs).where("stem = 'word'").collect()} == set(range(T.PARTS))


def test_postings_shuffle_texts_and_not_words(spark):
    """The stemmer is no part of the rows' plan, and words are grouped where their texts are."""
    docs = spark.createDataFrame([(1, "Running runs ran"), (1, "the runs"), (None, "runner")], "doc_id long, text string")
    index = __import__("lodestone.operators.fulltext", fromlist=["postings"]).postings(docs)
    assert sorted((r.id or 0, r.stem, r.positions) for r in index.collect()) == [(0, "runner", [1]), (1, "ran", [3]), (1, "run", [1, 2, 2])]
    plan = index._jdf.queryExecution().sparkPlan().toString()
    assert "Porter" not in plan and "regexp_extract(" not in plan
