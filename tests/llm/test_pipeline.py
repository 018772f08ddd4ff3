"""The pipeline against a brute-force version, and the llm queries against their SQL."""

import hashlib
import os
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm")

import corpus_pipeline  # noqa: E402
from lodestone.llm import mixing, simhash, toxicity  # noqa: E402
from lodestone.llm import queries as Q  # noqa: E402

from .test_llm import VOCABULARY, brute_prints, brute_repeats  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con.execute(Q.ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    assert Counter(tuple(map(str, r)) for r in df.select(*columns).collect()) == Counter(tuple(str(r[names.index(c)]) for c in columns) for r in con.fetchall())


def drop_lines(rows, ratio):
    """A page that has no other line keeps its lines."""
    pages, seen = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        seen.update((r["source"], x) for x in {x for x in r["text"].split("\n") if x.strip(" ")})
    bad = {k for k, n in seen.items() if n >= 2 and n > ratio * pages[k[0]]}
    out = []
    for r in rows:
        kept = [x for x in r["text"].split("\n") if (r["source"], x) not in bad]
        kept = kept if any(x.strip(" ") for x in kept) else r["text"].split("\n")
        out.append(r | {"text": "\n".join(kept)})
    return out


def alike(a, b):
    """Whether two texts have a similarity of 0.8 or more in five-word shingles."""
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    a, b = shingles(a), shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def one_of_each(rows):
    prints = [brute_prints(r["text"], 6, 2) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and any((x ^ y).bit_count() <= 3 for x, y in zip(prints[i], prints[j])) and alike(rows[i]["text"], rows[j]["text"]):
                label = [label[j] if k == label[i] else k for k in label]
    best = {}
    for r, k in zip(rows, label):
        best[k] = min(best.get(k, r["doc_id"]), r["doc_id"])
    return [r for r, k in zip(rows, label) if best[k] == r["doc_id"]]


def sample(rows):
    def kind(t):
        return "web" if "://" in t or "@" in t else "list" if len(t) < 120 * (t.count("\n") + 1) else "prose"

    cell = lambda r: (r["source"], r["lang"], kind(r["text"]))
    mass = defaultdict(float)
    for r in rows:
        mass[cell(r)] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    total = sum(mass.values())
    goals = []
    for d in range(3):
        sums = defaultdict(float)
        for c, n in mass.items():
            sums[c[d]] += n / total
        powers = {k: x**mixing.TEMPER for k, x in sums.items() if x}
        assert len(powers) <= mixing.NAMED
        goals.append({k: x / sum(powers.values()) for k, x in powers.items()})
    weight = dict.fromkeys(mass, 1.0)
    for _ in range(mixing.ROUNDS):
        for d, goal in enumerate(goals):
            sums = defaultdict(float)
            for c, n in mass.items():
                sums[c[d]] += n / total * weight[c]
            weight = {c: w * goal.get(c[d], 0) * mixing.KEEP / sums[c[d]] if sums[c[d]] else 0.0 for c, w in weight.items()}
        weight = {c: min(w, 1.0) for c, w in weight.items()}
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 16**13
    return [r for r in rows if draw(r["doc_id"]) < (weight[cell(r)] if mass[cell(r)] else 1.0)]


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    grammar = toxicity.Grammar(model.lexicon)
    rows = [r.asDict() for r in docs.collect()]
    clean = [r for r in rows if model.scores(np.array([grammar.features(r["text"])]))[0] < 0.5]
    assert 0 < len(clean) <= len(rows)
    final = sample(one_of_each(drop_lines(clean, 0.1)))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append(r)
    assert set(got) == {r["doc_id"] for r in final}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for r in final:
        ids, at = array("I", tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]), 0
        for piece in sorted(got[r["doc_id"]], key=lambda p: p.start):
            assert piece.start == at and piece.doc_tokens == len(ids) and piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)


def test_mixing_draws_other_languages(spark):
    rows = [(i, "word " * 300, [None, "xx", "en", "de"][i % 4], f"src{i % 3}", 1500) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    drawn = Counter(r.lang for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert all(30 < drawn[k] < 70 for k in (None, "xx", "en", "de"))
    other = docs.where("lang is null")
    assert 30 < corpus_pipeline.mix(spark, other, "").count() < 70
    one = docs.where("lang = 'xx' and source = 'src1'").limit(1)
    assert corpus_pipeline.mix(spark, one, "").count() <= 1


ODD = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b c d", None, None, 7), (3, "a b c d", None, None, 7), (None, "x y z", "de", "t", 5), (None, "other words here", "de", "t", 16), (4, "word " * 60_000, "en", "s", 300_000), (5, " \n\n", "en", "s", 3)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows_and_none(spark, sf, rows, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, columns with clashing names."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["a", "b", "fp", "score", "p", "s", "l", "t", "n", "order", "group", "root"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.withColumns({c: F.lit(c) for c in clash}), sf)
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} == {r[0] for r in rows} and sum(r.start == 0 for r in got) == len(rows)
            continue
        assert out.columns == docs.columns
        if name in ("toxicity", "line dedup"):
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        elif name == "mixing":
            assert set(r.doc_id for r in got) <= {r[0] for r in rows}
        else:  # texts without words are one class; a repeated row stays once
            assert Counter(r.doc_id for r in got) == Counter({1: 1, 3: 1, 4: 1, None: 2} if rows else {})


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_texts_below_the_similarity_stay(spark):
    """Near copies of 0.6 to 0.8 stay though their fingerprints are near; those of 0.8 or more go, also through others."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
    rows = [(i, " ".join(base[:j] + ["changed"] * (i > 0) + base[j + (i > 0) :])) for i, j in enumerate(range(0, 290, 17))]
    far = []
    for i in range(12):  # as many changes as leave 0.6 to 0.8
        at = set(rng.choice(300, 8 + i % 4, replace=False).tolist())
        far.append((100 + i, " ".join(f"x{i}" if k in at else w for k, w in enumerate(base))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + far], "doc_id long, text string, lang string, source string, n_chars long")
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.select("doc_id", "text"), shingle=2, prints=6).collect()}
    assert any(near[i] == 0 for i, _ in far)  # the fingerprints alone would take some of them
    classes = {r.doc_id: r.component_id for r in simhash.confirmed_duplicates(docs.select("doc_id", "text"), shingle=2, prints=6).collect()}
    for i, t in far:
        assert alike(t, base_text(rows)) == (classes[i] == 0) or any(alike(t, u) for j, u in rows + far if j != i)
    stay = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert stay == set(classes.values()) and sum(i in stay for i, _ in far) >= 8
    assert len(stay & {i for i, _ in rows}) < len(rows) / 2


def base_text(rows):
    return rows[0][1]


def test_substrings_of_the_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in Q.QUERIES["op9_substring_dedup"](spark, sf).collect()) == brute_repeats(rows, 35)
