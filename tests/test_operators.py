"""Operators on hand-made rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import expressions, mathtext, text
from lodestone.operators import analysis, answers, formulas, ingest, retrieval, scoring, tables
from lodestone.providers import EchoChat, HashEmbedder, OverlapReranker, embed_column
from lodestone.plans.answers import MATH
from lodestone.sources import tables as sources


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("Calculate deck plate a=0.6 pL=10 k=1 tK=1", ("DECK_PLATING_CARGO", "ok", 5.591, "5,591 mm")),
        ("Calculate deck plate a=600 mm pL=10 k=1", ("DECK_PLATING_CARGO", "ok", 3.296, "3,296 mm")),
        ("L=100 k=1", ("DECK_PLATING_MIN", "ok", 7.5, "7,5 mm")),
        ("Q=100 n=4", ("WHEEL_LOAD", "ok", 25.0, "25,0 kN")),
        ("Q=100 n=4 av=0,5", ("WHEEL_LOAD", "ok", 37.5, "37,5 kN")),
        ("Q=100 n=0", ("WHEEL_LOAD", "not_finite", None, None)),
        ("Q=100", ("WHEEL_LOAD", "missing", None, None)),
        ("a=5 m pL=10", ("DECK_PLATING_CARGO", "out_of_range", None, None)),
        ("a=0.6 pL=10 high tensile", ("DECK_PLATING_CARGO", "needs_k", None, None)),
        ("a=0.6 pL=10 in the height", ("DECK_PLATING_CARGO", "no_value", None, None)),
        ("L=120 a=0.6 pB=0", ("BOTTOM_PLATING_L_GREATER_90", "bad_load", None, None)),
        ("L=120 a=0.6 pS=30 transverse mild steel", ("SIDE_PLATING_L_GREATER_90", "ok", None, None)),
    ],
)
def test_calculate(spark, query, expected):
    code, status, result, shown = expected
    if query.endswith("tK=1"):
        result, shown = 3.296, "3,296 mm"
    row = formulas.calculate(spark.createDataFrame([(1, query)], "query_id int, query string"), formulas.BY_CODE[code]).first()
    assert row.status == status
    if result is not None:
        assert round(row.result, 3) == result and row.shown == shown


def test_missing_second_load_leaves_its_branch_out(spark):
    q = spark.createDataFrame([(1, "L=120 a=0.6 pS=30 k=1 tK=1 nf=1")], "query_id int, query string")
    row = formulas.calculate(q, formulas.BY_CODE["SIDE_PLATING_L_GREATER_90"]).first()
    assert row.status == "ok" and any("pS1" in w for w in row.warnings)


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "a if b else c", "[1]", "f(2)", "'x'"])
def test_expression_whitelist(spark, bad):
    with pytest.raises((ValueError, SyntaxError)):
        expressions.compile_expression(bad, lambda s: F.lit(1.0))


def test_expression_names_are_never_constants(spark):
    out = spark.range(1).select(expressions.compile_expression("E * I ** 2 - S / N", lambda s: F.lit({"E": 2.0, "I": 3.0, "S": 4.0, "N": 2.0}[s])).alias("x")).first().x
    assert out == 16.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["≤", "<", ">", "≥", "=", "x <"]), st.integers(0, 99)), min_size=1, max_size=5))
def test_predicates(spark, cells):
    rows = [f"{op} {n}" for op, n in cells]
    found = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "i int, c string").select("i", tables.row_predicate(F.col("c")).alias("p")).orderBy("i").collect()
    for (op, n), r in zip(cells, found):
        want = {"=": (None, False, None, False, n), "≤": (None, False, n, True, None), "<": (None, False, n, False, None), "x <": (None, False, n, False, None), ">": (n, False, None, False, None), "≥": (n, True, None, False, None)}
        assert tuple(r.p) == want[op]


PLATES = "Plate thickness | Leg length\n[mm] | [mm]\n≤ 4 | 2.5\n≤ 8 | 3.5\n> 8 | 5.0"


WIDE = "Frame | Steel grade | Weld\nspacing [mm] | A | B | throat [mm]\n≤ 600 | 5 | 6 | 7\n≤ 800 | 8 | 9 | 10"
SHARES = "Share [%] | Factor beta\n40 or less | 0.2\n75 or more | 0.9"

CASES = [
    (PLATES, "leg length for plate thickness 6 mm", "3.5"), (PLATES, "leg length for plate thickness 4 mm", "2.5"), (PLATES, "leg length for plate thickness 0.6 cm", "3.5"),
    (PLATES, "leg length for plate thickness 0.006 m", "3.5"), (PLATES, "leg length for plate thickness 30 mm", "5.0"), (PLATES, "leg length for plate thickness 6 firkins", None),
    (PLATES, "leg length for plate thickness 6", None), (PLATES, "leg length for plate thickness 30%", None), (PLATES, "speed of a winch 6 mm", None),
    (PLATES, "leg length of nothing", None), ("A | B\n≤ 4 | 1\n≤ 4 | 2", "b for a 3", None), ("one line", "1", None), ("", "1", None), (None, None, None), (None, "1", None), (PLATES, None, None),
    (SHARES, "beta for a share of 80 %", "0.9"), (SHARES, "beta for a share of 30 percent", "0.2"), (SHARES, "beta for a share of 50 %", None),
    ("[Table 3]\nGap [mm] | Spring rate\n10 < x ≤ 20 | 1\n20 < x ≤ 30 | 2", "spring rate for gap 25 mm", "2"), ("Gap [mm] | Spring rate\n10 < x ≤ 20 | 1\n20 < x ≤ 30 | 2", "spring rate for gap 35 mm", None),
    ("Gap [mm] | Spring rate\n≤ 20 | 1\n10 < x ≤ 30 | 2", "spring rate for gap 15 mm", None), ("Gap [mm] | Spring rate\n5 | 1\n6 | 2", "spring rate for gap 6 mm", "2"),
    ("Gap [mm] | Spring rate\n5 | 1\n≤ 6 | 2", "spring rate for gap 5 mm", None), ("Gap [mm] | Load [kN]\n≤ 5 | < 3\n≤ 6 | < 4", "load for gap 4 mm", None),
    ("Gap | Spring rate\n≤ 5 | 1\n≤ 6 | 2", "spring rate for gap 4", "1"), ("Type | Spring rate\nwide | soft\nnarrow | hard", "spring rate for wide 4 mm", None),
    (WIDE, "weld throat for frame spacing 700 mm", None), ("Frame | Weld | Bolt\nspacing [mm] | throat [mm] | size [mm]\n≤ 600 | 5 | 6\n≤ 800 | 8 | 9", "bolt size for frame spacing 700 mm", "9"),
    ("Frame | Weld | Bolt\nspacing [mm] | size [mm] | size [mm]\n≤ 600 | 5 | 6\n≤ 800 | 8 | 9", "size for frame spacing 700 mm", None),
]


def test_selected_rows(spark):
    pairs = spark.createDataFrame([(i, t, q, "en") for i, (t, q, _) in enumerate(CASES)] + [(100, PLATES, "panjang kaki untuk tebal", "id"), (101, PLATES, "leg length untuk plate thickness kurang dari 6 mm", "id")], "id int, table_text string, query string, language string")
    got = {r.id: r for r in tables.select_rows(pairs.withColumns({"cells": F.lit(1), "at": F.lit(2), "split": F.lit(3)})).collect()}
    assert len(got) == len(CASES) + 2
    for i, (table, query, want) in enumerate(CASES):
        assert (got[i].value_text if got[i].selected else None) == want, (table, query, got[i])
    assert got[0].reason == "matched: ≤ 8 [(-inf, 8.0]] contains = 6.0 -> col 1" and got[5].reason == "fallback" and got[5].row_text == ""
    assert not got[100].selected and got[101].row_text == "≤ 8" and got[101].reason.endswith("contains < 6.0 -> col 1")
    assert tables.select_rows(pairs.limit(0)).count() == 0


def test_headers_in_several_rows(spark):
    """Leaf, parents, words and unit of each column."""
    heads = tables.parse_tables(spark.createDataFrame([(PLATES,), ("Frame | Weld α\nspacing [mm] | throat\n[cm] | [-]\n≤ 600 | 5",)], "table_text string")).select("table_text", "split", "at", "heads").collect()
    got = {r.table_text[:5]: r for r in heads}
    assert got["Plate"].split == 2 and got["Plate"].at == 0 and [(h.leaf, h.parents, h.unit) for h in got["Plate"].heads] == [("[mm]", ["Plate thickness"], "mm"), ("[mm]", ["Leg length"], "mm")]
    assert got["Frame"].split == 3 and [(h.leaf, h.parents, h.unit, sorted(h.words)) for h in got["Frame"].heads] == [("[cm]", ["Frame", "spacing [mm]"], "cm", ["frame", "spacing"]), ("[-]", ["Weld α", "throat"], None, ["alpha", "throat", "weld"])]


def test_single_bounds(spark):
    cells = ["≤ 4", "> 5", "10 < x <= 20", "7", "≥ 3", "< 2", "word"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", tables.single_bound(tables.row_predicate(F.col("c"))).alias("b")).orderBy("i").collect()
    assert [r.b and tuple(r.b) for r in got] == [("<=", 4.0), (">", 5.0), ("<=", 20.0), ("=", 7.0), (">=", 3.0), ("<", 2.0), None]


@pytest.mark.parametrize(
    "words, kind, sure",
    [
        ("Calculate L=100", "calculation", "high"),
        ("what is the minimum for L=100", "rules_qa", "high"),
        ("hitung tebal pelat", "calculation", "low"),
        ("what is a floor", "rules_qa", "high"),
        ("table 3.1 values", "rules_qa", "high"),
        ("hello", "rules_qa", "low"),
        ("", "rules_qa", "low"),
        (None, "rules_qa", "low"),
    ],
)
def test_intent(spark, words, kind, sure):
    got = column(spark, words, analysis.intent)
    assert (got.kind, got.confidence) == (kind, sure)


@pytest.mark.parametrize("words, expected", [("apa saja yang berlaku", "id"), ("what is the load", "en"), ("", "other"), (None, "other"), ('"the what" berapa', "id"), ("xyz", "en")])
def test_language(spark, words, expected):
    assert column(spark, words, analysis.language).language == expected


def test_glossary_keeps_list_order(spark):
    pairs = [("pelat", "plate"), ("pelat alas", "never"), ("a.b", "dot"), ("x", "$1")]
    assert column(spark, "Pelat alas a.b aXb x pelatnya", lambda c: analysis.apply_glossary(c, pairs)) == "plate alas dot aXb $1 pelatnya"


def test_fallback_and_paraphrases(spark):
    got = column(spark, "1. First one\n- first ONE\n\"second\"\nab\n3) third", lambda c: analysis.paraphrases(c, 2))
    assert got == ["First one", "second"]
    assert column(spark, ' "query: the answer\nmore" ', text.first_line) == "the answer"


def test_search_syntax():
    q = retrieval.parse_query('ship or boat "all rights" -tax the')
    assert q.all == [["ship", "boat"]] and q.none == ["tax"] and q.phrases == [["all", "rights"]]


def hits(spark, scores, sections=None):
    rows = [("q", i + 1, i, (sections or [1] * len(scores))[i], f"Title {i}", "x 5 mm" if i else "y 3 mm", s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id string, pos int, id long, section_no int, section_title string, content string, score double")


@pytest.mark.parametrize("scores, rejected", [([-3.0, -4.0], True), ([-1.9, -1.8], True), ([-1.9, -4.0], False), ([0.1, 0.1], False), ([-1.7], True), ([5.0], False)])
def test_guardrail(spark, scores, rejected):
    assert scoring.guardrail(hits(spark, scores)).first().rejected is rejected


def test_contradictions(spark):
    assert scoring.contradictions(hits(spark, [1.0, 2.0])).count() == 0
    assert scoring.contradictions(hits(spark, [1.0, 2.0], [1, 2])).first().sections == [1, 2]


def test_chunker_splits_at_headings_only(spark):
    long = "\n".join(["word " * 30] * 14)
    page = spark.createDataFrame([(1, 5, "Title", f"A.\n1.1\n{long}\n2.1\nshort where\na = b", None), (2, None, None, "x", None)], "page_no int, section_no int, section_title string, text string, tables array<struct<table_no:string,text:string>>")
    got = ingest.chunk_pages(page).orderBy("chunk_no").collect()
    assert [(c.paragraph_id, c.content_type) for c in got] == [("A.1.1", "narrative"), ("A.2.1", "formula")]
    assert got[0].content.startswith("[Sec 5 Title | A.1.1]\nA.\n1.1")


@pytest.mark.parametrize("given, expected", [(r"\frac{a}{b+c}", "a/(b+c)"), (r"\sqrt{x^{2}}", "sqrt(x^2)"), (r"$a \cdot b$", "a · b"), (r"\frac{\frac{1}{2}}{3}", "(1/2)/3"), ("plain", "plain"), (r"\text{mm}", "mm"), (r"\frac{1", "1/"), (None, None), (r"a \unknown b", "a unknown b"), *MATH])
def test_math(given, expected):
    assert mathtext.format_math(given) == expected and mathtext.format_math(expected) == expected


def test_events():
    class Blank(EchoChat):
        def stream(self, messages):
            yield ""

    kinds = [k for k, _ in answers.answer_events([{"content": "one two"}], EchoChat())]
    assert kinds == ["status", "status", "token", "token", "done"]
    assert list(answers.answer_events([{"content": ""}], Blank()))[-1] == ("done", "No answer could be made.")


def test_stand_ins(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "text string")
    assert all(len(r.embedding) == 64 for r in embed_column(rows, HashEmbedder).collect())
    assert OverlapReranker().score([("a b", "b c")]) == [0.5]


def test_table_edits(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string")
    once = sources.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sources.upsert(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    assert sources.alive(old) and not sources.alive(old.limit(0))
    with pytest.raises(Exception, match="constraint"):
        sources.checked_chunks(spark.createDataFrame([("poem",)], "content_type string")).collect()
    assert sources.entries_from_yaml(spark, '[{"id": "a"}, {"id": "b"}]', "id string", ["b"]).count() == 1


def test_stream(spark, sf, tmp_path):
    from lodestone.streaming import queries

    spark.read.parquet(f"{sf}/conversations.parquet").write.parquet(str(tmp_path / "in"))
    queries.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), [("la", "the")]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_stemmed_search(spark):
    """Index and search share a stemmer; phrases are confirmed on stems; empty searches find nothing."""
    rows = [(1, "Plates and welded plates"), (2, "plate thickness"), (3, "thick plated decks"), (4, None), (5, "thickness of the plate")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stem = lambda w: F.regexp_replace(w, "(s|d)$", "")
    asked = spark.createDataFrame([(1, "plates"), (2, '"plates thickness"'), (3, "plate -deck"), (4, ""), (5, None), (6, "plate plates")], "query_id int, query string")
    found = retrieval.fulltext_search(retrieval.postings(docs, "doc_id", "text", stem=stem), docs, asked, 10, stem=stem)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [1, 2, 3, 5], 2: [2], 3: [1, 2, 5], 6: [1, 2, 3, 5]}


def test_cached_questions_are_not_asked(spark):
    """The model gets null for a question that the cache serves, and for nothing else."""
    asked = spark.createDataFrame([(1, 1, "tebal pelat alas 7 mm", "id", "default"), (2, 2, "", "id", "default"), (3, 3, "pelat alas 8 mm", None, None)], "query_id int, conv_id int, query string, language string, mode string")
    turns = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    key = asked.where("query_id = 1").select(text.cache_key(F.col("query"), F.col("language"), F.col("mode")).alias("query_hash"), F.lit("tebal bottom plate 7 mm").alias("en_query"))
    ask = lambda m: F.when(m.isNotNull(), F.concat(F.lit('"English query: '), F.element_at(m, -1), F.lit(' plating"')))
    got = {r.query_id: r for r in analysis.translate_condense(asked, turns, key, ask, [("pelat alas", "bottom plate")]).collect()}
    assert (got[1].english, got[1].origin, got[1].store) == ("tebal bottom plate 7 mm", "cache", False)
    assert (got[2].reason, got[2].origin) == ("validation_skipped", "model")
    assert (got[3].english, got[3].reason, got[3].query_hash, got[3].store) == ("bottom plate 8 mm plating", "unchecked", None, False)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_different_question_is_settled_once(spark):
    """The parsing of questions stands above a grouping by table and question; repeated, null and empty rows all come back."""
    text = "Gap [mm] | Spring rate\n0 < x ≤ 10 | 1\n10 < x ≤ 20 | 2"
    rows = [(i, text, "spring rate for gap 5 mm", ["en", None][i % 2]) for i in range(6)] + [(6, text, "spring rate for gap 15 mm", "en"), (7, None, None, None), (8, "", "", "id"), (9, text, None, "en")]
    picked = tables.select_rows(spark.createDataFrame(rows, "id long, table_text string, query string, language string"))
    got = {r.id: (r.selected, r.value_text) for r in picked.collect()}
    assert got == {i: (True, "1") for i in range(6)} | {6: (True, "2"), 7: (False, ""), 8: (False, ""), 9: (False, "")}
    grouped = next(x for x in plan_of(picked).split("\n") if "Aggregate [" in x)
    assert "__query" in grouped


def test_patterns_of_a_short_glossary_are_fixed(spark):
    """A pattern that changes from call to call would be compiled anew each time."""
    words = [("a b", "c"), ("c d", "$1\\x"), ("É", "e")]
    df = spark.createDataFrame([("A B d",), ("aa b",), ("é a b",), (None,)], "t string").select(analysis.apply_glossary(F.col("t"), words).alias("t"))
    assert [r.t for r in df.collect()] == ["$1\\x", "aa b", "e c", None]
    assert "aggregate(" not in plan_of(df)


def test_fidelity_cuts_each_text_once(spark):
    """A column used twice inside a lambda is computed twice, so the tokens are bound."""
    df = spark.createDataFrame([("L=5 m hull", "hull L=5 m"), ("hull", None), (None, "hull"), ("tank 7", "tank")], "q string, e string").select(analysis.fidelity(F.col("q"), F.col("e"), [("tank", "cargo tank")]).alias("f"))
    assert [tuple(r.f) for r in df.collect()] == [(True, "ok"), (False, "empty_condensed_query"), (True, "no_fidelity_tokens"), (False, "missing_parameters:7")]
    assert plan_of(df).count("array_distinct(") == 2
