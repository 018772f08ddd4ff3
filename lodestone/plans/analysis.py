"""Queries of query analysis over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as A
from ..operators import detection as D
from ..sources.stored import shared_folder
from ..streaming import conversations as memory
from .base import ORACLES, query, table

GLOSSARY = [("la les", "the the"), ("ing", "hull"), ("pelat alas", "bottom plate"), ("ther", "plate"), ("le", "girder"), ("que", "tank")]
#: A question made of a turn, so that all branches of the ladders are met.
_TURN = "CASE turn % 7 WHEN 0 THEN 'Calculate L=120 ' || text WHEN 1 THEN 'what is the minimum for L = 90 ' || text WHEN 2 THEN 'hitung ' || text WHEN 3 THEN text WHEN 4 THEN 'berapa ' || text WHEN 5 THEN 'table 6.1 ' || text ELSE 'net thickness spacing=600 mm maximum apa ' || text END"


def turns(spark, sf_dir):
    """conversations with q, the turn as a question."""
    return table(spark, sf_dir, "conversations").withColumn("q", F.expr(_TURN))


def _bool(words, start=r"\b", end=r"\b"):
    return f"regexp_matches(q, '{start}(?:{'|'.join(words)}){end}')"


def _has(parts):
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in parts) + ")"


_INTENT = rf"""SELECT conv_id, turn, kind, confidence FROM (SELECT *, unnest(CASE
    WHEN num AND (imper OR topical) AND NOT lim THEN {{'kind': 'calculation', 'confidence': 'high'}}
    WHEN lim THEN {{'kind': 'rules_qa', 'confidence': 'high'}}
    WHEN imper AND NOT num AND NOT asks THEN {{'kind': 'calculation', 'confidence': 'low'}}
    WHEN asks AND NOT num AND NOT imper THEN {{'kind': 'rules_qa', 'confidence': 'high'}}
    WHEN cue OR (val AND NOT imper AND NOT topical) THEN {{'kind': 'rules_qa', 'confidence': 'high'}}
    ELSE {{'kind': 'rules_qa', 'confidence': 'low'}} END)
  FROM (SELECT *, asks AND num AND NOT (num AND (desi OR regexp_matches(q, '(?:spacing|nilai\s+b)\s*[=:]\s*[0-9]+\s*mm'))) AND {_bool(A.LIMITS, end="")} AS lim
  FROM (SELECT *, regexp_matches(q, '{A.ASSIGNMENT}') AS num, {_bool(A.IMPERATIVES_EN)} OR {_bool(A.IMPERATIVES_ID, end="")} AS imper, {_bool(A.QUESTIONS, end="")} AS asks,
    {_has(A.TOPICAL)} AS topical, {_has(A.DESIGN)} AS desi, regexp_matches(q, '\b(?:table|tabel|chart|t[0-9]+\.[0-9]+)\b') AS cue,
    regexp_matches(q, '\b(?:for|untuk|of|dari|pada|dengan)\b.*\b[0-9]+(?:[.,][0-9]+)?\b') AS val
  FROM (SELECT conv_id, turn, trim(lower(coalesce({_TURN}, ''))) AS q FROM conversations))))"""


@query("intent_classify", _INTENT)
def intent_classify(spark, sf_dir):
    # the SQL engine's \b knows ASCII words only, as Java's does without (?U)
    return turns(spark, sf_dir).select("conv_id", "turn", A.intent(F.col("q")).alias("i")).select("conv_id", "turn", "i.kind", "i.confidence")


def _markers(words):
    return f"len(list_filter(list_distinct(regexp_split_to_array(lower(p), '[^\\p{{L}}\\p{{N}}_]+')), lambda w: list_contains({words!r}, w)))"


@query(
    "language_markers",
    rf"""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'other' WHEN i > e THEN 'id' WHEN e > i THEN 'en' WHEN i > 0 THEN 'id' ELSE 'en' END AS language,
          CASE WHEN trim(coalesce(text, '')) <> '' AND i <> e THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence
        FROM (SELECT doc_id, text, {_markers(A.ID_MARKERS)} AS i, {_markers(A.EN_MARKERS)} AS e
          FROM (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '"[^"]*"|''[^'']*''|\([^)]*\)|\[[^\]]*\]', ' ', 'g') AS p FROM documents))""",
)
def language_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", A.language(F.col("text")).alias("l")).select("doc_id", "l.language", "l.confidence")


_SUBJECTS = ["mentoi", "thble", *A.OUT_OF_SCOPE]


@query("ood_gate", f"SELECT conv_id, turn, list_filter({_SUBJECTS!r}, lambda s: contains(lower(coalesce(text, '')), s))[1] AS subject FROM conversations")
def ood_gate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.out_of_scope(F.col("text"), _SUBJECTS).alias("subject"))


def _glossary(column: str, pairs=GLOSSARY) -> str:
    for p, t in pairs:  # the SQL engine's \b knows ASCII only: spell the word edges out, twice for neighbours
        once = lambda c: f"regexp_replace({c}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1{t}\\2', 'g')"  # noqa: E731, B023
        column = once(once(column))
    return column


@query("glossary_apply", f"SELECT conv_id, turn, {_glossary('text')} AS text FROM conversations")
def glossary_apply(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.apply_glossary(F.col("text"), GLOSSARY).alias("text"))


_COMMON = "the of and to in is it for le la les et de un une die der und das ist el los que con por para".split()
#: Longer than ``SHORT_GLOSSARY``: pairs of neighbours, then single words.
LONG_GLOSSARY = [(f"{a} {b}", f"{a}_{b}") for a, b in zip(_COMMON, _COMMON[1:])] + [(w, f"{w.upper()}_1") for w in _COMMON]


@query("glossary_long", f"SELECT conv_id, turn, {_glossary('text', LONG_GLOSSARY)} AS text FROM conversations")
def glossary_long(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.apply_glossary(F.col("text"), LONG_GLOSSARY).alias("text"))


@query("history_window", "SELECT conv_id, turn, role, back FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INTEGER AS back FROM conversations) WHERE back <= 6")
def history_window(spark, sf_dir):
    return A.history_window(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "back")


@query("stream_history_window", ORACLES["history_window"])
def stream_history_window(spark, sf_dir):
    """The same from a stream of the table's files, by keyed state."""
    folder = shared_folder(spark, "stream")
    memory.start(spark, f"{sf_dir}/conversations.parque[t]", f"{folder}/out", f"{folder}/state", files_per_trigger=4).awaitTermination()
    turns = memory.states(spark, f"{folder}/out").select("conv_id", F.posexplode(F.reverse("turns")).alias("at", "t"))
    return turns.select("conv_id", "t.turn", "t.role", (F.col("at") + 1).alias("back"))


_TRIGRAMS = "list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substr({c}, i, 3))"
_LETTERS = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')"


@query(
    "language_trigrams",
    f"""WITH t AS (SELECT doc_id, lang, {_LETTERS} AS x FROM documents),
        g AS (SELECT doc_id, lang, unnest({_TRIGRAMS.format(c="x")}) AS gram FROM t WHERE length(x) >= 3),
        c AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
        k AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM c) WHERE place <= {D.GRAMS}),
        z AS (SELECT lang, sum(n) AS total FROM c JOIN k USING (gram) GROUP BY lang),
        q AS (SELECT doc_id, gram, count(*) AS n FROM g JOIN k USING (gram) WHERE doc_id % 5 = 0 GROUP BY ALL),
        s AS (SELECT doc_id, z.lang, sum(q.n * ln((coalesce(c.n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * {D.GRAMS}))) AS score FROM q JOIN z ON true LEFT JOIN c ON c.lang = z.lang AND c.gram = q.gram GROUP BY ALL)
        SELECT doc_id, arg_max(lang, score) AS language FROM s GROUP BY doc_id""",
)
def language_trigrams(spark, sf_dir):
    """A model of four fifths of the documents, the languages of the rest."""
    docs = table(spark, sf_dir, "documents")
    return D.detect(docs.where("doc_id % 5 = 0").select("doc_id", "text"), D.fit(docs.where("doc_id % 5 <> 0")), ["doc_id"]).select("doc_id", "language")


_FACTS = "'L=' || (100 + conv_id % 50) || ' m and b: ' || turn || ',5mm T=' || (turn % 3) || ' ' || role"
_ALL = r"regexp_extract_all(x, '(?:^|[^A-Za-z0-9_])([LHBbTtatKknfQ][A-Za-z0-9_]{0,4})\s*[=:]\s*([0-9]+[.,]?[0-9]*)\s*(m|mm|kN|MPa|N/mm2|%|t)?', GROUP)"


def _facts(source: str, priority: int, turn: str) -> str:
    g = [_ALL.replace("GROUP", str(k)) for k in (1, 2, 3)]
    return f"SELECT conv_id, {priority} AS priority, {turn} AS turn, unnest(range(len({g[0]}))) AS i, unnest({g[0]}) AS key, unnest({g[1]}) AS v, unnest(list_transform({g[2]}, lambda z: coalesce(z, ''))) AS u FROM ({source})"


@query(
    "history_facts",
    f"""WITH t AS (SELECT conv_id, turn, role, {_FACTS} AS x FROM conversations),
        l AS (SELECT conv_id, arg_max(x, turn) AS x FROM t WHERE role = 'user' GROUP BY conv_id),
        f AS ({_facts("SELECT DISTINCT conv_id, 'now Q=' || conv_id || 'kN and T = 9' AS x FROM t", 0, "0")} UNION ALL {_facts("FROM l", 1, "0")} UNION ALL {_facts("FROM t", 2, "turn")}),
        m AS (SELECT conv_id, key, min({{'p': priority, 't': turn, 'i': i, 'f': key || '=' || v || u}}) AS m FROM f GROUP BY conv_id, key)
        SELECT conv_id, key, m.f AS fact, (row_number() OVER (PARTITION BY conv_id ORDER BY m.p, m.t, m.i))::INTEGER AS place FROM m""",
)
def history_facts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("text", F.expr(_FACTS))
    asked = t.select("conv_id").distinct().withColumn("query", F.concat(F.lit("now Q="), F.col("conv_id").cast("string"), F.lit("kN and T = 9")))
    return A.history_facts(t, asked)


_FOLLOW = "CASE turn % 5 WHEN 0 THEN 'What about ' || text WHEN 1 THEN 'L = 150 m' WHEN 2 THEN ' ' WHEN 3 THEN 'dan ' || text ELSE text END"


@query(
    "needs_history",
    rf"SELECT conv_id, turn, turn > 0 AND (q = '' OR regexp_matches(q, '{A.FOLLOW_UP}') OR regexp_matches(q, '{A.BARE_VALUE}')) AS needed FROM (SELECT conv_id, turn, trim(coalesce({_FOLLOW}, '')) AS q FROM conversations)",
)
def needs_history(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("q", F.expr(_FOLLOW))
    return t.select("conv_id", "turn", A.needs_history(F.col("q"), F.col("turn") > 0).alias("needed"))


@query("first_line", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(text) WHEN 1 THEN 'keel plate' WHEN 2 THEN '' ELSE 'the query: stays' END AS line FROM conversations WHERE NOT contains(text, chr(10)) AND NOT regexp_matches(text, '[\"'']')")
def first_line(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(~F.col("text").contains("\n") & ~F.col("text").rlike("[\"']"))
    given = F.expr("CASE turn % 4 WHEN 0 THEN '\"English query: ' || text || '\"' WHEN 1 THEN '\\n Rewritten query:\\n\\n keel plate \\nmore' WHEN 2 THEN ' \\n' ELSE 'the query: stays\\nx' END")
    return rows.select("conv_id", "turn", T.first_line(given).alias("line"))


@query("ship_type", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'tanker' WHEN p_size % 3 = 1 THEN 'bulk carrier' WHEN p_size % 2 = 0 THEN 'dredger' END AS ship FROM part")
def ship_type(spark, sf_dir):
    """From the question, through the glossary, else from the latest turn, else from all of them."""
    rows = table(spark, sf_dir, "part")
    size, blank = F.col("p_size"), F.lit("deck of a ship")
    query, latest = F.when(size % 3 == 0, "a Tanker's deck").otherwise(blank), F.when(size % 3 < 2, "kapal curah").otherwise(blank)
    everything = F.when(size % 2 == 0, "was a dredger").otherwise(blank)
    return rows.select(F.col("p_partkey").alias("id"), A.ship_type_of(query, latest, everything, [("kapal curah", "bulk carrier")]).alias("ship"))


_PAIRS = "SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' L=' || turn ELSE '' END AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) || CASE WHEN turn % 2 = 0 THEN ' l=' || turn ELSE '' END AS b FROM conversations"


def _tokens(column: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(coalesce({column}, '')), '[^\p{{L}}\p{{M}}\p{{N}}_.=/%+-]', ' ', 'g'), '[a-z0-9][a-z0-9._/%+-]*'), lambda t: NOT list_contains({A.FIDELITY_STOP!r}, t) AND (length(t) >= 4 OR regexp_matches(t, '[0-9]'))))"


@query(
    "fidelity",
    rf"""SELECT conv_id, turn, reason, reason IN ('no_fidelity_tokens', 'generic_query', 'ok') AS ok FROM (SELECT *, CASE WHEN len(y) = 0 THEN 'empty_condensed_query' WHEN len(x) = 0 THEN 'no_fidelity_tokens'
          WHEN lower(g) = lower(a) AND NOT regexp_matches(a, '[0-9]') AND NOT list_has_any(x, {A.TECHNICAL!r}) THEN 'generic_query'
          WHEN len(m) > 0 THEN 'missing_parameters:' || array_to_string(list_sort(m), ',')
          WHEN NOT list_has_any(x, y) THEN 'topic_drift:overlap=none' ELSE 'ok' END AS reason
        FROM (SELECT *, list_filter(x, lambda t: NOT list_contains(y, t) AND regexp_matches(t, '[0-9]')) AS m
        FROM (SELECT *, {_tokens("g")} AS x, {_tokens("b")} AS y FROM (SELECT *, {_glossary("a")} AS g FROM ({_PAIRS}) WHERE b IS NOT NULL))))""",
)
def fidelity(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    a = F.concat("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" L="), F.col("turn").cast("string"))).otherwise(""))
    b = F.concat(before, F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" l="), F.col("turn").cast("string"))).otherwise(""))
    rows = t.select("conv_id", "turn", a.alias("a"), b.alias("b")).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", A.fidelity(F.col("a"), F.col("b"), GLOSSARY).alias("f")).select("conv_id", "turn", "f.ok", "f.reason")


_PLACES = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Beban di geladak depan' WHEN 1 THEN 'di buritan kapal' WHEN 2 THEN 'bagian haluan' ELSE 'apa saja' END AS o, CASE conv_id % 6 WHEN 0 THEN 'load in front of the deck' WHEN 1 THEN 'load at the bow and forward' WHEN 2 THEN 'Load On The Dock' WHEN 3 THEN 'stern, aft of the stern' WHEN 4 THEN 'in front of the forward deck' ELSE 'at the dock of the forward deck' END AS e FROM conversations"


def _sub(column, pattern, to):
    return f"regexp_replace({column}, '(?i){pattern}', '{to}', 'g')"


def _swap(column, phrases, to):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN {_sub(column, p, to)}" for p in phrases) + f" ELSE {column} END"


@query(
    "locale_direction_fix",
    rf"""SELECT conv_id, turn, CASE WHEN o IN ('bagian haluan', 'Beban di geladak depan') THEN {_swap("d", A.AFT_PHRASES, "forward")} ELSE d END AS english FROM (
          SELECT *, CASE WHEN o = 'di buritan kapal' THEN {_swap("p", A.FORWARD_PHRASES, "aft")} ELSE p END AS d FROM (
            SELECT *, CASE WHEN o <> 'Beban di geladak depan' THEN e WHEN e = 'load in front of the deck' THEN 'load on the forward deck' WHEN e = 'Load On The Dock' THEN 'Load on the forward deck'
              WHEN e = 'in front of the forward deck' THEN 'on the forward deck' ELSE e END AS p FROM ({_PLACES})))""",
)
def locale_direction_fix(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    rows = spark.sql(_PLACES)
    return rows.select("conv_id", "turn", A.bind(A.fix_place(F.col("o"), F.col("e")), lambda placed: A.fix_direction(F.col("o"), placed)).alias("english"))


@query(
    "cache_key",
    r"SELECT conv_id, turn, sha256('4|' || role || '|default|' || lower(regexp_replace(regexp_replace(text, '^ +| +$', '', 'g'), '\s+', ' ', 'g'))) AS query_hash FROM conversations",
)
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cache_key(F.col("text"), F.col("role"), F.lit("default")).alias("query_hash"))


@query(
    "paraphrase_parse",
    r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(regexp_replace(trim(x), '^[0-9.\-)* \t]+', '')), '^["'']+|["'']+$', '', 'g'))), lambda x: length(x) >= 4) AS ls FROM conversations)
        SELECT conv_id, turn, list_filter(ls, lambda x, i: list_position(list_transform(ls, lambda z: lower(z)), lower(x)) = i)[1:3] AS queries FROM l""",
)
def paraphrase_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.paraphrases(F.col("text"), 3).alias("queries"))


#: Originals and candidates that pin places and directions, state parameters, drift or are blank.
_CONDENSED = """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'geladak depan ' || text WHEN 1 THEN 'di buritan ' || text || ' L=' || turn WHEN 2 THEN 'haluan pelat alas' WHEN 3 THEN text ELSE ' ' END AS a,
    CASE conv_id % 5 WHEN 0 THEN 'in front of the deck, stern ' || text WHEN 1 THEN 'at the bow L=' || turn || ' ' || text WHEN 2 THEN 'aft bottom plate 12mm' WHEN 3 THEN coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') ELSE text END AS b FROM conversations"""


def _mend(source: str, original: str, english: str, out: str) -> str:
    """The place, then the direction, as further columns of the source."""
    front_forward, front, dock = r"\bin\s+front\s+of\s+(?:the\s+)?forward\s+deck\b", r"\bin\s+front\s+of\s+(?:the\s+)?deck\b", r"\b(?:in\s+front\s+of|on|at|in)\s+(?:the\s+)?[dw]ock\b"
    deck, matches = "on the forward deck", lambda c, p: f"regexp_matches({c}, '(?i){p}')"
    place = rf"""CASE WHEN NOT {matches(original, r"\bgeladak\s+depan\b")} THEN {english} WHEN {matches(english, front_forward)} THEN {_sub(english, front_forward, deck)} WHEN {matches(english, front)} THEN {_sub(english, front, deck)}
        WHEN {matches(english, dock)} AND NOT {matches(english, r"\bforward\s+deck\b")} THEN {_sub(english, dock, deck)} ELSE {english} END"""
    aft = rf"""CASE WHEN {matches(original, r"\bburitan\b")} THEN {_swap(f"{out}_p", A.FORWARD_PHRASES, "aft")} ELSE {out}_p END"""
    forward = rf"""CASE WHEN {matches(original, r"\bhaluan\b|geladak\s+depan")} THEN {_swap(f"{out}_a", A.AFT_PHRASES, "forward")} ELSE {out}_a END"""
    return f"SELECT *, {forward} AS {out} FROM (SELECT *, {aft} AS {out}_a FROM (SELECT *, {place} AS {out}_p FROM ({source})))"


_REASON = rf"""CASE WHEN trim(a) = '' OR trim(e) = '' THEN 'validation_skipped' WHEN len(y) = 0 THEN 'empty_condensed_query' WHEN len(x) = 0 THEN 'no_fidelity_tokens'
      WHEN lower(g) = lower(a) AND NOT regexp_matches(a, '[0-9]') AND NOT list_has_any(x, {A.TECHNICAL!r}) THEN 'generic_query'
      WHEN len(m) > 0 THEN 'missing_parameters:' || array_to_string(list_sort(m), ',') WHEN NOT list_has_any(x, y) THEN 'topic_drift:overlap=none' ELSE 'ok' END"""


@query(
    "condense_validated",
    rf"""SELECT conv_id, turn, CASE WHEN kept THEN e ELSE f END AS query, CASE WHEN kept THEN reason ELSE 'fallback:' || reason END AS reason FROM (
          SELECT *, reason IN ('validation_skipped', 'no_fidelity_tokens', 'generic_query', 'ok') AS kept FROM (SELECT *, {_REASON} AS reason FROM (
            SELECT *, list_filter(x, lambda t: NOT list_contains(y, t) AND regexp_matches(t, '[0-9]')) AS m FROM (SELECT *, {_tokens("g")} AS x, {_tokens("e")} AS y FROM ({_mend(f"SELECT *, {_glossary('a')} AS g FROM ({_mend(_CONDENSED, 'a', 'b', 'e')})", "a", "g", "f")})))))""",
)
def condense_validated(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(_CONDENSED).select("conv_id", "turn", A.condensed(F.col("a"), F.col("b"), GLOSSARY).alias("c")).select("conv_id", "turn", "c.query", "c.reason")


@query(
    "english_fallback",
    rf"""SELECT conv_id, turn, 'L=' || turn || CASE WHEN len(w) > 0 THEN ' ' || array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') ELSE '' END AS english FROM (
          SELECT *, list_filter(list_transform(regexp_extract_all(s, '[A-Za-z]{{4,}}'), lambda x: lower(x)), lambda x: NOT list_contains({A.FALLBACK_DROP!r}, x)) AS w FROM (SELECT conv_id, turn, {_glossary("o")} AS s FROM (
            SELECT conv_id, turn, trim(concat_ws(' ', first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), text)) AS o FROM conversations WHERE role = 'user')))""",
)
def english_fallback(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    facts = F.array(F.concat(F.lit("L="), F.col("turn").cast("string")))
    return t.select("conv_id", "turn", F.col("text").alias("query"), first.alias("opening")).select("conv_id", "turn", A.fallback_query(F.col("query"), F.col("opening"), facts, GLOSSARY).alias("english"))


@query("intent_model", f"SELECT conv_id, turn, CASE WHEN confidence = 'low' AND conv_id % 3 > 0 THEN CASE WHEN turn % 2 = 0 THEN 'calculation' ELSE 'rules_qa' END ELSE kind END AS kind, CASE WHEN conv_id % 3 > 0 THEN 'high' ELSE confidence END AS confidence, CASE WHEN confidence = 'low' AND conv_id % 3 > 0 THEN 'llm' ELSE 'heuristic' END AS source FROM ({_INTENT})")
def intent_model(spark, sf_dir):
    """The model stands in as an answer by the turn's number."""
    ask = lambda text: F.when(text.isNotNull(), F.when(F.col("turn") % 2 == 0, " Calculation.").otherwise("rules"))
    mode = F.when(F.col("conv_id") % 3 > 0, "default").otherwise("fast")
    return turns(spark, sf_dir).select("conv_id", "turn", A.intent_with_model(F.col("q"), mode, ask).alias("i")).select("conv_id", "turn", "i.*")


@query(
    "ood_rejection",
    f"SELECT conv_id, turn, CASE WHEN len(list_filter({_SUBJECTS!r}, lambda s: contains(lower(coalesce(text, '')), s))) > 0 THEN CASE WHEN turn % 2 = 0 THEN '{A.REJECTIONS['id'] % 'the rules'}' ELSE '{A.REJECTIONS['en'] % 'the rules'}' END END AS message FROM conversations",
)
def ood_rejection(spark, sf_dir):
    lang = F.when(F.col("turn") % 2 == 0, "id").otherwise("fr")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.rejection(F.col("text"), lang, "the rules", _SUBJECTS).alias("message"))


_QUESTION = "'tebal pelat alas L=' || p_partkey || ' m'"


@query(
    "translate_condense",
    """SELECT p_partkey AS query_id, CASE WHEN k = 1 THEN 'bottom plate thickness, tebal ' || p_partkey || ' m' ELSE CASE WHEN k = 0 THEN '[From conversation history: L=' || p_partkey || 'm, B=20m, H=9m, ship_type=tanker] ' ELSE '' END || 'tebal bottom plate L=' || p_partkey || ' m' END AS english,
         CASE WHEN k = 3 THEN 'unchecked' ELSE 'ok' END AS reason, CASE WHEN k = 1 THEN 'cache' ELSE 'model' END AS origin,
         CASE WHEN k NOT IN (0, 3) THEN sha256('4|id|default|tebal pelat alas l=' || p_partkey || ' m') END AS query_hash, k IN (2, 4) AS store FROM (SELECT *, p_partkey % 5 AS k FROM part)""",
)
def translate_condense(spark, sf_dir):
    """Questions with history, with a good and with a stale cached text, without a mode, and new ones; the model repeats its last message."""
    from ..providers import EchoChat, chat_column

    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 5)
    asked = part.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("conv_id"), F.expr(_QUESTION).alias("query"), F.lit("id").alias("language"), F.when(F.col("k") != 3, "default").alias("mode"), "k")
    said = F.array(*[F.struct(F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for n, r, x in ((1, "user", "tanker, B = 20 m"), (2, "assistant", "H=9 m, B=30 m"))])
    history = asked.where("k = 0").select("conv_id", F.explode(said).alias("s")).select("conv_id", "s.*")
    cached = F.when(F.col("k") == 1, F.concat(F.lit("bottom plate thickness, tebal "), F.col("query_id").cast("string"), F.lit(" m"))).otherwise("hatch cover of another topic")
    cache = asked.where("k IN (1, 2)").select(T.cache_key(F.col("query"), F.lit("id"), F.lit("default")).alias("query_hash"), cached.alias("en_query"))
    return A.translate_condense(asked.drop("k"), history, cache, lambda m: chat_column(m, EchoChat), GLOSSARY)
