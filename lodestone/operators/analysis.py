"""Query analysis as columns: language, intent, scope, glossary, conversation, fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import replace_in_order
from ..functions.text import cache_key, first_line
from .scoring import SHIP_TYPES, first_keyword

# Marker words of the two languages.
ID_MARKERS = (
    "apa saja yang untuk dengan bagaimana kapan mengapa kenapa berapa adalah dan atau dari pada ini itu tidak akan harus tebal pelat gading dek geladak "
    "aturan ketentuan struktur alas ceruk penumpu jarak beban minimum definisi menurut"
).split()
EN_MARKERS = "the what how is are of for with when which thickness plate frame deck rules section minimum load spacing girder".split()

# Lexicons of the intent ladder.
IMPERATIVES_EN = "calculate calculating compute computing determine determining".split()
IMPERATIVES_ID = "hitung kalkulasi kalkulasikan".split()
QUESTIONS = "how what when why which where define defined explain bagaimana apa apakah kapan mengapa kenapa berapa menentukan jelaskan dimana".split()
TOPICAL = [
    "section modulus", "moment of inertia", "frame spacing", "jarak gading", "modulus penampang", "plate thickness of", "threshold", "ambang", "kecepatan",
    "speed threshold", "tebal pelat", "shell plating", "kulit luar", "pelat alas", "pelat dasar", "pelat sisi", "bottom plating", "side plating",
    "ketebalan bersih", "net thickness", "slenderness", "kelangsingan", "stiffener spacing", "jarak antar penegar", "nilai b",
]
DESIGN = ["ketebalan bersih", "net thickness", "slenderness", "stiffener spacing", "jarak antar penegar", "nilai b"]
LIMITS = "maksimum minimum max min diizinkan dizinkan diperbolehkan allowed permitted".split()
ASSIGNMENT = r"[a-z_][a-z0-9_]*\)?\s*[=:]\s*-?[0-9]"

# Subjects that are out of scope.
OUT_OF_SCOPE = [
    "pompa pemadam", "fire pump", "panel distribusi listrik", "ip rating", "kapal sungai", "inland waterway", "penyeberangan", "wpqt", "welding procedure",
    "prosedur pengelasan", "kualifikasi las", "wps", "dynamic positioning", "dps kelas", "sistem permesinan", "redundansi mesin", "propeller", "baling-baling",
    "pedoman kelistrikan", "instalasi sprinkler", "sistem perpipaan",
]


def _either(words, start=r"\b", end=r"\b") -> str:
    return start + "(?:" + "|".join(words) + ")" + end


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any_substring(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: text.contains(p))


def _shared(words: Column, markers: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*[F.lit(m) for m in dict.fromkeys(markers)])))


def neutral(text: Column) -> Column:
    """Text without quoted, parenthesised or bracketed parts."""
    return F.regexp_replace(text, r"\"[^\"]*\"|'[^']*'|\([^)]*\)|\[[^\]]*\]", " ")


def language(text: Column, detector: Column | None = None) -> Column:
    """struct(language, confidence). ``detector``: struct(language, confidence) of a statistical
    detector, asked only where the markers are even; without one the markers decide alone."""
    made = lambda name, sure: F.struct(F.lit(name).alias("language"), F.lit(sure).cast("double").alias("confidence"))

    def decide(n):
        local, english = n["local"], n["english"]
        rest = F.when(local > 0, made("id", 0.0)).otherwise(made("en", 0.0))
        if detector is not None:
            sure = lambda name: F.struct(F.lit(name).alias("language"), detector["confidence"].alias("confidence"))
            trusted = detector["language"].isin("en", "id") & (detector["confidence"] >= 0.7)
            rest = F.when(trusted, detector).when(local > 0, sure("id")).otherwise(sure("en"))
        return F.when(local > english, made("id", 1.0)).when(english > local, made("en", 1.0)).otherwise(rest)

    count = lambda words: F.struct(_shared(words, ID_MARKERS).alias("local"), _shared(words, EN_MARKERS).alias("english"))
    words = F.split(F.lower(neutral(F.coalesce(text, F.lit("")))), r"(?U)[^\w]+")
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, made("other", 0.0)).otherwise(bind(bind(words, count), decide))


def intent(text: Column) -> Column:
    """struct(kind, confidence, source) by the first rule that fits."""
    # The patterns of a spacing, of a table and of a value asked about.
    q = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    num = q.rlike(ASSIGNMENT)
    imperative = q.rlike(_either(IMPERATIVES_EN)) | q.rlike(_either(IMPERATIVES_ID, end=""))
    asks = q.rlike(_either(QUESTIONS, end=""))
    topical = _any_substring(q, TOPICAL)
    design = num & (_any_substring(q, DESIGN) | q.rlike(r"(?:spacing|nilai\s+b)\s*[=:]\s*[0-9]+\s*mm"))
    limit = asks & num & ~design & q.rlike(_either(LIMITS, end=""))
    cue = q.rlike(r"\b(?:table|tabel|chart|t[0-9]+\.[0-9]+)\b")
    value = q.rlike(r"\b(?:for|untuk|of|dari|pada|dengan)\b.*\b[0-9]+(?:[.,][0-9]+)?\b") & ~imperative & ~topical
    made = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), F.lit("heuristic").alias("source"))
    return (
        F.when(num & (imperative | topical) & ~limit, made("calculation", "high"))
        .when(limit, made("rules_qa", "high"))
        .when(imperative & ~num & ~asks, made("calculation", "low"))
        .when(asks & ~num & ~imperative, made("rules_qa", "high"))
        .when(cue | value, made("rules_qa", "high"))
        .otherwise(made("rules_qa", "low"))
    )


def intent_with_model(text: Column, mode: Column, ask) -> Column:
    """``intent``; where it is unsure in the default mode, ``ask`` decides: text column -> answer column, null for rows that it is not asked about."""

    def settle(first):
        unsure = (first["confidence"] == "low") & F.coalesce(mode == "default", F.lit(False))
        answer = ask(F.when(unsure, text))
        kind = F.when(F.lower(F.trim(answer)).contains("calculation"), "calculation").otherwise("rules_qa")
        asked = F.struct(kind.alias("kind"), F.lit("high").alias("confidence"), F.lit("llm").alias("source"))
        return F.when(unsure, asked).otherwise(first)

    return settle(intent(text))


#: What a question outside the scope is answered, by language; every other language gets the English text.
REJECTIONS = {
    "id": "Pertanyaan ini di luar cakupan %s. Silakan merujuk ke dokumen yang sesuai.",
    "en": "This question is outside the scope of %s. Please refer to the document that covers it.",
}


def rejection(text: Column, language: Column, document: str, subjects: list[str] | None = None) -> Column:
    """The localised rejection of a text that names a subject outside the document; null if it is in scope. Runs before any calculation."""
    said = F.when(language == "id", REJECTIONS["id"] % document).otherwise(REJECTIONS["en"] % document)
    return F.when(out_of_scope(text, subjects or OUT_OF_SCOPE).isNotNull(), said)


def out_of_scope(text: Column, subjects: list[str] = OUT_OF_SCOPE) -> Column:
    """The first listed subject that the text names; null if it is in scope."""
    return F.get(F.filter(F.array(*[F.lit(s) for s in subjects]), lambda s: F.lower(F.coalesce(text, F.lit(""))).contains(s)), F.lit(0))


#: Entries of a glossary that are tried one by one; a longer one is looked up by a machine.
SHORT_GLOSSARY = 24


def apply_glossary(text: Column, glossary: list[tuple[str, str]]) -> Column:
    """(phrase, term) replacements as whole words, one after another in the list's order.

    A short list is a chain of fixed patterns, each compiled once a task. A long one is compiled to one machine, so that texts are not read once an entry.
    """
    if not glossary:
        return text
    if len(glossary) > SHORT_GLOSSARY:
        return replace_in_order(text, glossary)
    for phrase, term in glossary:
        text = F.regexp_replace(text, r"(?iU)\b\Q" + phrase + r"\E\b", term.replace("\\", r"\\").replace("$", r"\$"))
    return text


def fix_place(original: Column, english: Column) -> Column:
    """If the original pins the forward deck, wrong places of the English text are mended."""
    # What pins the place, and the wrong places.
    pinned = original.rlike(r"(?i)\bgeladak\s+depan\b")
    front_forward, front, dock, forward = (
        r"(?i)\bin\s+front\s+of\s+(?:the\s+)?forward\s+deck\b",
        r"(?i)\bin\s+front\s+of\s+(?:the\s+)?deck\b",
        r"(?i)\b(?:in\s+front\s+of|on|at|in)\s+(?:the\s+)?[dw]ock\b",
        r"(?i)\bforward\s+deck\b",
    )
    to = F.lit("on the forward deck")
    fixed = (
        F.when(english.rlike(front_forward), F.regexp_replace(english, F.lit(front_forward), to))
        .when(english.rlike(front), F.regexp_replace(english, F.lit(front), to))
        .when(english.rlike(dock) & ~english.rlike(forward), F.regexp_replace(english, F.lit(dock), to))
        .otherwise(english)
    )
    return F.when(pinned, fixed).otherwise(english)


# Phrases of the two directions, the first that occurs is replaced.
FORWARD_PHRASES = [r"\bat\s+the\s+bow\b", r"\bin\s+the\s+bow\b", r"\bforward\b", r"\bbow\b"]
AFT_PHRASES = [r"\bat\s+the\s+stern\b", r"\bin\s+the\s+stern\b", r"\bstern\b", r"\baft\b"]


def fix_direction(original: Column, english: Column) -> Column:
    """If the original pins aft or forward, the opposite phrase of the English text is replaced."""

    def swap(text, phrases, to):
        out = None
        for p in phrases:
            p = "(?i)" + p
            hit, made = text.rlike(p), F.regexp_replace(text, p, to)
            out = F.when(hit, made) if out is None else out.when(hit, made)
        return out.otherwise(text)

    # What pins a direction.
    aft = original.rlike(r"(?i)\bburitan\b|bagian\s+buritan|di\s+buritan")
    forward = original.rlike(r"(?i)\bhaluan\b|bagian\s+haluan|di\s+haluan|geladak\s+depan")
    turned = F.when(aft, swap(english, FORWARD_PHRASES, "aft")).otherwise(english)
    return bind(turned, lambda out: F.when(forward, swap(out, AFT_PHRASES, "forward")).otherwise(out))


#: Fixed value: references to earlier turns.
FOLLOW_UP = (
    r"(?i)\b(?:kalau|jika|bila|yang\s+tadi|sebelumnya|tersebut|yang\s+sama|bagaimana\s+dengan|bagaimana\s+kalau|what\s+about|how\s+about|the\s+previous|the\s+same|above|also\s+for)\b"
    r"|\b(?:ini|itu)\b\s*(?:berlaku|juga|sama)|^(?:dan|lalu|kemudian)\b"
)
#: Fixed value: a bare assignment.
BARE_VALUE = r"(?i)^[A-Za-z][A-Za-z0-9_ ]{0,20}\s*[=:]\s*[-+]?[0-9]+(?:[.,][0-9]+)?\s*(?:m|mm|kN|MPa|%)?$"


def needs_history(text: Column, has_history: Column) -> Column:
    q = F.trim(F.coalesce(text, F.lit("")))
    return has_history & ((q == "") | q.rlike(FOLLOW_UP) | q.rlike(BARE_VALUE))


def history_window(turns: DataFrame, keep: int = 6) -> DataFrame:
    """The last ``keep`` turns of each conversation."""
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(window)).where(F.col("back") <= keep)


#: Fixed value: a symbol, its value and unit.
FACT = r"(?<![A-Za-z0-9_])([LHBbTtatKknfQ][A-Za-z0-9_]{0,4})\s*[=:]\s*([0-9]+[.,]?[0-9]*)\s*(m|mm|kN|MPa|N/mm2|%|t)?"


def facts_of(text: Column) -> Column:
    """array(struct(key, fact)) of the assignments in a text, in order."""
    all_of = lambda group: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FACT), F.lit(group))
    zipped = F.arrays_zip(all_of(1).alias("k"), all_of(2).alias("v"), all_of(3).alias("u"))
    return F.transform(zipped, lambda x: F.struct(x["k"].alias("key"), F.concat(x["k"], F.lit("="), x["v"], x["u"]).alias("fact")))


def history_facts(turns: DataFrame, queries: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text), queries (conv_id, query) -> (conv_id, key, fact, place).

    A key is taken from the query, else from the latest user turn, else from the first turn that
    has it. Turns are exploded where they are; only facts are shuffled.
    """
    latest = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"))
    known = turns.select("conv_id").distinct()
    near = queries.join(known, "conv_id").join(latest, "conv_id", "left")
    parts = [
        near.select("conv_id", F.lit(0).alias("priority"), F.lit(0).cast("long").alias("turn"), F.posexplode(facts_of(F.col("query"))).alias("at", "f")),
        near.select("conv_id", F.lit(1).alias("priority"), F.lit(0).cast("long").alias("turn"), F.posexplode(facts_of(F.col("latest"))).alias("at", "f")),
        turns.join(queries.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.lit(2).alias("priority"), F.col("turn").cast("long").alias("turn"), F.posexplode(facts_of(F.col("text"))).alias("at", "f")),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = found.groupBy("conv_id", F.col("f.key").alias("key")).agg(F.min(F.struct("priority", "turn", "at", F.col("f.fact").alias("fact"))).alias("m"))
    window = Window.partitionBy("conv_id").orderBy("m.priority", "m.turn", "m.at")
    return first.select("conv_id", "key", "m.fact", F.row_number().over(window).alias("place"))


def ship_type_of(query: Column, latest: Column, everything: Column, glossary: list[tuple[str, str]]) -> Column:
    names = [t[0] for t in SHIP_TYPES]
    return F.coalesce(first_keyword(apply_glossary(query, glossary), names), first_keyword(apply_glossary(latest, glossary), names), first_keyword(everything, names))


def history_prefix(turns: DataFrame, queries: DataFrame, glossary: list[tuple[str, str]]) -> DataFrame:
    """(conv_id, prefix): the facts of ``history_facts`` and the ship type, comma-joined; conversations without turns have no row."""
    in_order = lambda pairs, field: F.transform(F.array_sort(F.collect_list(pairs)), lambda x: x[field])
    facts = history_facts(turns, queries).groupBy("conv_id").agg(in_order(F.struct("place", "fact"), "fact").alias("facts"))
    said = turns.groupBy("conv_id").agg(
        F.array_join(in_order(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")), "text"), " ").alias("said"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("latest")
    )
    rows = queries.select("conv_id", "query").join(said, "conv_id").join(facts, "conv_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ship = ship_type_of(text("query"), text("latest"), F.concat_ws(" ", "said", text("query")), glossary)
    return rows.select("conv_id", F.array_join(F.concat(F.coalesce("facts", F.array().cast("array<string>")), F.filter(F.array(F.concat(F.lit("ship_type="), ship)), lambda x: x.isNotNull())), ", ").alias("prefix"))


def translate_condense(queries: DataFrame, turns: DataFrame, cache: DataFrame, ask, glossary: list[tuple[str, str]]) -> DataFrame:
    """The English stand-alone question of each query: cache, model, clean, validate, store.

    queries (query_id, conv_id, query, language, mode; one a conversation), turns (conv_id, turn, role, text), cache
    (query_hash, en_query) -> query_id, english, reason, origin (``cache`` or ``model``), query_hash, store (the row belongs in the cache).

    The cache serves questions without history only, and not where its text drifted from the question. ``ask`` maps the
    user messages (array of strings) to an answer; it gets null where the cache served. Without language or mode nothing is cached or validated.
    """
    prior = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("prior"))
    rows = queries.join(prior, "conv_id", "left").join(history_prefix(turns, queries, glossary), "conv_id", "left")
    checked = F.col("language").isNotNull() & F.col("mode").isNotNull()
    alone = F.col("prior").isNull() & checked
    rows = rows.withColumns({"checked": checked, "alone": alone, "query_hash": F.when(alone, cache_key(F.col("query"), F.col("language"), F.col("mode")))})
    rows = rows.join(cache.select("query_hash", "en_query"), "query_hash", "left")
    rows = rows.withColumn("served", F.when(F.col("en_query").isNotNull(), condensed(F.col("query"), F.col("en_query"), glossary)))
    rows = rows.withColumn("hit", F.coalesce(~F.col("served.reason").startswith("fallback:"), F.lit(False)))
    plain = apply_glossary(F.col("query"), glossary)
    subject = F.when(F.coalesce("prefix", F.lit("")) != "", F.concat(F.lit("[From conversation history: "), "prefix", F.lit("] "), plain)).otherwise(plain)
    rows = rows.withColumn("subject", subject)
    messages = F.concat(F.coalesce("prior", F.array().cast("array<string>")), F.array("subject"))
    rows = rows.withColumn("answer", ask(F.when(~F.col("hit"), messages)))
    rows = rows.withColumn("made", F.coalesce(F.nullif(first_line(F.col("answer")), F.lit("")), F.col("subject")))
    fresh = F.when(F.col("checked"), condensed(F.col("query"), F.col("made"), glossary)).otherwise(F.struct(F.col("made").alias("query"), F.lit("unchecked").alias("reason")))
    rows = rows.withColumn("out", F.when(F.col("hit"), F.col("served")).otherwise(fresh))
    origin = F.when(F.col("hit"), "cache").otherwise("model")
    return rows.select("query_id", F.col("out.query").alias("english"), "out.reason", origin.alias("origin"), "query_hash", (F.col("alone") & ~F.col("hit")).alias("store"))


# Words without meaning for the comparison, and technical hints.
FIDELITY_STOP = (
    "a an and are as at be by for from how in is it of on or the to what when where which who why with yang dan atau untuk pada dengan dalam dari apa "
    "berapa bagaimana apakah di ke ini itu kapal menurut aturan harus does do not was were shall should can may"
).split()
TECHNICAL = (
    "aluminium alloy emergency release system corrosion addition manholes cargo tank dry spaces bulwark plating superstructure bulkhead thickness "
    "towing winch mooring dredger tanker structure hull kapal pelat sekat tangki lambung baja paduan"
).split()


def fidelity_tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w.=/%+-]", " ")
    tokens = F.regexp_extract_all(plain, F.lit(r"[a-z0-9][a-z0-9._/%+-]*"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(FIDELITY_STOP) & ((F.length(t) >= 4) | t.rlike("[0-9]"))))


def fidelity(original: Column, english: Column, glossary: list[tuple[str, str]]) -> Column:
    """struct(ok, reason): whether a condensed query still stands for the original."""
    hints = F.array(*[F.lit(x) for x in TECHNICAL])

    def judged(t):
        generic = (F.lower(t["bridged"]) == F.lower(original)) & ~original.rlike("[0-9]") & (F.size(F.array_intersect(t["a"], hints)) == 0)
        missing = F.filter(F.array_except(t["a"], t["b"]), lambda x: x.rlike("[0-9]"))
        return (
            F.when(F.size(t["b"]) == 0, "empty_condensed_query")
            .when(F.size(t["a"]) == 0, "no_fidelity_tokens")
            .when(generic, "generic_query")
            .when(F.size(missing) > 0, F.concat(F.lit("missing_parameters:"), F.array_join(F.sort_array(missing), ",")))
            .when(~F.arrays_overlap(t["a"], t["b"]), "topic_drift:overlap=none")
            .otherwise("ok")
        )

    # bound, so that the text is replaced and cut into tokens once, not at each use
    tokens = bind(apply_glossary(original, glossary), lambda x: F.struct(x.alias("bridged"), fidelity_tokens(x).alias("a"), fidelity_tokens(english).alias("b")))
    return bind(bind(tokens, judged), lambda reason: F.struct(reason.isin("no_fidelity_tokens", "generic_query", "ok").alias("ok"), reason.alias("reason")))


def condensed(original: Column, candidate: Column, glossary: list[tuple[str, str]]) -> Column:
    """struct(query, reason): the mended candidate, or the glossary's text if it drifted."""
    mend = lambda text: bind(fix_place(original, text), lambda placed: fix_direction(original, placed))
    made = lambda q, r: F.struct(q.alias("query"), r.alias("reason"))

    def judged(fixed):
        blank = (F.trim(original) == "") | (F.trim(fixed) == "")
        kept = lambda c: F.when(c["ok"], made(fixed, c["reason"])).otherwise(made(mend(apply_glossary(original, glossary)), F.concat(F.lit("fallback:"), c["reason"])))
        return F.when(blank, made(fixed, F.lit("validation_skipped"))).otherwise(bind(fidelity(original, fixed, glossary), kept))

    return bind(mend(candidate), judged)


# Words that the fallback query leaves out.
FALLBACK_DROP = (
    "kalau apakah kemungkinan berubah dengan untuk pada yang antara bagaimanakah bagaimana kapal pelatnya panjang jarak ini itu harus akan dan atau dari "
    "menggunakan baja standar sistem rangka maksimum saja berapakah berapa adakah kapalnya wrangnya pelat perubahan antar adanya perlu seri diizinkan "
    "digunakan struktur lambung aturan ketentuan menurut kepada maka tersebut"
).split()


def fallback_query(query: Column, first_user: Column, facts: Column, glossary: list[tuple[str, str]]) -> Column:
    """English query from facts (array of strings) and the distinct glossary words of the first turn and the query."""
    subject = apply_glossary(F.trim(F.concat_ws(" ", first_user, query)), glossary)
    words = F.filter(F.transform(F.regexp_extract_all(subject, F.lit(r"[A-Za-z]{4,}"), F.lit(0)), F.lower), lambda w: ~w.isin(FALLBACK_DROP))
    out = F.array_join(F.concat(F.coalesce(facts, F.array().cast("array<string>")), F.array_distinct(words)), " ")
    return F.when(out == "", subject).otherwise(out)


def paraphrases(text: Column, cap: int) -> Column:
    """Lines of a model's answer as at most ``cap`` distinct queries, prefixes and quotes stripped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^[0-9.\-)* \t]+", "")), r"^[\"']+|[\"']+$", "")))
    long = F.filter(lines, lambda x: F.length(x) >= 4)
    lowered = F.transform(long, F.lower)
    firsts = F.filter(F.transform(long, lambda x, i: F.struct(x.alias("x"), (F.array_position(lowered, F.lower(x)) == i + 1).alias("new"))), lambda s: s["new"])
    return F.slice(F.transform(firsts, lambda s: s["x"]), 1, cap)
