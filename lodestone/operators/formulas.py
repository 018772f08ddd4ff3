"""Formula engine: values stated in a question, ranking, selection and evaluation.

The catalogue is a small list of Formula objects, each compiled to Columns once; questions
are a DataFrame (query_id, query) and stay distributed throughout.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import compile_expression, symbols
from .analysis import bind


@dataclass(frozen=True)
class Variable:
    symbol: str
    name: str
    unit: str = ""
    required: bool = True
    default: float | None = None


@dataclass(frozen=True)
class Formula:
    code: str
    title: str
    expression: str
    unit: str
    variables: tuple[Variable, ...] = field(default=())
    section_no: int = 0
    paragraph_id: str | None = None
    page_no: int | None = None
    notes: str = ""
    #: Symbol and expression to use when that symbol has no value.
    without: tuple[str, str] | None = None


def _v(symbol, name, unit="", default=None, required=True):
    return Variable(symbol, name, unit, required, default)


_A, _K, _TK, _L = _v("a", "stiffener spacing", "m"), _v("k", "material factor", "", 1.0), _v("tK", "corrosion addition", "mm", 1.0), _v("L", "ship length", "m")
_NF = _v("nf", "framing factor", "", 1.0)

# Codes, expressions and units of the catalogue.
CATALOGUE = [
    Formula("DECK_PLATING_CARGO", "Deck plating under cargo load", "1.21*a*sqrt(pL*k) + tK", "mm", (_A, _v("pL", "deck load", "kN/m2"), _K, _TK)),
    Formula("DECK_PLATING_MIN", "Minimum deck plating thickness", "(5.5 + 0.02*L)*sqrt(k)", "mm", (_L, _K)),
    Formula("FLOOR_WEB_THICKNESS", "Web thickness of a plate floor", "h/100 + 3.0", "mm", (_v("h", "floor height", "mm"),)),
    Formula("FLOOR_PEAK_THICKNESS", "Floor thickness in the fore peak", "0.035*L + 5.0", "mm", (_L,)),
    Formula("FLOOR_HEIGHT_FOREPEAK", "Floor height in the fore peak", "0.06*H + 0.7", "m", (_v("H", "depth", "m"),)),
    Formula("CENTRE_GIRDER_WEB", "Centre girder web plate", "0.07*L + 5.5", "mm", (_L,)),
    Formula("CENTRE_GIRDER_FACEPLATE", "Centre girder face plate", "0.7*L + 12", "cm2", (_L,)),
    Formula(
        "FRAME_SECTION_MODULUS", "Section modulus of a frame", "0.55*m*a*l**2*p*cr*k", "cm3",
        (_v("m", "bending factor"), _A, _v("l", "span", "m"), _v("p", "load", "kN/m2"), _v("cr", "curvature factor", "", 1.0), _K),
    ),
    Formula("WHEEL_LOAD", "Load of one wheel", "(Q/n)*(1 + av)", "kN", (_v("Q", "axle load", "kN"), _v("n", "number of wheels"), _v("av", "acceleration factor", "", 0.0))),
    Formula("FORECASTLE_SPEED", "Speed threshold for a forecastle", "1.6*sqrt(L)", "kn", (_L,)),
    Formula("BOTTOM_PLATING_L_LESS_90", "Bottom shell plating, shorter ships", "1.9 * nf * a * sqrt(pB * k) + tK", "mm", (_NF, _A, _v("pB", "bottom load", "kN/m2"), _K, _TK)),
    Formula(
        "BOTTOM_PLATING_L_GREATER_90", "Bottom shell plating, longer ships", "Max(18.3 * nf * a * sqrt(pB / (200.2/k)) + tK, 1.21 * a * sqrt(pB * k) + tK)", "mm",
        (_L, _NF, _A, _v("pB", "bottom load", "kN/m2"), _K, _TK),
    ),
    Formula("SIDE_PLATING_L_LESS_90", "Side shell plating, shorter ships", "1.9 * nf * a * sqrt(pS * k) + tK", "mm", (_NF, _A, _v("pS", "side load", "kN/m2"), _K, _TK)),
    Formula(
        "SIDE_PLATING_L_GREATER_90", "Side shell plating, longer ships",
        "Max(18.3 * nf * a * sqrt(pS / (176.1/k)) + tK, 1.21 * a * sqrt(pS * k) + tK, 18.3 * nf * a * sqrt(pS1 / (190.8/k)) + tK)", "mm",
        (_L, _NF, _A, _v("pS", "side load", "kN/m2"), _v("pS1", "second side load", "kN/m2"), _K, _TK),
        without=("pS1", "Max(18.3 * nf * a * sqrt(pS / (176.1/k)) + tK, 1.21 * a * sqrt(pS * k) + tK)"),
    ),
    Formula("PLATE_NET_THICKNESS_SLENDERNESS", "Net thickness by slenderness", "(b / C) * sqrt(1 / k)", "mm", (_v("b", "plate breadth", "mm"), _v("C", "slenderness coefficient", "", 100.0), _K)),
]
BY_CODE = {f.code: f for f in CATALOGUE}

# Phrases that stand for a symbol, in order of precedence.
ALIASES = [
    ("jarak penegar", "a"), ("stiffener spacing", "a"), ("jarak gading", "a"), ("frame spacing", "a"),
    ("nilai b", "a"), ("nilai a", "a"), ("jarak jepit", "l"), ("spacing", "a"),
]
_NUMBER = r"(-?[0-9]+(?:[.,][0-9]+)?)"
_UNIT = r"(?:\s+([a-zA-Z0-9/^*-]+)(?!\w*\s*[=:]))?"
# Words after a value that are no units.
_NO_UNIT = "spacing|jarak|pelat|alas|sisi|bawah|atas|mild|steel|baja|standar|lunak|kapal|minimum|maksimum|nilai|shell|plating|bottom|side|deck|hatch|plate"
_ASSIGNED = rf"(?i)(\w+)\)?\s*[=:]\s*{_NUMBER}(?:\s+(?!{_NO_UNIT})([a-zA-Z0-9/^*-]+)(?!\w*\s*[=:]))?"

HIGH_TENSILE, NAMED_HT, MILD = r"(?i)high\s*tensile|ht", r"(?i)high\s*tensile|\bht\b", r"(?i)mild\s*steel|baja\s*lunak"
LONGITUDINAL, TRANSVERSE = r"(?i)longitudinal|membujur", r"(?i)transverse|melintang"


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _alias_pattern(alias: str) -> str:
    return rf"(?i)\Q{alias}\E[\s=:]+{_NUMBER}{_UNIT}"


def assignments(query: Column) -> Column:
    """array(struct(name, value, unit)): phrases first (named ``@phrase``), then name=value in order."""

    def phrase(alias):
        p = F.lit(_alias_pattern(alias))
        zipped = F.arrays_zip(F.regexp_extract_all(query, p, F.lit(1)).alias("v"), F.regexp_extract_all(query, p, F.lit(2)).alias("u"))
        return F.transform(zipped, lambda x: F.struct(F.lit("@" + alias).alias("name"), _number(x["v"]).alias("value"), x["u"].alias("unit")))

    some = query.rlike("(?i)" + "|".join(rf"\Q{a}\E" for a, _ in ALIASES))  # most texts hold none of the phrases
    none = F.array().cast("array<struct<name:string,value:double,unit:string>>")
    phrases = F.when(some, F.concat(*[phrase(alias) for alias, _ in ALIASES])).otherwise(none)
    cut = query
    for alias, _ in ALIASES:
        cut = F.regexp_replace(cut, _alias_pattern(alias), " ")
    rest = F.when(some, cut).otherwise(query)

    def named(text):
        # one pass over the text; the parts are taken from the short matches
        part = lambda m, g: F.regexp_extract(m, _ASSIGNED, g)
        return F.transform(F.regexp_extract_all(text, F.lit(_ASSIGNED), F.lit(0)), lambda m: F.struct(part(m, 1).alias("name"), _number(part(m, 2)).alias("value"), part(m, 3).alias("unit")))

    return F.concat(phrases, bind(rest, named))


def stated(found: Column, query: Column, formula: Formula) -> dict[str, Column]:
    """Value of each symbol that the question states; null if it doesn't."""
    has_b = any(v.symbol.lower() == "b" for v in formula.variables)

    def in_metres(hit):
        unit = F.lower(hit["unit"])
        return F.when((unit == "mm") | ((unit == "") & (hit["value"] > 2.0)), hit["value"] / 1000.0).otherwise(hit["value"])

    def first(names, valued):
        return bind(F.get(F.filter(found, lambda x: F.lower(x["name"]).isin(sorted(names)) & x["value"].isNotNull()), F.lit(0)), valued)

    out = {}
    for v in formula.variables:
        symbol = v.symbol.lower()
        names = {symbol, v.name.lower()} | {"@" + a for a, s in ALIASES if ("b" if has_b and s == "a" else s) == symbol}
        if symbol == "a" and not has_b:
            names.add("b")
        value = first(names, in_metres if symbol == "a" else lambda hit: hit["value"])
        if symbol == "k":
            value = F.coalesce(value, F.when(query.rlike(MILD) & ~query.rlike(HIGH_TENSILE), F.lit(1.0)))
        if symbol == "nf":
            value = F.coalesce(value, F.when(query.rlike(LONGITUDINAL), F.lit(0.83)).when(query.rlike(TRANSVERSE), F.lit(1.0)))
        out[v.symbol] = value
    return out


def _warning(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def calculate(queries: DataFrame, formula: Formula) -> DataFrame:
    """queries (query_id, query, ...) -> their rows with code, status, missing, warnings, result, unit, shown.

    status: ok, out_of_range, needs_k, bad_load, missing, no_value or not_finite.
    """
    q = F.col("query")
    rows = queries.withColumn("__found", assignments(q))
    given = stated(F.col("__found"), q, formula)
    rows = rows.withColumns({f"__given{i}": c for i, c in enumerate(given.values())})
    place = {s: i for i, s in enumerate(given)}
    values, warnings, missing = {}, [], []
    for v in formula.variables:
        c = F.col(f"__given{place[v.symbol]}")
        filled = c
        if v.default is not None:
            fill = F.lit(float(v.default))
            if v.symbol == "k":
                fill = F.when(~q.rlike(HIGH_TENSILE), fill)
            filled = F.coalesce(c, fill)
            if v.symbol in ("nf", "k", "tK"):
                warnings.append(_warning(c.isNull() & filled.isNotNull(), f"assumed {v.symbol}={v.default}"))
        elif v.required and not (formula.without and formula.without[0] == v.symbol):
            missing.append(F.when(c.isNull(), F.lit(v.symbol)))
        values[v.symbol] = f"__value{place[v.symbol]}"
        rows = rows.withColumn(values[v.symbol], filled)
    value = lambda s: F.col(values[s])
    unknown = [s for s in symbols(formula.expression) if s not in values]
    if unknown:
        raise ValueError(f"{formula.code}: unknown symbols {unknown}")
    result = compile_expression(formula.expression, value)
    needed = symbols(formula.expression)
    absent = lambda names: F.exists(F.array(*[value(s).isNull() for s in names]), lambda x: x)
    lacking = absent(needed)
    if formula.without:
        symbol, shorter = formula.without
        result = F.when(value(symbol).isNull(), compile_expression(shorter, value)).otherwise(result)
        lacking = F.when(value(symbol).isNull(), absent(symbols(shorter))).otherwise(lacking)
        warnings.append(_warning(value(symbol).isNull(), f"{symbol} is not given; its branch is left out"))
    none = F.lit(False)
    span = ~value("a").between(0.1, 2.0) if "a" in values else none
    load = value("pB") if "pB" in values else F.lit(None).cast("double")
    k_gone = (value("k").isNull() & q.rlike(NAMED_HT)) if "k" in values else none
    rows = rows.withColumns({"__result": result, "missing": F.filter(F.array(*(missing or [F.lit(None).cast("string")])), lambda x: x.isNotNull())})
    finite = F.col("__result").isNotNull() & ~F.isnan("__result") & (F.abs("__result") != float("inf"))
    status = (
        F.when(F.coalesce(span, none), "out_of_range")
        .when(k_gone, "needs_k")
        .when(F.coalesce(load <= 0, none), "bad_load")
        .when(F.size("missing") > 0, "missing")
        .when(lacking, "no_value")
        .when(~finite, "not_finite")
        .otherwise("ok")
    )
    warnings += [_warning(load > 1000, "pB is very large")]
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    warnings += [_warning(ok & (F.col("__result") > 100), "the result is very large")]
    rounded = F.round("__result", 3)
    plain = F.when(rounded == F.floor(rounded), F.concat(F.floor(rounded).cast("string"), F.lit(",0"))).otherwise(F.replace(F.regexp_replace(F.format_string("%.3f", rounded), "0+$", ""), F.lit("."), F.lit(",")))
    return rows.select(
        *queries.columns,
        F.lit(formula.code).alias("code"),
        "status",
        "missing",
        F.filter(F.array(*warnings), lambda x: x.isNotNull()).alias("warnings"),
        F.when(ok, F.col("__result")).alias("result"),
        F.lit(formula.unit).alias("unit"),
        F.when(ok, F.concat(plain, F.lit(" " + formula.unit))).alias("shown"),
    )


# Words of the questions' language and the titles' words.
SYNONYMS = [
    ("penumpu tengah", "centre girder"), ("penumpu", "girder"), ("tengah", "centre"), ("tebal", "thickness"), ("pelat", "plate"), ("web", "web"), ("web plate", "web plate"),
    ("alas", "bottom"), ("dasar", "bottom"), ("bawah", "bottom"), ("sisi", "side"), ("kulit", "shell"), ("kulit luar", "shell"), ("lambung", "shell"),
]
_PLATING = {"alas", "dasar", "bawah", "kulit", "kulit luar", "sisi", "lambung"}
SLENDER = ["slenderness", "kelangsingan", "net thickness", "ketebalan bersih"]
SLENDER_CODE = "PLATE_NET_THICKNESS_SLENDERNESS"
_ASSIGN_CLEAN = r"(?i)\w+\s*[=:]\s*[0-9.,]+\s*"


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def rank_formulas(queries: DataFrame, formulas=CATALOGUE) -> DataFrame:
    """(query_id, code, place, score) of the formulas with a positive score."""
    clean = F.lower(F.regexp_replace(F.coalesce("query", F.lit("")), _ASSIGN_CLEAN, ""))
    rows = queries.withColumn("__clean", clean).withColumn("__slender", _any(F.lower(F.coalesce("query", F.lit(""))), SLENDER))
    own = F.filter(F.split("__clean", r"\W+"), lambda w: w != "")
    added = [F.when(F.col("__clean").contains(a), F.split(F.lit(b + (" plating" if a in _PLATING else "")), " ")).otherwise(F.array().cast("array<string>")) for a, b in SYNONYMS]
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(r"(\w+)\s*[=:]\s*[0-9.,]+"), F.lit(1)), lambda x: x))
    rows = rows.withColumn("__words", F.array_distinct(F.concat(own, *added))).withColumn("__names", names)
    scores = []
    for place, f in enumerate(formulas):
        text = f"{f.code} {f.title} {f.notes}".lower()
        words = sorted(set(re.findall(r"\w+", text)))
        shared = F.array_intersect("__words", F.array(*[F.lit(w) for w in words]))
        score = F.aggregate(shared, F.lit(0), lambda s, w: s + F.length(w))
        for a, b in SYNONYMS:
            if b in text:
                score = score + F.when(F.col("__clean").contains(a), 15).otherwise(0)
        known = sorted({v.symbol.lower() for v in f.variables} | {v.name.lower() for v in f.variables})
        score = score + 10 * F.size(F.array_intersect("__names", F.array(*[F.lit(x) for x in known])))
        for kind in ("bottom", "side"):
            if f.code.startswith(kind.upper() + "_PLATING"):
                near = F.array_contains("__words", kind) | F.array_contains("__words", "shell")
                score = F.when((score > 0) & near, score + 30).otherwise(score)
        if f.code == SLENDER_CODE:
            score = F.when(F.col("__slender"), score).otherwise(0)
        scores.append(F.struct(F.lit(f.code).alias("code"), F.lit(place).alias("place"), score.alias("score")))
    return rows.select("query_id", F.explode(F.filter(F.array(*scores), lambda x: x["score"] > 0)).alias("x")).select("query_id", "x.*")


def search_formulas(ranked: DataFrame) -> DataFrame:
    """The top formula alone if it leads clearly, else the first four."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    rows = ranked.withColumns({"n": F.row_number().over(order), "next": F.lead("score").over(order)})
    top = rows.where("n = 1").select("query_id", (F.col("next").isNull() | (F.col("score") > F.col("next") + 25) | (F.col("score") >= 1.5 * F.col("next"))).alias("clear"))
    return rows.join(top, "query_id").where((F.col("n") == 1) | (~F.col("clear") & (F.col("n") <= 4))).select("query_id", "code", "score", "n")


def provided(query: Column) -> Column:
    """Lower-case symbols that the question gives values for."""
    found = F.transform(F.regexp_extract_all(query, F.lit(r"(\w+)\)?\s*[=:]\s*[0-9.,]+"), F.lit(1)), F.lower)
    extra = [F.when(query.rlike(rf"(?i)\Q{a}\E[\s=:]+[0-9.,]+"), F.lit(s)) for a, s in ALIASES if a != "jarak jepit"]
    bare_b = query.rlike(r"(?i)\bb\s*[=:]\s*[0-9.,]+")
    extra += [F.when(bare_b, F.lit("a")), F.when(bare_b, F.lit("b"))]
    return F.array_distinct(F.concat(found, F.filter(F.array(*extra), lambda x: x.isNotNull())))


def select_formula(queries: DataFrame, formulas=CATALOGUE) -> DataFrame:
    """queries (query_id, query) -> query_id, code (null: ask back) and the candidates' codes."""
    codes = {f.code for f in formulas}
    clean = F.lower(F.regexp_replace(F.coalesce("query", F.lit("")), _ASSIGN_CLEAN, ""))
    flags = queries.select("query_id", "query", clean.alias("c"))
    has = lambda *w: _any(F.col("c"), w)
    flags = flags.select(
        "query_id",
        _number(F.nullif(F.regexp_extract("query", r"(?i)L\s*[=:]\s*([0-9.,]+)", 1), F.lit(""))).alias("length"),
        has("alas", "dasar", "bawah", "bottom").alias("bottom"),
        has("sisi", "side").alias("side"),
        has("dek", "geladak", "deck").alias("deck"),
        (has("kulit", "lambung", "shell", "alas", "dasar", "bawah", "bottom", "sisi", "side") | (has("jarak penegar", "spacing") & has("pelat", "plate", "tebal", "thickness"))).alias("shell"),
        has("ceruk", "fore peak", "forepeak").alias("peak"),
        has("height", "tinggi").alias("height"),
        has(*SLENDER).alias("slender"),
        has("wrang", "floor", "ceruk", "peak").alias("floor"),
        (has("tebal", "thickness") & has("pelat", "plate")).alias("generic"),
        provided(F.coalesce("query", F.lit(""))).alias("given"),
    )
    forced = F.when(F.col("peak") & F.col("height"), "FLOOR_HEIGHT_FOREPEAK").when(F.col("peak") & F.col("length").isNotNull(), "FLOOR_PEAK_THICKNESS").when(F.col("slender"), SLENDER_CODE)
    flags = flags.withColumn("forced", F.when(forced.isin(sorted(codes)), forced))
    rows = rank_formulas(queries, formulas).join(flags, "query_id").where((F.col("code") != SLENDER_CODE) | F.col("slender"))
    drop_shell = F.col("code").rlike("WHEEL_LOAD|FLOOR|DECK|CENTRE|FORECASTLE|FRAME")
    drop_deck = F.col("code").rlike("BOTTOM|SIDE|FLOOR|CENTRE|FORECASTLE|FRAME")
    fits = F.when(F.col("shell") & ~F.col("deck"), ~drop_shell).when(F.col("deck") & ~F.col("shell"), ~drop_deck).otherwise(True)
    by_query = Window.partitionBy("query_id")
    rows = rows.withColumn("fits", fits).withColumn("some", F.max("fits").over(by_query)).where(F.col("fits") | ~F.col("some"))
    cover = F.lit(0)
    for f in formulas:
        cover = F.when(F.col("code") == f.code, F.size(F.array_intersect("given", F.array(*[F.lit(x) for x in sorted({v.symbol.lower() for v in f.variables})])))).otherwise(cover)
    order = by_query.orderBy(F.desc("score"), "place")
    rows = rows.withColumn("cover", cover).withColumns(
        {"n": F.row_number().over(order), "next": F.lead("score").over(order), "next_code": F.lead("code").over(order), "next_cover": F.lead("cover").over(order), "lead": F.max(F.struct(F.col("code").rlike("BOTTOM|SIDE"))).over(by_query)}
    )
    listed = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("ranked"))
    branch = F.when(F.col("length") >= 90, "GREATER_90").otherwise("LESS_90")
    by_length = F.when(F.col("bottom") & ~F.col("side") & ~F.col("floor") & F.col("length").isNotNull(), F.concat(F.lit("BOTTOM_PLATING_L_"), branch)).when(
        F.col("side") & ~F.col("bottom") & F.col("length").isNotNull(), F.concat(F.lit("SIDE_PLATING_L_"), branch)
    )
    gap = F.col("score") - F.coalesce("next", F.lit(0))
    near = F.col("next").isNotNull() & (gap < 5)
    loads = F.arrays_overlap("given", F.array(F.lit("pb"), F.lit("ps"), F.lit("ps1")))
    chosen = (
        F.when(by_length.isNotNull(), F.when(by_length.isin(sorted(codes)), by_length))
        .when(near & (F.col("score") <= 20), F.lit(None))
        .when(F.col("generic") & ~F.col("bottom") & ~F.col("side") & loads, F.lit(None))
        .when(F.col("next").isNull(), F.col("code"))
        .when(near & (F.col("cover") > F.col("next_cover")), F.col("code"))
        .when(near & (F.col("next_cover") > F.col("cover")), F.col("next_code"))
        .when((gap >= 6) | (F.col("score") >= 1.1 * F.col("next")), F.col("code"))
    )
    asked_loads = F.col("generic") & ~F.col("bottom") & ~F.col("side") & loads & by_length.isNull() & ~(near & (F.col("score") <= 20))
    first = rows.where("n = 1").select("query_id", chosen.alias("chosen"), asked_loads.alias("only_shell"))
    joined = flags.join(first, "query_id", "left").join(listed, "query_id", "left")
    ranked = F.coalesce("ranked", F.array().cast("array<string>"))
    shells = F.filter(ranked, lambda c: c.rlike("BOTTOM|SIDE"))
    shown = F.when(F.col("only_shell") & F.col("forced").isNull() & (F.size(shells) > 0), shells).otherwise(ranked)
    return joined.select("query_id", F.coalesce("forced", "chosen").alias("code"), shown.alias("candidates"))


#: What a question still has to say, in the two languages; ``%s`` takes the missing loads.
HINTS = {
    "en": ("give the ship length L in m, as in L=120", "give the design load (%s) in kN/m2, as in pB=45", "say whether bottom or side plating is meant"),
    "id": ("sebutkan panjang kapal L dalam m, misalnya L=120", "sebutkan beban desain (%s) dalam kN/m2, misalnya pB=45", "sebutkan pelat alas atau pelat sisi"),
}
OPENINGS = {
    "en": ("The stiffener spacing is given. Still needed:", "Needed for the calculation:"),
    "id": ("Jarak penegar sudah ada. Masih diperlukan:", "Diperlukan untuk perhitungan:"),
}
DESIGN_LOADS = ("pB", "pS", "pS1")


def diagnose(selected: DataFrame, queries: DataFrame, formulas=CATALOGUE) -> DataFrame:
    """What a question without a chosen formula still has to say: query_id, hints (array), message (empty without hints).

    queries (query_id, query and, if it has one, lang: ``id`` or else English). The load hint names the loads that the candidates lack.
    """
    lang = F.col("lang") if "lang" in queries.columns else F.lit("en")
    joined = selected.join(queries.select("query_id", "query", (F.coalesce(lang, F.lit("en")) == "id").alias("local")), "query_id").where("code IS NULL")
    needed = lambda f: [v.symbol for v in f.variables if v.required and v.default is None]
    some = lambda codes: F.arrays_overlap("candidates", F.array(*[F.lit(c) for c in codes]).cast("array<string>"))
    kind = lambda part: F.exists("candidates", lambda c: c.contains(part))
    both = lambda en, local: F.when(F.col("local"), local).otherwise(en)
    text = lambda k: both(F.lit(HINTS["en"][k]), F.lit(HINTS["id"][k]))
    query = F.coalesce("query", F.lit(""))
    length = some([f.code for f in formulas if "l" in {s.lower() for s in needed(f)}]) & ~query.rlike(r"\bL\s*[=:]") & kind("GREATER_90") & kind("LESS_90")
    loads = F.filter(F.array(*[F.when(some([f.code for f in formulas if p in needed(f)]), F.lit(p)) for p in DESIGN_LOADS]), lambda x: x.isNotNull())
    load = (kind("BOTTOM") | kind("SIDE")) & (F.size(loads) > 0) & ~F.lower(query).rlike("pb|ps")
    named = F.replace(text(1), F.lit("%s"), F.array_join(loads, ", "))
    hints = F.filter(F.array(F.when(length, text(0)), F.when(load, named), F.when(~length & ~load & kind("BOTTOM") & kind("SIDE"), text(2))), lambda x: x.isNotNull())
    spacing = query.rlike(r"\bb\s*[=:]") | F.array_contains(provided(query), "a")
    opening = F.when(spacing, both(F.lit(OPENINGS["en"][0]), F.lit(OPENINGS["id"][0]))).otherwise(both(F.lit(OPENINGS["en"][1]), F.lit(OPENINGS["id"][1])))
    rows = joined.select("query_id", hints.alias("hints"), opening.alias("opening"))
    lines = F.array_join(F.transform("hints", lambda h: F.concat(F.lit("\n  - "), h)), "")
    return rows.select("query_id", "hints", F.when(F.size("hints") > 0, F.concat("opening", lines)).otherwise("").alias("message"))


def decode_variables(json_text: Column) -> Column:
    """JSON list of variables; ``required`` is true unless it says otherwise."""
    parsed = F.from_json(json_text, "array<struct<symbol:string,name:string,unit:string,required:boolean,default:double>>")
    return F.transform(parsed, lambda v: F.struct(v["symbol"].alias("symbol"), v["name"].alias("name"), v["unit"].alias("unit"), F.coalesce(v["required"], F.lit(True)).alias("required"), v["default"].alias("default")))
