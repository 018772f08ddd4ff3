"""Text columns: normalising, matching, tokens, numbers, units, citations."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case; anything but word characters becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def padded(normal: Column) -> Column:
    """A normalised text with a space at each end: whole words are then substrings."""
    return F.concat(F.lit(" "), normal, F.lit(" "))


def is_whole_word(term: Column) -> Column:
    """Terms that must match as a whole word: one token that is short or all capitals."""
    return ~F.trim(term).contains(" ") & ((F.length(F.trim(term)) <= 2) | F.trim(term).rlike(r"(?U)^\p{Lu}+$"))


def term_matches(text_normal: Column, term: Column) -> Column:
    """Whole word or substring match of a term in a normalised text."""
    normal = normalise(term)
    return (normal != "") & F.when(is_whole_word(term), padded(text_normal).contains(padded(normal))).otherwise(text_normal.contains(normal))


def words(text: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda x: x != "")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


# Signs that stand for operators.
SIGNS = {"≤": "<=", "≥": ">=", "≠": "!=", "·": "*", "×": "x", "–": "-", "—": "-"}


def plain_signs(text: Column) -> Column:
    out = text
    for sign, plain in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.trim(F.lower(out))


def replace_phrases(text: Column, phrases: dict[str, str]) -> Column:
    """Phrases replaced one after another, longest first."""
    out = text
    for phrase in sorted(phrases, key=len, reverse=True):
        out = F.replace(out, F.lit(phrase), F.lit(phrases[phrase]))
    return out


def parse_number(text: Column) -> Column:
    """A number after an optional operator; comma or dot decimals."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"^(<=|>=|!=|<|>|=)", "")), " ", "")
    plain = F.replace(bare, F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), plain.try_cast("double"))


UNIT = "mm|cm|m|%|t|deg|kg|kn|n|dwt|tdw"


def extract_unit(text: Column) -> Column:
    """Unit in brackets, in parentheses, as a word, or after a number; else null."""
    low = F.trim(F.lower(text))
    found = lambda pattern, group=1: F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))
    ton = lambda unit: F.when(unit == "tdw", "dwt").otherwise(unit)
    return F.coalesce(
        ton(found(rf"\[({UNIT})\]")),
        ton(found(rf"\(({UNIT})\)")),
        found(r"\b(n/mm[²2]|inch)\b"),
        found(r"([0-9]+(?:[.,][0-9]+)?)\s*(mm|cm|m|%|kg|t|deg|kn|n|dwt)\b", 2),
        F.when(low.rlike(r"\b(percent|persen)\b"), "%"),
    )


# Dimension of a unit, and length units in millimetres.
DIMENSIONS = {
    "mm": "length", "cm": "length", "m": "length", "inch": "length", "in": "length",
    "%": "percent", "percent": "percent", "persen": "percent",
    "kg": "mass", "t": "mass", "ton": "mass", "dwt": "mass", "tdw": "mass",
    "n/mm2": "pressure", "n/mm²": "pressure", "deg": "angle", "°c": "temperature", "celsius": "temperature", "kn": "force", "n": "force",
}
MILLIMETRES = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "inch": 25.4, "in": 25.4}


def lookup(key: Column, values: dict) -> Column:
    """A small fixed map as a column; null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def dimension(unit: Column) -> Column:
    return lookup(unit, DIMENSIONS)


def to_millimetres(value: Column, unit: Column) -> Column:
    return value * lookup(unit, MILLIMETRES)


def discriminative_tokens(text: Column, ignored: list[str]) -> Column:
    """Distinct words of two or more characters that tell topics apart."""
    spelled = text
    for sign, name in {"α": "alpha", "β": "beta", "γ": "gamma"}.items():
        spelled = F.replace(spelled, F.lit(sign), F.lit(name))
    tokens = F.filter(F.split(F.lower(spelled), r"(?U)\W+"), lambda x: F.length(x) >= 2)
    return F.array_except(F.array_distinct(tokens), F.array(*[F.lit(x) for x in ignored]))


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p."), start.cast("string"))).otherwise(F.concat(F.lit("pp."), start.cast("string"), F.lit("-"), end.cast("string")))


def citation(section: Column, paragraph: Column, start: Column, end: Column) -> Column:
    """(Sec n | paragraph p.x), or (Sec n, p.x) without a paragraph."""
    head, page = F.concat(F.lit("(Sec "), section.cast("string")), page_range(start, end)
    return F.when(F.coalesce(paragraph, F.lit("")) != "", F.concat(head, F.lit(" | "), paragraph, F.lit(" "), page, F.lit(")"))).otherwise(F.concat(head, F.lit(", "), page, F.lit(")")))


#: Fixed value: what counts as a citation in an answer.
CITATION = r"\([Ss]ec\s+[0-9]+[^()\n]{1,60}\)|[Ss]ec\s+[0-9]+(?:[^.()\n]{1,40}\|\s*[A-Za-z0-9_.\-]+|\s+pp?\.[0-9]+(?:-[0-9]+)?)"


def has_citation(text: Column) -> Column:
    return text.rlike(CITATION)


def excerpt(text: Column, width: int = 120) -> Column:
    """One line without the leading [..] header, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\[[^\]]*\][\n ]\s*", ""), r"[\n\r]", " "))
    return F.when(F.length(line) > width, F.concat(F.left(line, F.lit(width)), F.lit("…"))).otherwise(line)


def short_title(title: Column, width: int = 18) -> Column:
    return F.when(F.length(title) > width, F.concat(F.left(title, F.lit(width - 1)), F.lit("…"))).otherwise(title)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def first_line(text: Column, prefixes: tuple[str, ...] = ("rewritten query:", "english query:", "query:", "answer:")) -> Column:
    """First non-empty line after quotes and known prefixes are stripped."""
    out = F.regexp_replace(stripped(text), r'\A"+|"+\z', "")
    out = stripped(F.regexp_replace(out, r"\A'+|'+\z", ""))
    for prefix in prefixes:
        out = stripped(F.regexp_replace(out, "(?i)^" + prefix, ""))
    lines = F.filter(F.transform(F.split(out, r"\r\n|\n|\r"), stripped), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def cache_key(text: Column, language: Column, mode: Column, version: int = 4) -> Column:
    """SHA-256 of version, language, mode and the text in lower case with single spaces."""
    plain = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    return F.sha2(F.concat_ws("|", F.lit(str(version)), language, mode, plain), 256)


@cache
def _compatibility() -> tuple[str, str, dict[str, str], str]:
    """NFKC of single characters of the basic plane: one-to-one pairs, those that become several, and a
    character class of the Latin ones that stay as they are."""
    one, several = {}, {}
    for c in map(chr, [*range(0xA0, 0x3400), *range(0xF900, 0xFB50), *range(0xFE10, 0xFFF0)]):
        n = unicodedata.normalize("NFKC", c)
        if n != c:
            (one if len(n) == 1 else several)[c] = n
    same = "".join(c for c in map(chr, range(0xA0, 0x180)) if c not in one and c not in several)
    return "".join(one), "".join(one.values()), several, rf"\x00-\x9F{same}"


def compatible(text: Column) -> Column:
    """NFKC character by character: widths, signs, fractions, ligatures, units. Combining marks aren't composed."""
    one, to, several, same = _compatibility()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded to a literal
    folded = F.translate(text, one, to)
    spelt = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(text.rlike(rf"\A[{same}]*+\z"), text).when(folded.rlike(f"[{''.join(several)}]"), spelt).otherwise(folded)


def comparable_answer(text: Column) -> Column:
    """For grading: compatible characters, lower case, decimal points, percent and roots spelt out, no white space."""
    out = F.replace(F.lower(compatible(text)), F.lit(","), F.lit("."))
    out = F.regexp_replace(out, r"([0-9])\s*%", "$1 percent")
    out = F.regexp_replace(out, r"(?U)\bsqrt\b", "square root")
    for a, b in (("√", "square root"), ("×", "x"), ("·", "x"), ("ℓ", "l")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\s+", "")
