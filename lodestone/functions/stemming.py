"""English stemmer (the published Porter2 algorithm) as a chain of columns.

Each step is one expression in SQL that Spark and DuckDB read alike, over the columns of the steps before. A
suffix is the longest of a step's list; it counts only in its region: r1 begins after the first consonant that follows
a vowel, r2 is the same within r1. Upper-case Y is a y that is a consonant.

``stem_of`` is the same for one word, for tasks that hold words in Arrow batches; a test compares both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm: whole words with their own stems, words that stay, and those that stay after the first step.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAYING = "sky news howe atlas cosmos bias andes".split()
STAYING_LATER = "inning outing canning herring earring proceed exceed succeed".split()
# Fixed values of the published algorithm: suffixes and what they become.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _suffix(column: str, suffixes) -> str:
    return f"regexp_extract({column}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 1)"


def _has(column: str, pattern: str) -> str:
    return f"regexp_extract({column}, '{pattern}', 0) <> ''"


def _cut(column: str, n) -> str:
    return f"substr({column}, 1, CAST(length({column}) - {n} AS INT))"


def _becomes(suffix: str, table: dict) -> str:
    return f"CASE {suffix} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _marked(column: str) -> str:
    out = column
    for vowel in "aeiouy":
        out = f"replace({out}, '{vowel}y', '{vowel}Y')"
    return out


_FIRST = "regexp_extract({}, '^[^aeiouy]*[aeiouy]+[^aeiouy]', 0)"
_SHORT_END = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"

#: (column, expression), in order; the input is ``word``, the output ``stem``.
STEPS = [
    ("y0", "CASE WHEN substr(word, 1, 1) = 'y' THEN 'Y' || substr(word, 2) ELSE word END"),
    ("w0", _marked("y0")),
    ("f1", f"CASE WHEN {_has('w0', '^(?:gener|commun|arsen)')} THEN regexp_extract(w0, '^(?:gener|commun|arsen)', 0) ELSE {_FIRST.format('w0')} END"),
    ("r1", "CASE WHEN f1 = '' THEN length(w0) ELSE length(f1) END"),
    ("f2", _FIRST.format("substr(w0, CAST(r1 + 1 AS INT))")),
    ("r2", "CASE WHEN f2 = '' THEN length(w0) ELSE r1 + length(f2) END"),
    ("s1", _suffix("w0", ["sses", "ied", "ies", "us", "ss", "s"])),
    ("w1", f"CASE WHEN s1 = 'sses' THEN {_cut('w0', 2)} WHEN s1 IN ('ied', 'ies') THEN (CASE WHEN length(w0) > 4 THEN {_cut('w0', 2)} ELSE {_cut('w0', 1)} END) WHEN s1 = 's' AND {_has(_cut('w0', 2), '[aeiouy]')} THEN {_cut('w0', 1)} ELSE w0 END"),
    ("s2", _suffix("w1", ["eedly", "eed", "ingly", "edly", "ing", "ed"])),
    ("d2", f"CASE WHEN s2 IN ('eed', 'eedly') THEN (CASE WHEN length(w1) - length(s2) >= r1 THEN {_cut('w1', 'length(s2)')} || 'ee' ELSE w1 END) WHEN s2 <> '' AND {_has(_cut('w1', 'length(s2)'), '[aeiouy]')} THEN {_cut('w1', 'length(s2)')} ELSE w1 END"),
    ("w2", f"CASE WHEN s2 IN ('', 'eed', 'eedly') OR d2 = w1 THEN d2 WHEN {_has('d2', '(?:at|bl|iz)$')} THEN d2 || 'e' WHEN {_has('d2', '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut('d2', 1)} WHEN length(d2) <= r1 AND {_has('d2', _SHORT_END)} THEN d2 || 'e' ELSE d2 END"),
    ("w3", f"CASE WHEN {_has('w2', '^.+[^aeiouy][yY]$')} THEN {_cut('w2', 1)} || 'i' ELSE w2 END"),
    ("s4", _suffix("w3", SECOND)),
    ("w4", f"CASE WHEN s4 = '' OR length(w3) - length(s4) < r1 THEN w3 WHEN s4 = 'ogi' THEN (CASE WHEN {_has('w3', 'logi$')} THEN {_cut('w3', 1)} ELSE w3 END) WHEN s4 = 'li' THEN (CASE WHEN {_has('w3', '[cdeghkmnrt]li$')} THEN {_cut('w3', 2)} ELSE w3 END) ELSE {_cut('w3', 'length(s4)')} || {_becomes('s4', SECOND)} END"),
    ("s5", _suffix("w4", THIRD)),
    ("w5", f"CASE WHEN s5 = '' OR length(w4) - length(s5) < r1 OR (s5 = 'ative' AND length(w4) - 5 < r2) THEN w4 ELSE {_cut('w4', 'length(s5)')} || {_becomes('s5', THIRD)} END"),
    ("s6", _suffix("w5", FOURTH)),
    ("w6", f"CASE WHEN s6 = '' OR length(w5) - length(s6) < r2 OR (s6 = 'ion' AND NOT {_has('w5', '[st]ion$')}) THEN w5 ELSE {_cut('w5', 'length(s6)')} END"),
    ("w7", f"CASE WHEN {_has('w6', 'e$')} AND (length(w6) - 1 >= r2 OR (length(w6) - 1 >= r1 AND NOT {_has(_cut('w6', 1), _SHORT_END)})) THEN {_cut('w6', 1)} WHEN {_has('w6', 'll$')} AND length(w6) - 1 >= r2 THEN {_cut('w6', 1)} ELSE w6 END"),
    ("stem", f"CASE WHEN length(word) <= 2 OR word IN ({_list(STAYING)}) THEN word WHEN word IN ({_list(OWN)}) THEN {_becomes('word', OWN)} WHEN w1 IN ({_list(STAYING_LATER)}) THEN w1 ELSE replace(w7, 'Y', 'y') END"),
]


def with_stem(df: DataFrame) -> DataFrame:
    """df (word, lower case, ...) with stem; null stays null."""
    kept, out = [f"`{c}`" for c in df.columns if c != "stem"], df.drop("stem")
    for name, expression in STEPS:
        out = out.selectExpr("*", f"{expression} AS {name}")
    # a generated column: filters on it, as joins add them, must not be pushed into the chain, where each step would double them
    return out.select(*kept, F.explode(F.array("stem")).alias("stem"))


def stem_sql(source: str) -> str:
    """The same as DuckDB SQL, over a table with ``word``."""
    out = f"SELECT * FROM ({source})"
    for name, expression in STEPS:
        out = f"SELECT *, {expression} AS {name} FROM ({out})"
    return out


_ENDS = {kind: re.compile(f"({'|'.join(sorted(of, key=len, reverse=True))})$") for kind, of in {"s1": ["sses", "ied", "ies", "us", "ss", "s"], "s2": ["eedly", "eed", "ingly", "edly", "ing", "ed"], "s4": SECOND, "s5": THIRD, "s6": FOURTH}.items()}
_BEGIN, _EXCEPTED = re.compile(_FIRST.split("'")[1]), re.compile("gener|commun|arsen")
_VOWEL, _SHORT, _E_AFTER, _DOUBLE, _Y_END = (re.compile(x) for x in ("[aeiouy]", _SHORT_END, "(?:at|bl|iz)$", "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", "^.+[^aeiouy][yY]$"))


def stem_of(word: str) -> str:
    """The stem of one word, by the steps of ``STEPS``."""
    if len(word) <= 2 or word in STAYING:
        return word
    if word in OWN:
        return OWN[word]
    end = lambda kind, w: m[1] if (m := _ENDS[kind].search(w)) else ""
    w = "Y" + word[1:] if word[0] == "y" else word
    for vowel in "aeiouy":
        w = w.replace(vowel + "y", vowel + "Y")
    first = _EXCEPTED.match(w) or _BEGIN.match(w)
    r1 = first.end() if first else len(w)
    second = _BEGIN.match(w[r1:])
    r2 = r1 + second.end() if second else len(w)

    s = end("s1", w)
    if s == "sses" or (s in ("ied", "ies") and len(w) > 4):
        w = w[:-2]
    elif s in ("ied", "ies") or (s == "s" and _VOWEL.search(w[:-2])):
        w = w[:-1]
    if w in STAYING_LATER:
        return w

    s = end("s2", w)
    if s in ("eed", "eedly"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if _E_AFTER.search(w):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if _Y_END.search(w):
        w = w[:-1] + "i"

    s = end("s4", w)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if re.search("[cdeghkmnrt]li$", w) else w
        else:
            w = w[: -len(s)] + SECOND[s]
    s = end("s5", w)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + THIRD[s]
    s = end("s6", w)
    if s and len(w) - len(s) >= r2 and (s != "ion" or re.search("[st]ion$", w)):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.replace("Y", "y")
