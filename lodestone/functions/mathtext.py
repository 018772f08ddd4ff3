"""LaTeX in answers as plain text. Balanced braces are no regular language, so this is a pandas UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Commands and their signs. Other commands, Greek letters among them, become their names.
SIGNS = {"times": "×", "div": "÷", "cdot": "·", "pm": "±", "geq": "≥", "ge": "≥", "leq": "≤", "le": "≤", "neq": "≠", "approx": "≈"}
KNOWN = {*SIGNS, "frac", "dfrac", "tfrac", "sqrt", "text", "mathrm", "textbf", "mathbf", "operatorname", "left", "right", "quad", "qquad"}
#: Contents that need no brackets in a fraction.
SIMPLE = re.compile(r"[\w.°]+")
COMMAND = re.compile(r"\\([A-Za-z]+|.)", re.S)


def group(text: str, at: int) -> tuple[str, int]:
    """Content of the braces that open at ``at`` and where they end; to the end if they never close."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth:
            return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def argument(text: str, at: int) -> tuple[str, int]:
    """A brace group or one character, formatted."""
    while at < len(text) and text[at] == " ":
        at += 1
    if at < len(text) and text[at] == "{":
        inner, end = group(text, at)
        return plain(inner), end
    return text[at : at + 1], at + 1


def wrap(text: str) -> str:
    return text if not text or SIMPLE.fullmatch(text) else f"({text})"


def plain(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            m = COMMAND.match(text, i)
            if m[1].isalpha() and m[1] not in KNOWN and i and (text[i - 1].isalpha() or text[i - 1] == ":"):
                out.append(m[0])  # a folder's name, not a command
                i = m.end()
                continue
            name, i = m[1], m.end()
            if name in ("frac", "dfrac", "tfrac"):
                top, i = argument(text, i)
                bottom, i = argument(text, i)
                out.append(f"{wrap(top.strip())}/{wrap(bottom.strip())}")
            elif name == "sqrt":
                inner, i = argument(text, i)
                out.append(f"sqrt({inner.strip()})")
            elif name in ("text", "mathrm", "textbf", "mathbf", "operatorname"):
                inner, i = argument(text, i)
                out.append(inner)
            elif name in SIGNS:
                out.append(SIGNS[name])
            elif name in "()[]":
                pass  # delimiters of a formula
            elif name in ("left", "right", "quad", "qquad", ",", ";", ":", "!", " "):
                out.append("" if name in ("left", "right") else " ")
            elif name in "{}%&_#$":
                out.append(name)
            else:
                out.append(name if name.isalpha() else "")
        elif c in "^_":
            inner, i = argument(text, i + 1)
            out.append(c + inner.strip())
        elif c == "{":
            inner, i = group(text, i)
            out.append(plain(inner))
        elif c == "$":
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def format_math(text: str | None) -> str | None:
    if text is None or not any(c in text for c in "\\$^_{}"):
        return text
    spaced = re.sub(r"[ \t]+", " ", plain(text))
    return re.sub(r"\s+\)", ")", re.sub(r"\(\s+", "(", spaced)).strip(" ")


@F.pandas_udf(T.StringType())
def format_math_column(texts: pd.Series) -> pd.Series:
    return texts.map(format_math)
