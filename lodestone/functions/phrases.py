"""Many phrases against many texts in one pass: Aho-Corasick machines in the tasks.

``ahocorasick`` (pyahocorasick) compiles a list once a task; a text is then read once, however long the list is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def machine(needles: dict[str, object]):
    """An automaton of the needles (not empty) and their values; None without any."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for needle, value in needles.items():
        made.add_word(needle, value)
    if not needles:
        return None
    made.make_automaton()
    return made


class Replacer:
    """Whole-word replacements (phrase, term), one after another in the list's order, whatever their case.

    The machine tells which phrases a text holds at all; only these are replaced. A replacement may make a later phrase, so
    the text is read again after each; earlier ones don't come again. So the result is that of trying every phrase in turn.
    """

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = [(re.compile(rf"\b{re.escape(p)}\b", re.IGNORECASE), t) for p, t in pairs]
        numbers: dict[str, list[int]] = {}
        for i, (phrase, _) in enumerate(pairs):
            numbers.setdefault(phrase.casefold(), []).append(i)
        self.always = numbers.pop("", [])
        self.machine = machine(numbers)

    def _next(self, text: str, least: int) -> int | None:
        held = self.machine.iter(text.casefold()) if self.machine else ()
        found = [i for _, numbers in held for i in numbers if i >= least] + [i for i in self.always if i >= least]
        return min(found, default=None)

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        at = self._next(text, 0)
        while at is not None:
            pattern, term = self.pairs[at]
            text = pattern.sub(lambda _: term, text)  # noqa: B023
            at = self._next(text, at + 1)
        return text


def replace_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """``Replacer`` over a text column; null stays null."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replacer = Replacer(pairs)
        for batch in texts:
            yield batch.map(replacer)

    return run(text)
