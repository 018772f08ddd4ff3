"""Operator 3: toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, clause end, other. Five
transducers read them, each a table of (state, symbol) -> (state, symbol), in a cascade: the output of one is the
input of the next.

* negation marks insults and threats up to ``NEGATION_SCOPE`` words after a negation;
* reported speech marks those after a verb of saying or a quotation mark, until the clause ends;
* target marks those up to ``TARGET_SCOPE`` words after a person is addressed or named;
* threat matches a threat with its target, before or after it (within that scope);
* insult matches an insult with its target, before or after it, and an insult within ``PAIR_SCOPE`` words of the one before it: in the same
  clause, or up to ``PAIR_CLAUSES`` clauses on (a harangue). So insults that stand alone, however many, match nothing.

The cascade is composed to one machine over tuples of states, whose table is filled as states are met. A
single insult or threat without any of these patterns matches nothing and scores nothing, whatever the word.
A match is (pattern, negated, reported) and has a weight; a clause scores the sum of its matches, and
a logistic function of the matches of all clauses gives the document's score.

Learning, on at most about ``SAMPLE`` labelled rows whose crc32(doc_id) mod 5 is not 0, dealt by a
hash of the id; only the text is an input. The words that are insults (whole words, or word beginnings that stand for all words
they begin) are those far likelier in toxic texts, and in at least ``LEAST_ROWS`` and the share ``LEAST_SHARE`` of these; copies of a text count once; they carry no weights. The weights belong
to the matches of the grammar, at most ``len(NAMES)`` of them, and are fitted by logistic regression, from 0 up and near those of ``DEFAULT`` where texts show few such matches;
a pattern's negated or reported matches never weigh more than its plain ones.

Plan: the labelled sample is bounded by its parameter, so it is broadcast to find its
texts; the word beginnings are counted in the tasks and summed in one aggregation. The grammar
(``LEXICON`` entries at most) goes to the tasks, and documents are scored in one pass
without a shuffle.

Edge cases: null and empty texts score as texts without matches; null doc_ids are scored and, as the remainder of the empty text is 0, never learnt from; repeated rows each come
back; conflicting labels of an id count as toxic; null labels teach nothing; without
labels of both kinds only the fixed word lists below and default weights are used; an
empty table gives an empty result; very long texts are read whole; other columns pass through (one named __score is replaced).
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE, LEXICON, LEAST_ODDS, LEAST_ROWS, LEAST_SHARE = 20_000, 400, 2.0, 5, 0.005
NEGATION_SCOPE, TARGET_SCOPE = 3, 6
#: A second insult counts with the one before within so many words, and so many clauses on.
PAIR_SCOPE, PAIR_CLAUSES = 64, 4
PREFIXES = (4, 5, 6, 7, 8)
CACHE = 100_000

# Word lists of the grammar.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting dumb fool jerk garbage vermin".split()
THREATS = "kill hurt destroy shoot stab murder strangle".split()
TARGETS = "you your youre he she they him them his her their du dich dein ihr sie er tu te toi vous votre il elle usted ustedes tú él ella".split()
NEGATIONS = "not no never nobody isnt arent nicht kein keine nie pas jamais aucun nunca jamás ni".split()
REPORTING = "said says told claimed claims wrote quoted called alleged sagte sagt schrieb behauptet dit déclaré affirme dijo dice escribió afirma".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, END, OTHER = range(7)
#: A symbol is (kind, negated, reported, targeted, matches); a match is (pattern, negated, reported).
PATTERNS = ("insult with target", "threat with target", "insults in a clause", "harangue")
AT_TARGET, THREATENED, REPEATED, HARANGUE = range(4)
NAMES = [f"{p}, {n}{r}" for p in PATTERNS for n in ("plain", "negated") for r in ("", " reported")] + ["clauses", "strongest clause", "density"]
#: Weights of matches inside a clause: by pattern, and their factors if negated and if reported.
WEIGHTS, NEGATED, REPORTED = (1.5, 2.0, 1.0, 0.5), 0.3, 0.5
#: Used without labels: intercept, then a weight for each of NAMES.
DEFAULT = np.array([-3.0] + [w * f for w in (1.5, 2.0, 1.0, 0.5) for f in (1, 0.5, 0.3, 0.15)] + [0.5, 1.0, 0.0])

_PARTS = re.compile(r"[^\W\d_]+|[.!?;:\"“”«»]").findall


def chunks(text: str | None) -> list[str]:
    return (text or "").lower().replace("\n", " . ").split()


def entries(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def symbol(kind: int) -> tuple:
    return kind, False, False, False, ()


class Scope:
    """Transducer: marks insults and threats up to ``scope`` words after a symbol of ``opener``; a clause's end closes it.

    Its states are how many words the scope still holds.
    """

    start = 0

    def __init__(self, opener: int, field: int, scope: int):
        self.opener, self.field, self.scope = opener, field, scope

    def step(self, state: int, sign: tuple) -> tuple:
        kind = sign[0]
        if state and kind in (INSULT, THREAT):
            sign = (*sign[: self.field], True, *sign[self.field + 1 :])
        if kind == self.opener:
            return self.scope, sign
        return (0 if kind == END else max(0, state - 1)), sign


class Speech:
    """Transducer: marks insults and threats of reported speech. States: whether the clause reports."""

    start = False

    def step(self, state: bool, sign: tuple) -> tuple:
        kind = sign[0]
        if state and kind in (INSULT, THREAT):
            sign = (*sign[:2], True, *sign[3:])
        return (kind == REPORT or state and kind != END), sign


class Threats:
    """Transducer: adds the match of a threat with a target. States: None, or (words left, negated, reported) of a threat that waits for one."""

    start = None

    def step(self, state, sign: tuple) -> tuple:
        kind, negated, reported, targeted, matches = sign
        if kind == THREAT and targeted:
            return state and _later(state), (*sign[:4], (*matches, (THREATENED, negated, reported)))
        if kind == THREAT:
            return (TARGET_SCOPE, negated, reported), sign
        if kind == TARGET and state:
            return None, (*sign[:4], (*matches, (THREATENED, *state[1:])))
        return (None if kind == END else state and _later(state)), sign


class Insults:
    """Transducer: adds the matches of insults. States: (words for which the last insult counts, clauses ended since, an insult that waits for its target)."""

    start = (0, 0, None)

    def step(self, state, sign: tuple) -> tuple:
        left, ended, waits = state
        kind, negated, reported, targeted, matches = sign
        near, left, waits_on = left > 0, max(0, left - 1), waits and _later(waits)
        if kind == INSULT:
            if targeted or near:
                pattern = AT_TARGET if targeted else HARANGUE if ended else REPEATED
                return (PAIR_SCOPE, 0, waits_on), (*sign[:4], (*matches, (pattern, negated, reported)))
            return (PAIR_SCOPE, 0, (TARGET_SCOPE, negated, reported)), sign
        if kind == TARGET and waits:
            return (left, ended, None), (*sign[:4], (*matches, (AT_TARGET, *waits[1:])))
        if kind == END:
            ended += bool(left)
            return ((left, ended) if ended <= PAIR_CLAUSES else (0, 0)) + (None,), sign
        return (left, ended if left else 0, waits_on), sign


def _later(waits: tuple):
    return (waits[0] - 1, *waits[1:]) if waits[0] > 1 else None


CASCADE = (Scope(NEGATION, 1, NEGATION_SCOPE), Speech(), Scope(TARGET, 3, TARGET_SCOPE), Threats(), Insults())


def in_sequence(kinds: list[int]) -> list[tuple]:
    """The matches at each symbol, by running each transducer over the whole string of the one before."""
    string = [symbol(k) for k in kinds]
    for transducer in CASCADE:
        state, out = transducer.start, []
        for sign in string:
            state, sign = transducer.step(state, sign)
            out.append(sign)
        string = out
    return [sign[4] for sign in string]


class Composed:
    """The cascade as one machine: ``table[state][kind]`` is (next state, matches), a number and a tuple, made at first use."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table: list[list] = []
        self.skips: list[list] = []
        self.start = self._number(tuple(t.start for t in CASCADE))

    def _number(self, states: tuple) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.states)
            self.states.append(states)
            self.table.append([None] * 7)
            self.skips.append([len(self.states) - 1])
        return self.numbers[states]

    def step(self, state: int, kind: int) -> tuple:
        found = self.table[state][kind]
        if found is None:
            sign, after = symbol(kind), []
            for transducer, at in zip(CASCADE, self.states[state]):
                at, sign = transducer.step(at, sign)
                after.append(at)
            found = self.table[state][kind] = self._number(tuple(after)), sign[4]
        return found

    def skip(self, state: int, words: int) -> int:
        """The state after so many other words: all scopes have ended after the longest."""
        words, after = min(words, max(NEGATION_SCOPE, TARGET_SCOPE, PAIR_SCOPE) + 1), self.skips[state]
        while len(after) <= words:
            after.append(self.step(after[-1], OTHER)[0])
        return after[words]


class Grammar(dict):
    """Chunk of text -> its symbols other than plain words, as a bounded cache."""

    def __init__(self, lexicon: set[str]):
        self.lexicon = {"=" + w for w in INSULTS} | set(lexicon)
        self.fixed = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING), (THREAT, THREATS)) for w in words}
        self.machine = Composed()

    def __missing__(self, chunk: str):
        if len(self) >= CACHE:
            self.clear()
        found, parts = [], _PARTS(chunk.replace("'", "").replace("’", ""))
        for word in parts:
            if word in ".!?;:":
                found.append(END)
            elif word in "\"“”«»":
                found.append(REPORT)
            elif not self.lexicon.isdisjoint(entries(word)):
                found.append(INSULT)
            elif word in self.fixed:
                found.append(self.fixed[word])
        self[chunk] = out = tuple(found)
        return out

    def clauses(self, text: str | None) -> list[list[tuple]]:
        """The matches of each clause that has any."""
        machine, state, last, out, now = self.machine, self.machine.start, -1, [], []
        step, skip = machine.step, machine.skip
        for i, symbols in enumerate(map(self.__getitem__, chunks(text))):
            if symbols:
                if i - last > 1:
                    state = skip(state, i - last - 1)
                last = i
                for kind in symbols:
                    state, matches = step(state, kind)
                    now += matches
                    if kind == END and now:
                        out.append(now)
                        now = []
        return [*out, now] if now else out

    def features(self, text: str | None) -> list[float]:
        """The composed machine's matches in a text, summed up as NAMES."""
        clauses = self.clauses(text)
        counts, scores = [0] * (4 * len(PATTERNS)), []
        for clause in clauses:
            score = 0.0
            for pattern, negated, reported in clause:
                counts[4 * pattern + 2 * negated + reported] += 1
                score += WEIGHTS[pattern] * (NEGATED if negated else 1) * (REPORTED if reported else 1)
            scores.append(score)
        words = len(chunks(text)) if clauses else 0
        return [*np.log1p(counts), float(np.log1p(len(scores))), max(scores, default=0.0), sum(scores) / (1 + words) ** 0.5]


class Model:
    def __init__(self, lexicon: set[str], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept and the weights.

    No weight falls below 0: no match speaks for a text. The ridge draws them to ``prior``, so that
    matches the rows hardly show keep about its weights.
    """
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    penalty, to = np.array([1e-6] + [ridge] * x.shape[1]), np.concatenate(([0.0], prior[1:] * std))
    w = to.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - penalty * (w - to)
        free = (w > 0) | (slope > 0)
        free[0] = True
        some = z[:, free]
        step = np.linalg.solve((some * (p * (1 - p))[:, None]).T @ some + np.diag(penalty[free]), slope[free])
        before = w.copy()
        w[free] += step * min(1.0, 5 / np.abs(step).max())
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(w - before).max() < 1e-6:
            break
    inner = w[1:] / std
    return np.concatenate(([w[0] - inner @ mean], inner))


def bounds() -> np.ndarray:
    """Weights as sums of free ones: a pattern's plain weight is at least those of its negated and reported matches."""
    out = np.eye(len(NAMES))
    for p in range(len(PATTERNS)):
        out[4 * p, 4 * p + 1 : 4 * p + 4] = 1
    return out


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The intercept and the weights of NAMES, near those of ``DEFAULT``."""
    shape = bounds()
    free = logistic(x @ shape, y, np.concatenate((DEFAULT[:1], np.linalg.solve(shape, DEFAULT[1:]))))
    return np.concatenate((free[:1], shape @ free[1:]))


def remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The different texts, with y, of a bounded sample of the rows that may be learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * sample)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("y").alias("y"))


def fewest(found: set[str]) -> set[str]:
    """Without the words and beginnings that a shorter beginning stands for."""
    return {e for e in found if not any("^" + e[1 : 1 + n] in found for n in PREFIXES if n < len(e) - (e[0] == "^"))}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    rows = cut(labelled(docs, labels, sample))

    def count(batches):
        held: Counter = Counter()

        def out():
            return pd.DataFrame([(e, n if y else 0, 0 if y else n) for (e, y), n in held.items()], columns=["entry", "bad", "good"])

        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                words = {w for c in set(chunks(text)) for w in _PARTS(c)}
                held.update((e, y) for e in {e for w in words if len(w) > 2 for e in entries(w)})
                if len(held) > CACHE:
                    yield out()
                    held.clear()
        yield out()

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model(set(), DEFAULT)
    counts = rows.mapInPandas(count, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 2.0) / (good + 1))
    least = max(LEAST_ROWS, LEAST_SHARE * bad)
    top = counts.where(F.col("bad") >= least).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), F.desc("bad"), "entry").limit(lexicon)
    found = fewest({r["entry"] for r in top.collect()})

    def describe(batches):
        grammar = Grammar(found)
        for batch in batches:
            yield pd.DataFrame({"f": [grammar.features(t) for t in batch["text"]], "y": batch["y"]})

    told = rows.mapInPandas(describe, "f array<double>, y int").collect()
    return Model(found, fitted(np.array([r["f"] for r in told]), np.array([r["y"] for r in told], dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` (with ``text``), and __score."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(model.lexicon)
        for batch in texts:
            yield pd.Series(model.scores(np.array([grammar.features(t) for t in batch])) if len(batch) else [], dtype="float64")

    return docs.withColumn("__score", scored("text"))
