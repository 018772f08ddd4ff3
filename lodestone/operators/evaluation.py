"""Grading of answers and summaries of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable_answer
from .analysis import bind


def category(entry: dict[str, Column]) -> Column:
    """Category of an entry from its flags; the first that is set decides."""
    flag = lambda name: F.coalesce(entry[name], F.lit(False))
    return (
        F.when(flag("has_turns"), "multi_turn")
        .when(flag("has_result"), "calc-value")
        .when(flag("expect_error"), "calc-error")
        .when(flag("expect_clarification"), "calc-clarify")
        .when(flag("should_reject"), "guardrail")
        .when(flag("expect_no_lookup"), "lookup_negative")
        .when(flag("expect_lookup"), "lookup")
        .otherwise("rules_qa")
    )


def _strings(words: Column) -> Column:
    return F.coalesce(words, F.array().cast("array<string>"))


def _groups(groups: Column) -> Column:
    return F.coalesce(groups, F.array().cast("array<array<string>>"))


def _holds(plain: Column, word: Column) -> Column:
    return plain.contains(comparable_answer(word))


def includes_all(plain: Column, wanted: Column) -> Column:
    """Whether a text made by ``comparable_answer`` holds all words."""
    return F.forall(_strings(wanted), lambda w: _holds(plain, w))


def includes_any_of_each(plain: Column, groups: Column) -> Column:
    return F.forall(_groups(groups), lambda g: F.exists(g, lambda w: _holds(plain, w)))


def includes_none(plain: Column, banned: Column) -> Column:
    return ~F.exists(_strings(banned), lambda w: _holds(plain, w))


def grade_answer(rows: DataFrame) -> DataFrame:
    """rows (answer, language, lang, sections, expected_sections, must_include, any_groups, must_not)
    -> language_ok, keywords_ok, section_ok, passed."""
    none = F.array().cast("array<int>")
    expected = F.coalesce("expected_sections", none)
    section = (F.size(expected) == 0) | F.arrays_overlap(expected, F.coalesce("sections", none))
    # a column of its own, used several times: the optimizer computes it once
    graded = rows.withColumn("__plain", comparable_answer(F.col("answer"))).withColumns(
        {
            "language_ok": F.coalesce(F.col("language") == F.col("lang"), F.lit(False)),
            "keywords_ok": includes_all(F.col("__plain"), F.col("must_include")) & includes_any_of_each(F.col("__plain"), F.col("any_groups")) & includes_none(F.col("__plain"), F.col("must_not")),
            "section_ok": section,
        }
    )
    return graded.drop("__plain").withColumn("passed", F.col("language_ok") & F.col("keywords_ok") & F.col("section_ok"))


def grade_number(value: Column, unit: Column, expected: Column, expected_unit: Column, tolerance: Column) -> Column:
    """A number within the tolerance and the same unit."""
    return F.coalesce((F.abs(value - expected) <= F.coalesce(tolerance, F.lit(0.01))) & (F.lower(unit) == F.lower(expected_unit)), F.lit(False))


def stated_number(answer: Column) -> Column:
    """struct(value, unit) of a ``Result: x unit`` line, decimal comma or point."""
    pattern = r"(?i)Result:\s*([0-9]+(?:[.,][0-9]+)?)\s*(\w+)"
    return F.struct(F.replace(F.regexp_extract(answer, pattern, 1), F.lit(","), F.lit(".")).try_cast("double").alias("value"), F.nullif(F.regexp_extract(answer, pattern, 2), F.lit("")).alias("unit"))


def grade_guardrail(rejected: Column) -> Column:
    """A guardrail entry passes if it was rejected; null counts as not rejected."""
    return F.coalesce(rejected, F.lit(False))


def _missing(answer: Column, wanted: Column, label: str) -> Column:
    """``label:word`` of the wanted words that the answer lacks."""
    lacking = bind(comparable_answer(F.coalesce(answer, F.lit(""))), lambda plain: F.filter(_strings(wanted), lambda w: ~_holds(plain, w)))
    return F.transform(lacking, lambda w: F.concat(F.lit(f"{label}:"), w))


def _lacking_groups(answer: Column, groups: Column) -> Column:
    """``none of:a|b`` of the groups of which the answer holds no word."""
    lacking = bind(comparable_answer(F.coalesce(answer, F.lit(""))), lambda plain: F.filter(_groups(groups), lambda g: ~F.exists(g, lambda w: _holds(plain, w))))
    return F.transform(lacking, lambda g: F.concat(F.lit("none of:"), F.array_join(g, "|")))


def _present(answer: Column, banned: Column) -> Column:
    found = bind(comparable_answer(F.coalesce(answer, F.lit(""))), lambda plain: F.filter(_strings(banned), lambda w: _holds(plain, w)))
    return F.transform(found, lambda w: F.concat(F.lit("forbidden:"), w))


def _if(condition: Column, label: Column) -> Column:
    return F.when(condition, F.array(label)).otherwise(F.array().cast("array<string>"))


def grade_lookup(rows: DataFrame) -> DataFrame:
    """rows (answer, language, lang, must_include, any_groups, must_not, lookup_topic) -> failures, passed, fired.

    The answer decides; whether the lookup fired is told apart, for its rate.
    """
    failures = F.concat(
        _if(~F.col("language").eqNullSafe(F.col("lang")), F.lit("language")),
        _missing(F.col("answer"), F.col("must_include"), "missing"),
        _lacking_groups(F.col("answer"), F.col("any_groups")),
        _present(F.col("answer"), F.col("must_not")),
    )
    return rows.withColumn("failures", failures).withColumns({"passed": F.size("failures") == 0, "fired": F.col("lookup_topic").isNotNull()})


# Openings of answers that refuse for lack of context; the second one in any case.
REFUSAL_ID, REFUSAL_EN = "Konteks yang tersedia tidak cukup", "context is insufficient"


def grade_lookup_negative(rows: DataFrame) -> DataFrame:
    """rows (answer, lookup_topic, sections, expected_sections, must_include_any, must_not) -> failures, passed.

    No rule may fire. With expected sections (strict) one of them must be retrieved and the answer may not refuse.
    """
    answer, no_ints = F.coalesce("answer", F.lit("")), F.array().cast("array<int>")
    expected, any_of = F.coalesce("expected_sections", no_ints), _strings(F.col("must_include_any"))
    strict = F.size(expected) > 0
    refused = answer.contains(REFUSAL_ID) | F.lower(answer).contains(REFUSAL_EN)
    failures = F.concat(
        _if(F.col("lookup_topic").isNotNull(), F.concat(F.lit("fired:"), F.coalesce("lookup_topic", F.lit("")))),
        _if(strict & ~F.arrays_overlap(expected, F.coalesce("sections", no_ints)), F.lit("sections")),
        _if(strict & refused, F.lit("refused")),
        _lacking_groups(answer, F.filter(F.array(any_of), lambda g: F.size(g) > 0)),
        _present(answer, F.col("must_not")),
    )
    return rows.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def with_history(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, question, answer) with ``history``: the messages of all earlier turns; a missing answer adds none."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    said = F.filter(F.array(message("user", F.col("question")), message("assistant", F.nullif(F.col("answer"), F.lit("")))), lambda m: m["text"].isNotNull())
    return turns.withColumn("__said", said).withColumn("history", F.flatten(F.collect_list("__said").over(before))).drop("__said")


def grade_turns(turns: DataFrame) -> DataFrame:
    """Turns graded as single answers; the condensed question ``en_query`` must hold the words of ``en_query_contains``."""
    graded = grade_answer(turns)
    condensed = _missing(F.col("en_query"), F.col("en_query_contains"), "en_query")
    return graded.withColumn("en_query_ok", F.size(condensed) == 0).withColumn("passed", F.coalesce(F.col("passed"), F.lit(False)) & F.col("en_query_ok"))


def multi_turn(graded_turns: DataFrame) -> DataFrame:
    """A conversation passes if all its turns do; ``failed`` lists the turns that don't, in order."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("turn"))))
    return graded_turns.groupBy("conv_id").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("turns"), failed.alias("failed"))


def summary(graded: DataFrame, by: str = "category") -> DataFrame:
    """Passed, total, rate in percent and mean seconds by category."""
    passed = F.sum(F.col("passed").cast("int"))
    return graded.groupBy(by).agg(passed.alias("passed"), F.count(F.lit(1)).alias("total"), F.round(100.0 * passed / F.count(F.lit(1)), 1).alias("rate"), F.round(F.avg("elapsed"), 3).alias("mean_seconds"))


def rates(graded: DataFrame, flags: list[str]) -> DataFrame:
    """Overall share of each flag in percent, in one pass."""
    share = lambda c: F.round(100.0 * F.avg(F.col(c).cast("int")), 1).alias(c)
    return graded.agg(F.count(F.lit(1)).alias("total"), *[share(c) for c in flags])


def duplicates(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def composition(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of each column, in one pass over the entries."""
    long = entries.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
