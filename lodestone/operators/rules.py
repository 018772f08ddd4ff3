"""Batch matching of queries against a table of rules.

rules: rule_id, topic, parameter, trigger_terms array<string>, ... . Gates and parameter
tokens are tables of their own, (topic, term) rows, so users append to them:

* context: a topic listed here needs one of its terms in the original query;
* anchors: a topic listed here needs one of its terms in the combined text;
* excludes: any hit drops the topic;
* tokens (topic, parameter, term): topics with several parameters; each hit adds ``BONUS``.

Every term becomes a plain substring of a text that is padded with spaces; an automaton of all tables' terms finds
them in one pass over the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phrases import machine
from ..functions.text import is_whole_word, normalise, padded

BONUS, LEAST = 2, 2


@dataclass
class Gates:
    context: DataFrame
    anchors: DataFrame
    excludes: DataFrame
    tokens: DataFrame
    #: Topics whose ties without any parameter token fall back to a parameter.
    defaults: dict[str, str]


def needle(term: Column) -> Column:
    """The substring to look for in a padded text; empty terms become null."""
    normal = normalise(term)
    return F.when(normal == "", F.lit(None)).when(is_whole_word(term), padded(normal)).otherwise(normal)


def texts(queries: DataFrame) -> DataFrame:
    """queries (query_id, query, query_en) -> query_id, combined and original padded texts."""
    combined = normalise(F.concat_ws(" ", F.coalesce("query", F.lit("")), F.coalesce("query_en", F.lit(""))))
    original = F.when(F.trim(F.coalesce("query", F.lit(""))) != "", normalise(F.col("query"))).otherwise(combined)
    return queries.select("query_id", padded(combined).alias("combined"), padded(original).alias("original"))


#: Rows of a table of terms or rules up to which it is broadcast; beyond, the same joins are shuffled.
BROADCAST_ROWS = 100_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: Terms of one machine; more are dealt to several, each a further pass over the texts.
MACHINE_TERMS = 100_000


def tagged_hits(queries: DataFrame, gates: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(query_id, gate, key) of several term tables (terms, text column, keys) in one pass over the texts, a row a term that occurs.

    All terms are one automaton in the tasks: texts stay where they are and are read once. ``key`` holds the key columns as JSON.
    """
    tagged = None
    for name, (terms, column, keys) in gates.items():
        part = terms.select(F.lit(name).alias("gate"), F.lit(column == "original").alias("own"), F.to_json(F.struct(*keys)).alias("key"), needle(F.col("term")).alias("needle")).where("needle IS NOT NULL")
        tagged = part if tagged is None else tagged.unionByName(part)
    sides = {c for _, c, _ in gates.values()}
    texts_of = queries.select("query_id", *[F.col(c) if c in sides else F.lit(None).cast("string").alias(c) for c in ("combined", "original")])
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, gate string, key string"
    blocks, out = max(1, -(-tagged.count() // MACHINE_TERMS)), None
    for b in range(blocks):
        terms = tagged.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()  # about MACHINE_TERMS rows
        part = texts_of.mapInArrow(_scan([tuple(t) for t in terms]), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(terms: list[tuple[str, bool, str, str]]):
    """Batches of (query_id, combined, original) -> (query_id, gate, key) of the terms (gate, own, key, needle) in them."""

    def run(batches):
        machines = {}
        for column, own in (("combined", False), ("original", True)):
            needles: dict[str, list] = {}
            for gate, of, key, text in terms:
                if of == own:
                    needles.setdefault(text, []).append((gate, key))
            machines[column] = machine({n: (n, tags) for n, tags in needles.items()})
        for batch in batches:
            at, gates, keys = [], [], []
            for column, made in machines.items():
                if made is None:
                    continue
                for i, text in enumerate(batch.column(column).to_pylist()):
                    for tags in dict(value for _, value in made.iter(text or "")).values():
                        for gate, key in tags:
                            at.append(i)
                            gates.append(gate)
                            keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at, pa.int64())), pa.array(gates, pa.string()), pa.array(keys, pa.string())], names=["query_id", "gate", "key"])

    return run


def hits(queries: DataFrame, terms: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(query_id, keys) of the terms (keys, term) that occur in each query's text, a row a term."""
    schema = ", ".join(f"`{k}` {terms.schema[k].dataType.simpleString()}" for k in keys)
    return tagged_hits(queries, {"terms": (terms, column, keys)}).select("query_id", F.from_json("key", schema).alias("k")).select("query_id", "k.*")


def match_rules(queries: DataFrame, rules: DataFrame, gates: Gates, least: int = LEAST) -> DataFrame:
    """Best rule of each query: query_id, rule_id, topic, parameter, matched, base, bonus, total.

    Queries whose best total is shared, or whose best rule lacks the parameter token it
    needs, get no row. All hits of a query come together once; everything after that is grouped within its partition.
    """
    triggers = rules.select("rule_id", "topic", F.posexplode("trigger_terms").alias("at", "term"))
    # parameter tokens: a rule without a parameter takes those of all parameters of its topic
    own = rules.select("rule_id", "topic", "parameter")
    wanted = own.join(gates.tokens.withColumnRenamed("parameter", "of"), "topic").where(F.col("parameter").isNull() | (F.col("parameter") == F.col("of")))
    info = rules.select("rule_id", "topic", "parameter", "rule_pos", "trigger_terms")
    for name, gate in (("bound", gates.context), ("anchored", gates.anchors), ("multi", gates.tokens)):
        info = info.join(gate.select("topic").distinct().withColumn(name, F.lit(True)), "topic", "left")
    found = tagged_hits(
        texts(queries),
        {
            "trigger": (triggers, "combined", ["rule_id", "topic", "at"]),
            "token": (wanted, "combined", ["rule_id", "topic"]),
            "context": (gates.context, "original", ["topic"]),
            "anchor": (gates.anchors, "combined", ["topic"]),
            "exclude": (gates.excludes, "combined", ["topic"]),
        },
    )
    key = F.from_json("key", f"rule_id {rules.schema['rule_id'].dataType.simpleString()}, topic string, at int")
    gate = lambda name: F.collect_set(F.when(F.col("gate") == name, F.col("k.topic"))).alias(name)
    scores = F.collect_list(F.when(F.col("gate").isin("trigger", "token"), F.struct(F.col("k.rule_id").alias("rule_id"), F.col("k.at").alias("at"))))
    by_query = found.withColumn("k", key).groupBy("query_id").agg(gate("context"), gate("anchor"), gate("exclude"), scores.alias("hits"))
    each = by_query.select("query_id", "context", "anchor", "exclude", F.explode("hits").alias("h")).select("query_id", "context", "anchor", "exclude", "h.*")
    scored = (
        each.groupBy("query_id", "rule_id")
        .agg(F.array_sort(F.collect_list("at")).alias("matched"), (F.count(F.when(F.col("at").isNull(), 1)) * BONUS).alias("bonus"), *[F.first(g).alias(g) for g in ("context", "anchor", "exclude")])
        .withColumn("base", F.size("matched"))
        .withColumn("total", F.col("base") + F.col("bonus"))
        .where(F.col("total") >= least)
        .join(_small(info), "rule_id")
    )
    passes = lambda needs, gate: F.col(needs).isNull() | F.array_contains(gate, F.col("topic"))
    named = scored.where(passes("bound", "context") & passes("anchored", "anchor") & ~F.array_contains("exclude", F.col("topic")))
    by_query = Window.partitionBy("query_id")
    first = by_query.orderBy(F.desc("total"), "rule_pos")
    named = named.withColumns({"n": F.row_number().over(first), "first_topic": F.first("topic").over(first), "best": F.max("total").over(by_query), "bonuses": F.sum("bonus").over(by_query)})
    named = named.withColumn("tied", F.count(F.when(F.col("total") == F.col("best"), 1)).over(by_query) > 1)
    # a tie without any parameter token may fall back to the topic's default parameter
    preferred, may = F.lit(1), F.lit(False)
    for topic, parameter in gates.defaults.items():
        may = may | (F.col("first_topic") == topic)
        preferred = F.when((F.col("first_topic") == topic) & (F.col("parameter") == parameter), 0).otherwise(preferred)
    named = named.withColumn("fallback", F.row_number().over(by_query.orderBy(preferred, F.coalesce("parameter", F.lit("")), "rule_pos")))
    lacks = F.coalesce("multi", F.lit(False)) & (F.col("bonus") == 0) & F.col("parameter").isNotNull()
    chosen = named.where(F.when(F.col("tied"), may & (F.col("bonuses") == 0) & (F.col("fallback") == 1)).otherwise((F.col("n") == 1) & ~lacks))
    return chosen.select("query_id", "rule_id", "topic", "parameter", F.transform("matched", lambda i: F.get("trigger_terms", i)).alias("matched"), "base", "bonus", "total")


def aspects(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (aspect, term) -> (query_id, aspects): the sorted aspects each query speaks of."""
    return hits(texts(queries), terms, "combined", ["aspect"]).groupBy("query_id").agg(F.sort_array(F.collect_set("aspect")).alias("aspects"))


#: Topics that only hold for one kind of ship or state, and the terms of which the original question needs one.
REQUIRED_CONTEXT = {
    "supply_bulwark_plating_thickness": ["supply vessel", "supply vessels", "kapal suplai"],
    "dredger_bottom_transverse_spacing_aground": ["aground", "kandas"],
}


def precision(matches: DataFrame, queries: DataFrame, aspect_terms: DataFrame, expected: DataFrame, excluded: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """matches (query_id, topic) -> ok and reason. expected, excluded: (topic, aspects array); required: (topic, term), ``REQUIRED_CONTEXT`` if not given.

    A required term must stand in the original question; a blank original has none.
    """
    if required is None:
        required = matches.sparkSession.createDataFrame([(t, w) for t, ws in REQUIRED_CONTEXT.items() for w in ws], "topic string, term string")
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    context = hits(texts(asked), required, "original", ["topic"]).distinct().withColumn("context", F.lit(True))
    matches = matches.join(required.select("topic").distinct().withColumn("bound", F.lit(True)), "topic", "left").join(context, ["query_id", "topic"], "left")
    found = aspects(queries, aspect_terms)
    none = F.array().cast("array<string>")
    joined = (
        matches.join(found, "query_id", "left")
        .join(_small(expected.withColumnRenamed("aspects", "expected")), "topic", "left")
        .join(_small(excluded.withColumnRenamed("aspects", "excluded")), "topic", "left")
    )
    seen = F.coalesce("aspects", none)
    bad = F.array_intersect(seen, F.coalesce("excluded", none))
    reason = (
        F.when(F.col("bound") & F.col("context").isNull(), F.concat(F.lit("missing_required_context:"), "topic"))
        .when(F.col("expected").isNull(), "ok")
        .when(F.size(bad) > 0, F.concat(F.lit("excluded_aspect:"), F.array_join(F.sort_array(bad), ",")))
        .when(F.size(F.array_intersect(seen, "expected")) == 0, F.concat(F.lit("missing_aspect:"), F.array_join(F.sort_array("expected"), ",")))
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok").drop("aspects", "expected", "excluded", "bound", "context")


def localised(language: Column, en: Column, local: Column, plain: Column) -> Column:
    """Text in the asked language, else the other, else the plain one; empty counts as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.when(language == "en", F.coalesce(some(en), some(local), plain)).otherwise(F.coalesce(some(local), some(en), plain))


def evidence(language: Column, body: Column, cite: Column, quote: Column) -> Column:
    """A rule's text for an answer, its citation and its verbatim quote."""
    label = F.when(language == "en", "Source quote").otherwise("Kutipan sumber")
    return F.concat(F.regexp_replace(body, r"\.+$", ""), F.lit(" "), cite, F.lit(".\n"), label, F.lit(': "'), quote, F.lit('"'))


def validated(rules: DataFrame) -> DataFrame:
    """rules, or an error at run time for a row without topic, text, section or trigger terms."""
    bad = F.coalesce(F.trim("topic") == "", F.lit(True)) | F.coalesce(F.trim("value_text") == "", F.lit(True)) | F.col("section_no").isNull() | (F.coalesce(F.size("trigger_terms"), F.lit(0)) < 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("rule is incomplete: "), F.coalesce(F.col("rule_id").cast("string"), F.lit("null"))))).otherwise(F.col("topic"))
    return rules.withColumn("topic", checked)
