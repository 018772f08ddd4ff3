"""Operator 8 [native]: raking token weights to source, language and topic marginals.

Documents are summed to cells (source, language, topic). Iterative proportional
fitting scales the cells' weights to the target share of each source, then language, then topic, and
again, until the weighted token shares meet all three marginals. A document's chance is its
cell's weight, calibrated so that ``keep`` of all tokens are drawn. The draw is a hash of the
document's id, so it repeats.

Targets are parameters: a table of shares for a dimension, or None for *tempered* shares: the measured share of
each category to the power ``temper``, rescaled. This takes from large categories and gives to
small ones by the same rule on any corpus. No chance can be above 1, so each round ends with
cutting weights there: a category that is to give more tokens than it has is kept whole, and what it lacks is
spread over the cells that have room. ``residuals`` reports target and reached share of every category;
``strict`` raises where a target names a category that has no tokens.

Categories are the ``named`` largest values of a dimension by tokens (or the names in its targets) and ``*``, all
others, null among them. So the cells are at most (named + 1) ** 3, a number fixed by
the parameters and not by the data. They are aggregated into one row and raked there with higher-order functions.

Topic: documents carry none, so it is a parameter; the default is a lexical rule on
the whole text (``web`` if it names a url or mail address, ``list`` if its lines are
short on average, else ``prose``).

Plan: one pass over the texts (``measure``) gives topic and tokens; all else runs on the narrow
columns, without a shuffle of documents. Two small aggregations follow, of (source, language, topic) sums.

Edge cases: a null source or language falls in ``*``; a category with target 0, or with no entry and no ``*`` in the
targets, is never drawn; targets of categories without tokens are left out and the others rescaled; documents
without tokens take their cell's chance, or 1 in a cell without any; a null doc_id is drawn as the id -1, so such rows
are drawn alike, and so are repeated rows; very long texts are read whole; an empty table gives an empty result; other columns pass
through, and names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Power of the measured shares, share of all tokens that is drawn, categories by name in a dimension, rounds of fitting.
TEMPER, KEEP, NAMED, ROUNDS = 0.7, 0.5, 32, 40
DIMS = ("s", "l", "t")


def n_tokens(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long")


def topic(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return (
        F.when(text.contains("://") | text.contains("@"), "web")
        .when(F.length(text) < 120 * lines, "list")
        .otherwise("prose")
    )


def measure(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """``docs`` with __topic and __tokens."""
    text = F.col("text")
    return docs.withColumns({"__topic": topic(text) if topic_of is None else topic_of, "__tokens": n_tokens(text)})


def targets_of(sums: DataFrame, dim: str, given: dict[str, float] | None, temper: float = TEMPER, named: int = NAMED) -> dict[str, float]:
    """Shares of the categories of a dimension, that of ``*`` among them. sums: s, l, t, tokens; at most ``named`` + 1 rows are read."""
    if given is not None:
        if any(x < 0 for x in given.values()) or not sum(given.values()) > 0:
            raise ValueError("target shares must be 0 or more, and one above 0")
        return {"*": 0.0} | {k: v / sum(given.values()) for k, v in given.items()}
    by = sums.groupBy(F.col(dim).alias("k")).agg(F.sum("tokens").alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 0
    largest = by.where("k is not null and k <> '*' and n > 0").orderBy(F.desc("n"), "k").limit(named).collect()
    tokens = {r["k"]: r["n"] for r in largest}
    tokens["*"] = total - sum(tokens.values())
    powers = {k: (n / total) ** temper if n else 0.0 for k, n in tokens.items()}
    return {k: x / (sum(powers.values()) or 1.0) for k, x in powers.items()}


def _group(value: Column, targets: dict) -> Column:
    named = sorted(k for k in targets if k != "*")
    return F.when(value.isin(named), value).otherwise(F.lit("*")) if named else F.lit("*")


def _array(items) -> str:
    return "array(" + ", ".join(items) + ")"


def _name(k: str) -> str:
    return "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scaled(dim: str, size: int, keep: float) -> str:
    """SQL for the cells after one dimension's weights are scaled to its targets."""
    mass = f"transform(sequence(1, {size}), i -> aggregate(st, 0D, (m, c) -> m + if(c.{dim} = i, c.n * c.w, 0D)))"
    factor = f"transform({mass}, (m, i) -> if(m > 0D, element_at(goal.{dim}, i + 1) * {keep!r}D / m, 0D))"
    fields = "'s', c.s, 'l', c.l, 't', c.t, 'n', c.n"
    return f"element_at(transform(array({factor}), f -> transform(st, c -> named_struct({fields}, 'w', c.w * element_at(f, c.{dim})))), 1)"


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], keep: float = KEEP, rounds: int = ROUNDS, strict: bool = False) -> DataFrame:
    """cells (s, l, t names; tokens) -> s, l, t, n (share of tokens), p (chance). targets: shares by dimension, with ``*``."""
    names = {d: sorted(targets[d]) for d in DIMS}
    place = {d: F.array_position(F.expr(_array(map(_name, names[d]))), F.col(d)).cast("int") for d in DIMS}
    one = cells.agg(
        F.array_sort(F.collect_list(F.struct(*[place[d].alias(d) for d in DIMS], F.col("tokens").cast("double").alias("n")))).alias("cells"),
        F.greatest(F.sum("tokens"), F.lit(1)).cast("double").alias("total"),
    ).withColumn("cells", F.expr("transform(cells, c -> named_struct('s', c.s, 'l', c.l, 't', c.t, 'n', c.n / total, 'w', 1D))"))
    for d in DIMS:
        shares = _array(f"{float(targets[d][k])!r}D" for k in names[d])
        held = f"transform({shares}, (x, i) -> if(exists(cells, c -> c.{d} = i + 1 AND c.n > 0D), x, 0D))"
        if strict:
            held = f"if(exists(zip_with({shares}, {held}, (x, y) -> x > 0D AND y = 0D), x -> x), raise_error('a target names a category without tokens'), {held})"
        one = one.withColumn(f"h_{d}", F.expr(held))
        one = one.withColumn(f"h_{d}", F.expr(f"transform(h_{d}, x -> x / greatest(aggregate(h_{d}, 0D, (t, y) -> t + y), 1e-300D))"))
    one = one.withColumn("goal", F.expr("named_struct('s', h_s, 'l', h_l, 't', h_t)"))
    # One round: each dimension in turn, on the weights the one before has left; then weights are cut at 1.
    body = "st"
    for d in DIMS:
        body = f"element_at(transform(array({body}), st -> {_scaled(d, len(names[d]), float(keep))}), 1)"
    body = f"transform({body}, c -> named_struct('s', c.s, 'l', c.l, 't', c.t, 'n', c.n, 'w', least(c.w, 1D)))"
    fitted = one.select(F.explode(F.expr(f"aggregate(sequence(1, {int(rounds)}), cells, (st, round_no) -> {body})")).alias("c"))
    named = [F.expr(f"element_at({_array(map(_name, names[d]))}, c.{d})").alias(d) for d in DIMS]
    return fitted.select(*named, F.col("c.n").alias("n"), F.when(F.col("c.n") > 0, F.col("c.w")).otherwise(F.lit(1.0)).alias("p"))


def draw(key: Column) -> Column:
    """A number in [0, 1) from a key, the same on every run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") / float(16**13)


def _chances(measured: DataFrame, sources, langs, topics, temper: float, keep: float, named: int, rounds: int, strict: bool):
    """(measured with __s, __l and __t; the chances of their cells; the targets)."""
    sums = cut(measured.groupBy(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("__topic").alias("t")).agg(F.sum("__tokens").alias("tokens")))
    targets = {d: targets_of(sums, d, given, temper, named) for d, given in zip(DIMS, (sources, langs, topics))}
    cells = sums.groupBy(*[_group(F.col(d), targets[d]).alias(d) for d in DIMS]).agg(F.sum("tokens").alias("tokens"))
    marked = measured.withColumns({f"__{d}": _group(F.col(c), targets[d]) for d, c in zip(DIMS, ("source", "lang", "__topic"))})
    return marked, cut(rake(cells, targets, keep, rounds, strict)), targets


def mix_measured(
    measured: DataFrame, sources: dict | None = None, langs: dict | None = None, topics: dict | None = None, temper: float = TEMPER, keep: float = KEEP, named: int = NAMED, rounds: int = ROUNDS, strict: bool = False
) -> DataFrame:
    """Every row of ``measured`` with __weight (its share of the draw over that of the input), __p and __sampled."""
    marked, chances, _ = _chances(measured, sources, langs, topics, temper, keep, named, rounds, strict)
    chances = chances.select(*[F.col(d).alias(f"__c_{d}") for d in DIMS], F.col("p").alias("__p"))  # at most (named + 1) ** 3 rows
    joined = marked.join(F.broadcast(chances), [F.col(f"__{d}") == F.col(f"__c_{d}") for d in DIMS], "left")
    drawn = draw(F.coalesce(F.col("doc_id"), F.lit(-1))) < F.col("__p")
    return joined.withColumns({"__weight": F.col("__p") / float(keep), "__sampled": drawn}).drop(*[f"__{d}" for d in DIMS], *[f"__c_{d}" for d in DIMS])


def mix(docs: DataFrame, sources: dict | None = None, langs: dict | None = None, topics: dict | None = None, topic_of: Column | None = None, **options) -> DataFrame:
    """Every row of ``docs`` with __topic, __tokens, __weight, __p and __sampled. None: tempered targets; options: those of ``mix_measured``."""
    return mix_measured(measure(docs, topic_of), sources, langs, topics, **options)


def residuals(docs: DataFrame, sources: dict | None = None, langs: dict | None = None, topics: dict | None = None, topic_of: Column | None = None, temper: float = TEMPER, keep: float = KEEP, named: int = NAMED, rounds: int = ROUNDS) -> DataFrame:
    """dimension, category, share (of all tokens), target, reached (expected share of the draw), drawn (expected share of the category's tokens)."""
    _, chances, targets = _chances(measure(docs, topic_of), sources, langs, topics, temper, keep, named, rounds, False)
    out = None
    for d, name in zip(DIMS, ("source", "lang", "topic")):
        found = chances.groupBy(F.col(d).alias("category")).agg(F.sum("n").alias("share"), F.sum(F.expr("n * p")).alias("got"))
        goal = chances.sparkSession.createDataFrame(sorted(targets[d].items()), "category string, target double")
        found = goal.join(found, "category", "left").select(F.lit(name).alias("dimension"), "category", F.coalesce("share", F.lit(0.0)).alias("share"), "target", F.coalesce("got", F.lit(0.0)).alias("got"))
        out = found if out is None else out.unionByName(found)
    total = F.lit(chances.agg(F.sum(F.expr("n * p"))).first()[0] or 0.0)
    return out.select("dimension", "category", "share", "target", F.try_divide("got", total).alias("reached"), F.try_divide("got", "share").alias("drawn"))
