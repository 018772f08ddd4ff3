"""Queries opN_<name> of this subpackage, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_topk, importance, lexical, licenses, line_dedup, mixing, packing, simhash, substring_dedup, toxicity, url_filters
from .common import cut, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# --- 1: line dedup over pages -------------------------------------------------

OP1_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '{url_filters.HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{line_dedup.BREAKS}'),
                     lambda x: trim(regexp_replace(x, '{line_dedup.TAGS}', '', 'g'), ' ')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
b AS (
  SELECT l.host, l.line FROM (SELECT DISTINCT rid, host, unnest(lines) AS line FROM p) l JOIN t ON l.host = t.host
  GROUP BY l.host, l.line, t.total HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > t.total * {line_dedup.RATIO!r}::DOUBLE),
k AS (SELECT host, list(line) AS dropped FROM b GROUP BY host),
r AS (
  SELECT p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: NOT list_contains(coalesce(k.dropped, []), x)) AS kept
  FROM p LEFT JOIN k ON p.host = k.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       md5(coalesce(array_to_string(kept, chr(10)), '')) AS kept_md5
FROM r
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host, _ = url_filters.host_and_path(F.col("url"))
    out = line_dedup.drop_boilerplate(pages.withColumn("host", host).drop("url"), F.col("host"), line_dedup.html_lines(F.col("html")))
    return out.select(
        "page_id",
        "host",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.md5(F.array_join("__kept", "\n")).alias("kept_md5"),
    )


# --- 4: URL filters over pages ------------------------------------------------

#: The rules as (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP4_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '{url_filters.HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '{url_filters.PATH}', 1) AS path
  FROM pages),
best AS (
  SELECT rid, max({{'n': length(h || p), 'v': v, 'r': h || p}}) AS b
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN best ON u.rid = best.rid
"""


@query("op4_url_filters", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


# --- 8: mixing over documents -------------------------------------------------


def _named(source: str, column: str) -> str:
    """The largest categories of a column by tokens."""
    return f"(SELECT k FROM (SELECT {column} AS k, sum(tokens) AS m FROM {source} WHERE {column} IS NOT NULL AND {column} <> '*' GROUP BY 1 HAVING sum(tokens) > 0 ORDER BY m DESC, k LIMIT {mixing.NAMED}))"


def _fit(inner: str, column: str) -> str:
    mass = f"sum(n * w) OVER (PARTITION BY {column})"
    return f"(SELECT k, s, l, t, n, gs, gl, gt, CASE WHEN {mass} > 0 THEN w * g{column} * {mixing.KEEP!r}::DOUBLE / {mass} ELSE 0 END AS w FROM {inner})"


OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source,
    CASE WHEN contains(x, '://') OR contains(x, '@') THEN 'web'
         WHEN length(x) < 120 * (length(x) - length(replace(x, chr(10), '')) + 1) THEN 'list' ELSE 'prose' END AS topic,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
e AS (
  SELECT *, CASE WHEN source IN {_named("d", "source")} THEN source ELSE '*' END AS s,
            CASE WHEN lang IN {_named("d", "lang")} THEN lang ELSE '*' END AS l,
            CASE WHEN topic IN {_named("d", "topic")} THEN topic ELSE '*' END AS t FROM d),
c AS (SELECT s, l, t, sum(tokens)::DOUBLE / (SELECT greatest(sum(tokens), 1) FROM e) AS n FROM e GROUP BY ALL),
g AS (
  SELECT 's' AS dim, s AS k, pow(sum(n), {mixing.TEMPER!r}::DOUBLE) AS x FROM c GROUP BY s HAVING sum(n) > 0
  UNION ALL SELECT 'l', l, pow(sum(n), {mixing.TEMPER!r}::DOUBLE) FROM c GROUP BY l HAVING sum(n) > 0
  UNION ALL SELECT 't', t, pow(sum(n), {mixing.TEMPER!r}::DOUBLE) FROM c GROUP BY t HAVING sum(n) > 0),
h AS (SELECT dim, k, x / sum(x) OVER (PARTITION BY dim) AS share FROM g),
r AS (
  SELECT 0 AS k, s, l, t, n, 1.0::DOUBLE AS w, coalesce(hs.share, 0) AS gs, coalesce(hl.share, 0) AS gl, coalesce(ht.share, 0) AS gt
  FROM c LEFT JOIN h AS hs ON hs.dim = 's' AND hs.k = s LEFT JOIN h AS hl ON hl.dim = 'l' AND hl.k = l LEFT JOIN h AS ht ON ht.dim = 't' AND ht.k = t
  UNION ALL
  SELECT k + 1, s, l, t, n, least(w, 1), gs, gl, gt FROM {_fit(_fit(_fit("r", "s"), "l"), "t")} WHERE k < {mixing.ROUNDS}),
f AS (SELECT s, l, t, CASE WHEN n > 0 THEN w ELSE 1 END AS p FROM r WHERE k = {mixing.ROUNDS})
SELECT doc_id, lang, source, topic, tokens, round(p / {mixing.KEEP!r}::DOUBLE, 6) AS weight, round(p, 6) AS p,
       (('0x' || substr(md5(coalesce(doc_id, -1)::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) < p AS sampled
FROM e JOIN f ON e.s = f.s AND e.l = f.l AND e.t = f.t
"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mix_measured(cut(mixing.measure(docs).drop("text"))).select(
        "doc_id",
        "lang",
        "source",
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("tokens"),
        F.round("__weight", 6).alias("weight"),
        F.round("__p", 6).alias("p"),
        F.col("__sampled").alias("sampled"),
    )


# --- 7: SimHash near-duplicates over documents ----------------------------------


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


# --- 9: substring dedup over documents ------------------------------------------


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 10: packing over documents -------------------------------------------------


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


# --- 2: exact top-k over embeddings ---------------------------------------------

OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({exact_topk.SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= {exact_topk.K}
"""


@query("op2_exact_topk", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


# --- 6: approximate nearest neighbours over embeddings --------------------------


@query("op6_ann_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


# --- 3: toxicity over documents -------------------------------------------------


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


# --- 5: licence scans over documents --------------------------------------------


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


# --- 11: byte-level BPE over documents ------------------------------------------


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = byte_bpe.tokenizer_from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    return byte_bpe.digests(tokens).select("doc_id", "n_tokens", "n_split", "ids_sha256", "decoded_sha256")


# --- 12: importance resampling of documents towards benchmark --------------------


def _words_sql(source: str, id_column: str) -> str:
    """The words of each row of a table, numbered; DuckDB has no crc32, so different words get theirs by the table's rule."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT row_number() OVER () AS rid, {id_column}, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {source}"


OP12_SQL = rf"""
WITH d AS ({_words_sql("documents", "doc_id")}),
b AS ({_words_sql("benchmark", "item_id")}),
signs AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x) ORDER BY x) AS t
  FROM (SELECT unnest(range(0, 256)) AS x)),
every AS (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM d UNION ALL SELECT unnest(ws) FROM b)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % {importance.BUCKETS} AS bucket
  FROM (SELECT w, hex(encode(w)) AS x FROM every), signs),
df AS (SELECT rid, bucket FROM (SELECT rid, unnest(ws) AS w FROM d) JOIN hashed USING (w)),
bf AS (SELECT bucket FROM (SELECT unnest(ws) AS w FROM b) JOIN hashed USING (w)),
total AS (SELECT (SELECT count(*) FROM df) AS s, (SELECT count(*) FROM bf) AS t),
gain AS (
  SELECT x.bucket, floor(1000 * ln(((coalesce(y.n, 0) + 1) * (s + {importance.BUCKETS}))::DOUBLE / ((x.n + 1) * (t + {importance.BUCKETS}))::DOUBLE))::BIGINT AS g
  FROM (SELECT bucket, count(*) AS n FROM df GROUP BY bucket) x LEFT JOIN (SELECT bucket, count(*) AS n FROM bf GROUP BY bucket) y USING (bucket), total),
w AS (SELECT rid, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN gain USING (bucket) GROUP BY rid),
r AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (rid)),
k AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= {importance.LEAST_WORDS}
      QUALIFY rank <= {importance.PERCENT} * (SELECT count(*) FROM r WHERE n_features >= {importance.LEAST_WORDS}) // 100)
SELECT doc_id, n_features, weight, score, rank FROM r LEFT JOIN k USING (rid)
"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


# --- 13: ranked lexical search for benchmark over documents -----------------------


def _terms_sql(source: str, id_column: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT row_number() OVER () AS rid, {id_column}, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM {source}"


OP13_SQL = rf"""
WITH d AS (SELECT * FROM ({_terms_sql("documents", "doc_id")}) WHERE len(ws) > 0),
b AS ({_terms_sql("benchmark", "item_id")}),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS terms FROM d),
asked AS (SELECT DISTINCT rid, item_id, unnest(ws) AS w FROM b),
p AS (
  SELECT rid, doc_id, w, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS w FROM d)
  WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
i AS (
  SELECT rid, doc_id, w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT *
    ((1000000000 * tf) // (1000 * tf + 8 * ({100 - lexical.LENGTH_SHARE} + ({lexical.LENGTH_SHARE} * n * docs) // terms))) AS part
  FROM p JOIN f USING (w), s),
found AS (SELECT a.rid, item_id, doc_id, i.rid AS d, sum(part)::BIGINT AS score FROM asked a JOIN i USING (w) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM found WHERE score > 0 QUALIFY rank <= {lexical.K}
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
