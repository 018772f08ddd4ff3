"""Corpus pipeline: toxicity, line dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame with the columns of ``documents`` (the last one: pieces of
sequences). Between stages rows are written as Parquet to the shared checkpoint folder and
read again, which also cuts the lineage; a folder is removed once the stage after it is
written, the last one stays for the result to be read. Every stage takes null and empty values, repeated rows, ties, empty tables and other columns (ignored) as
its operator does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, mixing, packing, simhash, toxicity
from lodestone.llm.common import ensure_checkpoint_dir, table

#: The near-dedup stage: independent fingerprints of a text's shingles of so many words, which give candidates, and the least similarity of five-word shingles of a link.
PRINTS, CANDIDATE_WORDS, SIMILARITY = 6, 2, 0.8
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, learnt from the labels of ``sf_dir``; documents it predicts toxic go. Null and empty texts match nothing and stay."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("__score") < 0.5).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 with the source as host; boilerplate lines leave the texts.

    A text that has no other line is a copy, which the next stage judges, and keeps its lines. A null text stays null.
    """
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), line_dedup.text_lines(F.col("text")), spare_whole=True)
    text = F.when(F.col("text").isNotNull(), F.array_join("__kept", "\n"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 with several fingerprints, links confirmed by exact similarity; one document of each class stays, that of the least id.

    Of texts without words one stays; classes without ids keep one row each.
    """
    return simhash.one_of_each(docs.select(*COLUMNS), SIMILARITY, shingle=CANDIDATE_WORDS, prints=PRINTS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 with tempered targets; documents are drawn by their calibrated probabilities. Rows of one id are drawn alike."""
    return mixing.mix(docs.select(*COLUMNS)).where("__sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; the pieces of all sequences. A null text is one end-of-document id."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL has no form for the first, third and last stage; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a finished stage from the shared store."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            out = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return out
