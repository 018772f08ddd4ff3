"""Extension: a file stream of questions through the stateless analysis steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..operators import analysis

SCHEMA = "conv_id long, turn long, role string, text string"


def analysed(questions: DataFrame, glossary: list[tuple[str, str]]) -> DataFrame:
    """Works on static and streaming tables alike."""
    text = F.col("text")
    lang = analysis.language(text)
    return questions.select(
        *questions.columns,
        lang["language"].alias("language"),
        analysis.intent(text)["kind"].alias("intent"),
        analysis.out_of_scope(text).alias("out_of_scope"),
        analysis.apply_glossary(text, glossary).alias("english"),
        cache_key(text, lang["language"], F.lit("default")).alias("query_hash"),
    )


def start(spark: SparkSession, source: str, target: str, checkpoint: str, glossary: list[tuple[str, str]], files_per_trigger: int = 100):
    """Reads parquet files of questions as they arrive and writes the analysed rows."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return analysed(stream, glossary).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
