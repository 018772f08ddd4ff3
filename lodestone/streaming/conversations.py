"""Conversations as a stream: keyed state holds the last turns and the facts of each.

Turns arrive in any order and in any number of batches; the state of a conversation is what the batch functions
``history_window`` and ``history_facts`` (without a question) give for the turns so far. It is kept by Spark's state store, so it is there
again after a restart. State is bounded: ``KEEP`` turns and, for each key, the first fact. A conversation that is silent for ``idle_ms``, if given, loses its state.

A turn that comes again replaces the former one in the window. Rows without conv_id or turn are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.analysis import facts_of
from .queries import SCHEMA

KEEP = 6
RESULT = "conv_id long, seen long, turns array<struct<turn:long,role:string,text:string>>, facts array<string>"


def remember(key, rows: Iterator[pd.DataFrame], state, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """The last ``KEEP`` turns by number, the facts of the latest user turn, and the first fact of each key, as one JSON value."""
    if state.hasTimedOut:
        state.remove()
        return
    n, last_user, latest, turns, first = json.loads(state.get[0]) if state.exists else (0, -1, [], [], {})
    turns = {t[0]: t for t in turns}
    for batch in rows:
        for turn, role, text, keys, facts in zip(*(batch[c] for c in ("turn", "role", "text", "keys", "facts"))):
            turn, n = int(turn), n + 1
            turns[turn] = [turn, role, text]
            if len(turns) > KEEP:
                del turns[min(turns)]
            found = [[turn, at, k, f] for at, (k, f) in enumerate(zip(keys, facts))]
            if role == "user" and turn >= last_user:
                last_user, latest = turn, found
            for _, at, k, f in found:
                if k not in first or [turn, at] < first[k][:2]:
                    first[k] = [turn, at, f]
    state.update((json.dumps([n, last_user, latest, list(turns.values()), first]),))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    # as in the batch: the latest user turn's own first, then the first turn that has a key
    places = {k: (1, *place) for k, place in first.items()}
    for _, at, k, fact in reversed(latest):
        places[k] = (0, 0, at, fact)
    ordered = [{"turn": t, "role": r, "text": x} for t, r, x in (turns[t] for t in sorted(turns))]
    yield pd.DataFrame({"conv_id": [key[0]], "seen": [n], "turns": [ordered], "facts": [[p[3] for p in sorted(places.values())]]})


def remembered(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of turns (conv_id, turn, role, text) -> RESULT of each conversation that a batch has turns of, as it is then."""
    found = facts_of(F.col("text"))
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "role", "text", F.transform(found, lambda x: x["key"]).alias("keys"), F.transform(found, lambda x: x["fact"]).alias("facts")
    )
    step = lambda key, rows, state: remember(key, rows, state, idle_ms)
    return rows.groupBy("conv_id").applyInPandasWithState(step, RESULT, "json string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 100, idle_ms: int | None = None):
    """Reads parquet files of turns; each batch writes its conversations' states to ``target``, once.

    With ``idle_ms`` it goes on until it is stopped, as a time-out needs batches without data; without, it ends when all files are read.
    """
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def write(rows: DataFrame, batch: int) -> None:
        # a batch that is run again writes its own folder anew
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return remembered(stream, idle_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": "10 seconds"} if idle_ms else {"availableNow": True})).start()


def states(spark: SparkSession, target: str) -> DataFrame:
    """The last state of each conversation that ``start`` has written."""
    rows = spark.read.schema(f"{RESULT}").option("basePath", target).parquet(f"{target}/batch=*")
    return rows.groupBy("conv_id").agg(F.max(F.struct("seen", "turns", "facts")).alias("s")).select("conv_id", "s.*")
