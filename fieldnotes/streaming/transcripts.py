"""An extension of this library: turns that arrive as a stream.

Stateless text functions run per micro-batch; the aggregates of whole tables are computed anew
for each batch of calls that arrived, by foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..schemas import TURN


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of turns, as they arrive."""
    return spark.readStream.schema(TURN).parquet(folder)


def annotated(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Redacted text, word counts and interviewer flags."""
    f = tx.interviewer_flags(F.col("text"), config.flag_rules)
    return turns.withColumns({"text": tx.redact(F.col("text")), "words": tx.count_words(F.col("text")), "leading_score": F.when(F.col("speaker_role") == "interviewer", f["leading_score"]).otherwise(0)})


def per_batch(turns: DataFrame, compute: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Append compute(batch) to a Parquet folder, each batch under its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
