"""Statements from a stream of raw tokens, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokens import build_tokens
from ..plans.engine import StatementEngine


def extract_stream(raw: DataFrame, engine: StatementEngine, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the results of each micro-batch to out/batch=N, so that a batch that runs again replaces its own rows.
    A document has to arrive whole within a batch, as one file of a file source does."""

    def write(batch: DataFrame, number: int) -> None:
        engine.relations(build_tokens(batch, engine.settings)).results.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
