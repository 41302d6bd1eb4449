"""The same job over a stream of records.  It keeps no state, so it needs neither watermark nor output mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.extract import extract_tables, flat_metrics


def extract_stream(df: DataFrame, **options) -> DataFrame:
    """``extract_tables`` on a streaming ``df``; a stream has no line numbers."""
    return extract_tables(df, **options)


def write_stream(records: DataFrame, records_path: str, flat_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Both outputs of every micro-batch, each in a folder of its own that a repeated batch overwrites: exactly once."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{records_path}/epoch={epoch}")
            flat_metrics(batch).write.mode("overwrite").parquet(f"{flat_path}/epoch={epoch}")
        finally:
            batch.unpersist()

    return records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
