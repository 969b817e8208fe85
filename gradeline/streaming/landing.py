"""Snapshots that land in a folder, loaded by key: an extension that the batch loads don't need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gradeline.operators.ingest import latest, upsert


def load_landing(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Upsert every new Parquet file of `landing` into the table under `target` (a directory per batch), then stop.

    Each batch keeps the latest row of a key and replaces the target's; batches are keyed and so may be repeated."""

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        new = latest(df, key, order).select(*df.columns)
        if number:
            new = upsert(session.read.schema(df.schema).parquet(f"{target}/batch={number - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
