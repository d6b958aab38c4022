"""Incremental loading: files as they arrive, upserted exactly once into a table of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.versions import VersionedTable


def start(spark: SparkSession, source: str, schema, target: str, key: list[str], order: str, checkpoint: str, first_wins: bool = False, compact_every: int = 16, keep: int | None = None):
    """A streaming query that appends each micro-batch to the versioned table at `target`.

    Batch n is version n + 1; a replayed batch finds its version and writes nothing.  Later rows of a key replace
    earlier ones, or with first_wins only keys that the table lacks are added, so that no state
    grows in the stream.  With `keep`, only as many versions stay.
    """
    table = VersionedTable(spark, target, key, order, schema, compact_every)

    def merge(batch: DataFrame, batch_id: int) -> None:
        (table.append_new if first_wins else table.append)(batch, batch_id + 1)
        if keep:
            table.drop_old(keep)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
