"""Streams that run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import new_path


def finished(stream: DataFrame, name: str) -> DataFrame:
    """All rows of an append stream over the data there is now, as a table in the shared folder; its offsets and state lie beside it."""
    path = new_path(stream.sparkSession, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
