"""Streaming append to the stored tables.

Traffic rows, session uploads and device registrations need no state on the
way in: the batch transforms run on the stream and the file sink writes each
row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.schemas import PARTITION_TIME, PROJECT_TABLES
from footfall.sources.tables import TableStore


def append_stream(rows: DataFrame, store: TableStore, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream of stored rows, one folder per project and date."""
    schema = PROJECT_TABLES[table]
    out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    folders = ["project_id"]
    if table in PARTITION_TIME:
        out = out.withColumn("dt", F.to_date(PARTITION_TIME[table]))
        folders.append("dt")
    writer = (
        out.writeStream.format("parquet").partitionBy(*folders).option("path", store.path(table)).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
