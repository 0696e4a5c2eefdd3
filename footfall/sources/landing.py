"""Landed request records: JSON lines, read in batch or as a stream.

No line is lost: one that is no record, and a record without items, come out as
one item with a reason, so that received = accepted + rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall.schemas import REQUESTS

BROKEN = "_corrupt_record"


def _schema(kind: str) -> T.StructType:
    return T.StructType(REQUESTS[kind].fields + [T.StructField(BROKEN, T.StringType())])


def read_requests(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Request records of one kind.  Nested JSON fields arrive as text.

    A line that is no record has its text in ``_corrupt_record``, other columns null.
    """
    return spark.read.schema(_schema(kind)).option("columnNameOfCorruptRecord", BROKEN).json(path)


def stream_requests(spark: SparkSession, kind: str, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same records as a stream; a micro-batch takes a bounded number of files."""
    reader = spark.readStream.schema(_schema(kind)).option("columnNameOfCorruptRecord", BROKEN)
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(path)


def whole_requests(requests: DataFrame) -> DataFrame:
    """The lines that are records."""
    return requests.where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_requests(requests: DataFrame) -> DataFrame:
    """The lines that are not, with the reason."""
    return requests.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"), F.lit("malformed_record").alias("reason"))


def items_of(requests: DataFrame) -> DataFrame:
    """One row per posted item, with its position; the request columns stay.

    ``landed`` says what is wrong with the record itself, null if nothing is:
    ``malformed_record``, ``empty_items`` or ``null_item``.
    """
    broken = F.col(BROKEN).isNotNull() if BROKEN in requests.columns else F.lit(False)
    outer = [c for c in requests.columns if c not in ("items", BROKEN)]
    landed = (
        F.when(broken, "malformed_record")
        .when(F.coalesce(F.size("items") < 1, F.lit(True)), "empty_items")
        .when(F.col("item").isNull(), "null_item")
    )
    # posexplode_outer does not look into the record: what it says is kept beside the items.
    found = requests.select(*outer, "items", *([BROKEN] if BROKEN in requests.columns else []), F.posexplode_outer("items").alias("item_no", "item"))
    return found.select(*outer, F.coalesce("item_no", F.lit(0)).alias("item_no"), "item.*", landed.alias("landed"))
