"""Lead files arriving over time, as a file stream.

Duplicates are removed by key as long as the later copy arrives within the delay of the first one, so
the state kept is bounded. Time is the arrival of a row, not a date it holds, so no row is late: rows
with old dates or none are taken in like all others. The exact ordered cascade needs the whole past
and stays a batch job over the ingested table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from bizcontacts.functions.text import is_present_norm, text_norm
from bizcontacts.schemas import LEAD_COLUMNS, LEAD_SCHEMA, TIME_FORMAT
from bizcontacts.sources.leads import clean_missing


def lead_stream(spark: SparkSession, folder: str, columns: Sequence[str] = LEAD_COLUMNS,
                files_per_batch: int = 1000) -> DataFrame:
    """Stream over CSV lead files whose header is ``columns``; columns not among them are null.

    A file with another header stops the stream instead of shifting its values into wrong columns;
    files of another layout get a stream of their own.
    """
    raw = (
        spark.readStream.schema(StructType([StructField(c, StringType()) for c in columns]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", True)
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    typed: list[Column] = []
    for field in LEAD_SCHEMA.fields:
        kind = field.dataType.simpleString()
        if field.name not in columns:
            typed.append(F.lit(None).cast(kind).alias(field.name))
            continue
        text = clean_missing(F.col(field.name))
        if kind == "timestamp":
            text = F.try_to_timestamp(text, F.lit(TIME_FORMAT))
        elif kind != "string":
            text = text.try_cast("double").cast(kind)
        typed.append(text.alias(field.name))
    return raw.select(*typed, F.col("_metadata.file_path").alias("_file"), F.current_timestamp().alias("_arrived"))


def dedup_stream(leads: DataFrame, delay: str = "30 days") -> DataFrame:
    """First arrival per (phone, name), then per (name, address), kept in mind for ``delay``.

    A row that lacks a pass's keys passes it: its key then is the row itself, file included. The time
    of a row is ``_arrived``, that of the batch that took it in.
    """
    phone, name, addr = (text_norm(c) for c in ("phone", "business_name", "address"))
    itself = F.concat(F.lit("row:"), F.sha2(F.to_json(F.struct(*[c for c in leads.columns if c != "_arrived"])), 256))
    both1 = is_present_norm(phone) & is_present_norm(name)
    both2 = is_present_norm(name) & is_present_norm(addr)
    keyed = leads.withColumns(
        {
            "_k1": F.when(both1, F.to_json(F.array(phone, name))).otherwise(itself),
            "_k2": F.when(both2, F.to_json(F.array(name, addr))).otherwise(itself),
        }
    )
    return (
        keyed.withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(["_k1"])
        .dropDuplicatesWithinWatermark(["_k2"])
        .drop("_k1", "_k2")
    )


def ingest_leads(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                 delay: str = "30 days", columns: Sequence[str] = LEAD_COLUMNS) -> StreamingQuery:
    """Take in every file not seen before and stop; rerunning continues where the last run ended.

    ``checkpoint`` holds the progress and the keys seen; it belongs to this folder and table alone
    (``session.checkpoint_folder`` names one below the cluster's shared folder).
    """
    out = dedup_stream(lead_stream(spark, folder, columns), delay).select(*LEAD_COLUMNS)
    return (
        out.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
