"""Places of rows in their groups, found without gathering a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizcontacts.llm.common import Scratch, ship


def _offsets(ends: list) -> list[tuple[int, int, int]]:
    """(part, number of its first group, rows of that group in earlier parts), from one row per part."""
    out, group, value, rows = [], -1, None, 0
    for r in sorted(ends, key=lambda r: r["_part"]):
        goes_on = group >= 0 and r["first"]["_value"] == value
        carried = rows if goes_on else 0
        number = group if goes_on else group + 1
        out.append((r["_part"], number, carried))
        group, value = number + r["last"]["_group"], r["last"]["_value"]
        rows = r["last"]["_at"] + 1 + (carried if r["last"]["_group"] == 0 else 0)
    return out


def ranked(rows: DataFrame, group: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``group_no`` (rank of the group, nulls first) and ``idx`` (place in the group), from 0.

    Rows are dealt by range of (group, order), so a group that holds a third of them spreads over
    many tasks; each numbers its own stretch, and one row per partition tells where it begins. Rows
    equal in all keys are told apart by a running number and keep some fixed order. The order
    columns should be short: the range sampler reads them. An empty table stays empty.
    """
    spark = rows.sparkSession
    ship(spark)
    placed = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    keys = (group, *order, "_row")
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    at_group = dealt.columns.index(group)
    marks = [("_part", pa.int32()), ("_group", pa.int64()), ("_at", pa.int64())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, at, value = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            numbers, places = [], []
            for v in batch.column(at_group).to_pylist():
                if no < 0 or v != value:
                    no, at, value = no + 1, -1, v
                at += 1
                numbers.append(no)
                places.append(at)
            found = [[part] * batch.num_rows, numbers, places]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, t) for v, (_, t) in zip(found, marks, strict=True))],
                names=[*batch.schema.names, *(n for n, _ in marks)])

    made = (T.StructField("_part", T.IntegerType()), T.StructField("_group", T.LongType()), T.StructField("_at", T.LongType()))
    schema = T.StructType([*dealt.schema.fields, *made])
    local = scratch.save(dealt.mapInArrow(number, schema), "numbered")
    scratch.drop(placed)
    value = F.col(group).alias("_value")
    ends = local.groupBy("_part").agg(F.min(F.struct("_group", value)).alias("first"),
                                      F.max(F.struct("_group", value, "_at")).alias("last")).collect()
    starts = spark.createDataFrame(_offsets(ends), "_part int, _number long, _carried long")
    carried = F.when(F.col("_group") == 0, F.col("_carried")).otherwise(0)
    return (local.join(F.broadcast(starts), "_part")
            .withColumn("group_no", F.col("_number") + F.col("_group"))
            .withColumn("idx", F.col("_at") + carried)
            .drop("_part", "_group", "_at", "_number", "_carried"))
