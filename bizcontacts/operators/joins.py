"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key a single task may get, and how many heavier keys are looked after at most.
ROWS_PER_SLOT = 1_000_000
HOT_KEYS = 10_000


def lookup(df: DataFrame, dim: DataFrame, key: Column, dim_key: str, take: dict[str, str]) -> DataFrame:
    """Left join on one computed key against a dimension that is unique on ``dim_key``.

    ``take`` maps dimension columns to the names they get in the result. Whether the dimension is
    broadcast is its own matter: the fixed tables of this package carry the hint, others are left to
    the size estimate.
    """
    narrowed = dim.select(
        F.col(dim_key).alias("_lookup"), *[F.col(c).alias(name) for c, name in take.items()]
    )
    return df.withColumn("_lookup", key).join(narrowed, "_lookup", "left").drop("_lookup")


def hot_keys(df: DataFrame, key: str, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Keys with more than ``rows_per_slot`` rows and the number of slots they are to be split into.

    At most ``HOT_KEYS`` rows, the heaviest first, so the result may be broadcast.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counted.where(F.col("_n") > rows_per_slot).orderBy(F.desc("_n"), key).limit(HOT_KEYS)
    return heavy.select(key, F.ceil(F.col("_n") / rows_per_slot).cast("int").alias("_slots"))


def left_join_unique(left: DataFrame, right: DataFrame, key: str, spread_by: Sequence[str],
                     rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Left join against a ``right`` side unique on ``key``, balanced for keys ``left`` repeats a lot.

    A heavy key is split into as many slots as its row count asks for: each of its rows on the left
    goes to the slot its ``spread_by`` columns hash to, and its one row on the right is copied to
    all slots. Rows without a key are spread in the same way and match nothing. The result is
    exactly the plain left join; ``right`` is evaluated once, ``left`` once more for its key counts.
    """
    hot = F.broadcast(hot_keys(left, key, rows_per_slot))
    scatter = F.xxhash64(*spread_by)
    slotted = (
        left.join(hot, key, "left")
        .withColumn(
            "_slot",
            F.when(F.col(key).isNull(), scatter)
            .when(F.col("_slots").isNotNull(), F.pmod(scatter, F.col("_slots").cast("bigint")))
            .otherwise(F.lit(0).cast("bigint")),
        )
        .drop("_slots")
    )
    slots = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_slots"), F.lit(1)).cast("bigint") - 1)
    copied = right.join(hot, key, "left").withColumn("_slot", F.explode(slots)).drop("_slots")
    return slotted.join(copied, [key, "_slot"], "left").drop("_slot")
