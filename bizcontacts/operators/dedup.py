"""Ordered two-pass removal of duplicate leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizcontacts.functions.text import is_present_norm, text_norm

_KEYS = {"_phone": "phone", "_name": "business_name", "_addr": "address"}


def _normalised(leads: DataFrame) -> DataFrame:
    """Comparison columns; a column the input lacks counts as empty."""
    return leads.withColumns(
        {k: text_norm(c) if c in leads.columns else F.lit("") for k, c in _KEYS.items()}
    )


def _keep_first(df: DataFrame, keyed: Column, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key among keyed rows; every other row forms a group of its own, by its ``_row``.

    The bare ``row_number`` filter lets Spark cut each group to one row before the shuffle, so a key
    held by a third of all rows sends one row per input task. The hash in front only speeds up the
    sort; the exact keys follow it.
    """
    parts = [*[F.when(keyed, F.col(k)) for k in keys], F.when(~keyed, F.col("_row"))]
    window = Window.partitionBy(F.xxhash64(*parts), keyed, *parts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def cascade_dedup(leads: DataFrame, order_by: Sequence[str], ordered: bool = False,
                  keep_marks: bool = False) -> DataFrame:
    """Drop duplicates by (phone, name), then by (name, address) among the survivors.

    A pass looks only at rows that have both of its keys; other rows always survive, whether
    ``order_by`` tells them apart or not. Within a key the first row wins: in pass 1 by ``order_by``,
    in pass 2 rows keyed in pass 1 come before the rest; which of rows equal in ``order_by`` wins is
    open. ``ordered`` sorts the result the way the passes leave it: keyed by pass 2 first, then keyed
    by pass 1, then ``order_by``; ``keep_marks`` keeps the columns that say so (see ``output_part``).
    """
    ids = [F.col(c) for c in order_by]
    marked = _normalised(leads).withColumn("_row", F.monotonically_increasing_id())
    marked = marked.withColumn("_k1", is_present_norm("_phone") & is_present_norm("_name"))
    marked = marked.withColumn("_k2", is_present_norm("_name") & is_present_norm("_addr"))
    first = _keep_first(marked, F.col("_k1"), ["_phone", "_name"], ids)
    second = _keep_first(first, F.col("_k2"), ["_name", "_addr"], [F.col("_k1").desc(), *ids]).drop("_row")
    if ordered:
        second = second.orderBy(F.col("_k2").desc(), F.col("_k1").desc(), *ids)
    return second if keep_marks else second.drop("_phone", "_name", "_addr", "_k1", "_k2")


def output_part() -> Column:
    """Part of the output a row of ``cascade_dedup(keep_marks=True)`` stands in: 0 keyed by pass 2, 1 by
    pass 1 alone, 2 by neither. Within a part, rows stand in their input order."""
    return F.when(F.col("_k2"), 0).when(F.col("_k1"), 1).otherwise(2)


def dedup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, duplicates removed."""
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    total = sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"),
    )
    return total.withColumn("removed", F.col("rows_before") - F.col("rows_after"))
