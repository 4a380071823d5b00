"""Coverage statistics and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizcontacts.functions.text import is_present

COVERED = ("phone", "email", "website")


def _count_present(df: DataFrame, name: str) -> Column:
    return F.count_if(is_present(name)) if name in df.columns else F.lit(0).cast("bigint")


def percentage(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; null for an empty total."""
    return F.round(F.lit(100.0) * part / F.nullif(total, F.lit(0)), 1)


def lead_stats(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and coverage of a lead table, or of each of its groups, in one pass."""
    counts = [F.count(F.lit(1)).alias("total_businesses")]
    counts += [_count_present(leads, c).alias(f"with_{c}") for c in COVERED]
    rated = F.count("rating") if "rating" in leads.columns else F.lit(0).cast("bigint")
    counts.append(rated.alias("with_rating"))
    cities = F.count_distinct("city") if "city" in leads.columns else F.lit(0).cast("bigint")
    counts.append(cities.alias("unique_cities"))
    out = leads.groupBy(*by).agg(*counts) if by else leads.agg(*counts)
    return out.withColumns(
        {f"{c}_percentage": percentage(F.col(f"with_{c}"), F.col("total_businesses")) for c in COVERED}
    )


def domain_stats(domains: DataFrame) -> DataFrame:
    """Coverage of nested domain records: e-mail, phone and company name."""
    out = domains.agg(
        F.count(F.lit(1)).alias("total_domains"),
        F.count_if(F.size("emails") > 0).alias("with_email"),
        F.count_if(F.size("phones") > 0).alias("with_phone"),
        F.count_if(F.coalesce(F.col("company_name"), F.lit("")) != "").alias("with_company"),
    )
    return out.withColumns(
        {
            f"{c}_percentage": percentage(F.col(f"with_{c}"), F.col("total_domains"))
            for c in ("email", "phone", "company")
        }
    )


def row_counts(df: DataFrame, keys: Sequence[str], name: str = "rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_by_rows(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The ``n`` keys with most rows; ties go by key."""
    return row_counts(df, keys).orderBy(F.desc("rows"), *keys).limit(n)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; groups are cut to ``k`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")
