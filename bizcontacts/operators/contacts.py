"""Contacts found in any text table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizcontacts.functions.emails import EMAIL_DENY, extract_emails
from bizcontacts.functions.phones import PHONE_DENY, extract_phones, may_hold_phone


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` only where the tables read are too small to occupy the cluster.

    A small file comes in few partitions and leaves cores idle in the work that follows. The size
    is that of the tables read, as the optimizer knows it; input that gives a quarter of the cores a
    full scan partition each is passed on as it is, without a shuffle.
    """
    if not hasattr(df, "_jdf"):  # remote sessions do not show the size
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    scan_bytes = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    ))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return df if size >= cores * scan_bytes / 4 else df.repartition(cores, key)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters may use without evaluating it again.

    Spark pushes a filter below the projection that computes its column, with the whole expression
    written out in it. It does not push below a generator, so the value passes through one.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def explode_found(df: DataFrame, values: str, out: str) -> DataFrame:
    """One row per element of ``values``; rows without any are dropped.

    The outer form keeps Spark from adding a ``size(values) > 0`` filter, which it would push below
    the extraction and so run every pattern twice.
    """
    return df.withColumn(out, F.explode_outer(values)).where(F.col(out).isNotNull()).drop(values)


def text_emails(df: DataFrame, text: str, deny: Sequence[str] = EMAIL_DENY) -> DataFrame:
    """One row per e-mail and record."""
    some = df.where(F.contains(text, F.lit("@")))
    return explode_found(some.withColumn("_found", extract_emails(text, deny)).drop(text), "_found", "email")


def text_phones(df: DataFrame, text: str, country: Column, deny: Sequence[str] = PHONE_DENY,
                deny_mode: str = "anywhere") -> DataFrame:
    """One row per valid phone number and record."""
    some = df.where(may_hold_phone(text))
    found = some.withColumn("_found", extract_phones(text, country, deny, deny_mode)).drop(text)
    return explode_found(found, "_found", "phone")


def text_contacts(df: DataFrame, text: str, country: Column, email_deny: Sequence[str] = EMAIL_DENY,
                  phone_deny: Sequence[str] = PHONE_DENY) -> DataFrame:
    """One row per contact: the input's other columns, kind (``email``/``phone``) and value.

    One scan serves both kinds.
    """
    both = df.withColumns(
        {
            "_emails": extract_emails(text, email_deny),
            "_phones": extract_phones(text, country, phone_deny),
        }
    ).drop(text)
    kinds = F.concat(
        F.transform("_emails", lambda v: F.struct(F.lit("email").alias("kind"), v.alias("value"))),
        F.transform("_phones", lambda v: F.struct(F.lit("phone").alias("kind"), v.alias("value"))),
    )
    exploded = explode_found(both.withColumn("_all", kinds).drop("_emails", "_phones"), "_all", "_c")
    return exploded.withColumns({"kind": F.col("_c.kind"), "value": F.col("_c.value")}).drop("_c")


def contact_coverage(df: DataFrame, text: str, by: Sequence[str], country: Column,
                     email_deny: Sequence[str] = EMAIL_DENY,
                     phone_deny: Sequence[str] = PHONE_DENY) -> DataFrame:
    """Per group: records, records with an e-mail, with a phone, and the shares in percent."""
    flags = df.select(
        *by,
        (F.size(extract_emails(text, email_deny)) > 0).alias("_e"),
        (F.size(extract_phones(text, country, phone_deny)) > 0).alias("_p"),
    )
    total = F.count(F.lit(1))
    out = flags.groupBy(*by).agg(
        total.alias("total"), F.count_if("_e").alias("with_email"), F.count_if("_p").alias("with_phone")
    )
    return out.withColumns(
        {
            "email_percentage": F.round(F.lit(100.0) * F.col("with_email") / F.col("total"), 1),
            "phone_percentage": F.round(F.lit(100.0) * F.col("with_phone") / F.col("total"), 1),
        }
    )
