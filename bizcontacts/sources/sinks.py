"""Writers for leads and domain contacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizcontacts.functions.text import clean_text, sanitize_key
from bizcontacts.operators.dedup import cascade_dedup
from bizcontacts.operators.lookups import country_folder
from bizcontacts.schemas import LEAD_COLUMNS, TIME_FORMAT


def export_columns(leads: DataFrame) -> DataFrame:
    """The lead columns present, in export order; everything else is dropped."""
    return leads.select(*[c for c in LEAD_COLUMNS if c in leads.columns])


def stamp(leads: DataFrame, keyword: str, city: str, now: Column | None = None) -> DataFrame:
    """Search and time of the export on every row; texts cleaned where they come from a page."""
    cleaned = {c: F.nullif(clean_text(c), F.lit("")) for c in ("business_name", "category") if c in leads.columns}
    return leads.withColumns(
        {
            **cleaned,
            "scraped_date": now if now is not None else F.current_timestamp(),
            "search_keyword": F.lit(keyword),
            "search_city": F.lit(city),
        }
    )


def result_name(city: Column, keyword: Column, at: Column) -> Column:
    """Name of a result set: ``City_keyword_yyyyMMdd_HHmmss``."""
    return F.concat_ws("_", sanitize_key(city), sanitize_key(keyword), F.date_format(at, "yyyyMMdd_HHmmss"))


def prepare_export(leads: DataFrame, keyword: str, city: str, order_by: Sequence[str],
                   deduplicate: bool = True, now: Column | None = None) -> DataFrame:
    stamped = stamp(leads, keyword, city, now)
    return export_columns(cascade_dedup(stamped, order_by) if deduplicate else stamped)


def write_leads(leads: DataFrame, path: str, fmt: str = "csv", by_country: str | None = None,
                mode: str = "errorifexists") -> None:
    """Write leads as CSV, JSON or Parquet, in one folder per country where ``by_country`` names an
    ISO column.

    With ``mode="overwrite"`` and ``by_country`` only the countries among the leads are replaced, all at
    once when the job is done, so that a rerun leaves the other countries alone and doubles nothing.
    The rebalance hint gathers the rows of a country into well-sized files and splits the ones of a
    large country; without it every task would open a file for every country.
    """
    columns = export_columns(leads).columns
    writer_input = leads
    if by_country:
        iso = F.coalesce(F.nullif(country_folder(F.col(by_country)), F.lit("")), F.lit("unknown"))
        writer_input = leads.withColumn("folder", sanitize_key(iso)).select(*columns, "folder")
        writer_input = writer_input.hint("rebalance", "folder")
    else:
        writer_input = writer_input.select(*columns)
    writer = writer_input.write.mode(mode)
    if by_country:
        writer = writer.partitionBy("folder").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("timestampFormat", TIME_FORMAT).csv(path)
    elif fmt == "json":
        writer.option("timestampFormat", TIME_FORMAT).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"fmt: {fmt!r}")


def write_domain_contacts(flat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat.write.mode(mode).option("header", True).option("escape", '"').option(
        "timestampFormat", TIME_FORMAT
    ).csv(path)
