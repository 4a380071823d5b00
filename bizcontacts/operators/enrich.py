"""Filling missing e-mails from what the websites show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.functions.text import is_present
from bizcontacts.functions.urls import normalize_url, site_host
from bizcontacts.operators.joins import ROWS_PER_SLOT, left_join_unique


def enrich_emails(leads: DataFrame, sites: DataFrame, spread_by: Sequence[str] = ("business_name", "website"),
                  rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Leads without an e-mail get that of their website; ``sites``: host (unique, without ``www.``), site_email.

    Only leads that lack an e-mail and have a website get a join key. Hosts shared by very many
    leads (portals, chains) are split over several tasks by the ``spread_by`` columns, an id or
    others that tell leads apart.
    """
    key = F.when(~is_present("email") & is_present("website"), site_host(normalize_url("website")))
    keyed = leads.withColumn("_host", key)
    named = sites.select(F.col("host").alias("_host"), "site_email")
    joined = left_join_unique(keyed, named, "_host", spread_by, rows_per_slot)
    return joined.withColumn("email", F.coalesce("site_email", "email")).select(*leads.columns)
