"""The table jobs: what a user of the package runs. All are lazy and may be chained."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizcontacts.functions import listing as L
from bizcontacts.functions.emails import EMAIL_DENY
from bizcontacts.functions.phones import LISTING_PHONE_DENY, PHONE_DENY, extract_phones
from bizcontacts.functions.text import blank_to_null, clean_text
from bizcontacts.operators import campaign as C
from bizcontacts.operators import contacts as T
from bizcontacts.operators import pages as P
from bizcontacts.operators.dedup import cascade_dedup, dedup_report
from bizcontacts.operators.enrich import enrich_emails
from bizcontacts.operators.lookups import phone_country
from bizcontacts.operators.stats import lead_stats, row_counts, top_by_rows, top_k_per_group
from bizcontacts.sources.leads import LINE_ORDER, lead_rejects, read_leads
from bizcontacts.sources.sinks import write_leads

# Greatest number of results of one search.
MAX_RESULTS = 500


def extract_contacts(df: DataFrame, text: str, country: Column | None = None,
                     language: str | None = None, city: str | None = None,
                     email_deny: Sequence[str] = EMAIL_DENY,
                     phone_deny: Sequence[str] = PHONE_DENY) -> DataFrame:
    """Text table -> (other columns, kind, value). The phone country is given, or looked up from the
    language and city columns, or the default."""
    if country is None and language:
        where = city if city else "_no_city"
        source = df if city else df.withColumn("_no_city", F.lit(None).cast("string"))
        df = phone_country(source, language, where, out="_country").drop("_no_city")
        return T.text_contacts(df, text, F.col("_country"), email_deny, phone_deny).drop("_country")
    return T.text_contacts(df, text, country if country is not None else F.lit("US"), email_deny, phone_deny)


def page_contacts(pages: DataFrame, **options) -> DataFrame:
    """Pages -> one contact record per page."""
    return P.page_contacts(pages, **options)


def domain_contacts(pages: DataFrame, **options) -> DataFrame:
    """Pages -> one nested contact record per site."""
    return P.domain_contacts(P.page_contacts(pages, **options))


def page_links(pages: DataFrame, must_contain: str | None = None) -> DataFrame:
    return P.page_links(pages, must_contain)


def normalise_listings(raw: DataFrame, language: str | None = None, city: str | None = None) -> DataFrame:
    """Raw listing texts -> lead columns.

    ``raw`` may have: name, phone_text, address, website_href, rating_label, rating_text,
    review_label, review_text, hours_label, hours_text, price_label, price_text, category, url,
    country. The country given (or looked up from ``language`` and ``city``) is kept on the lead.
    """
    have = set(raw.columns)

    def get(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    if "country" in have:
        raw = raw.withColumn("_country", get("country"))
    elif language and city:
        raw = phone_country(raw, language, city, out="_country")
    else:
        raw = raw.withColumn("_country", F.lit("US"))
    place = raw.withColumn("_address", blank_to_null(clean_text(get("address"))))
    place = place.withColumn("_place", L.parse_address("_address"))
    phones = extract_phones(get("phone_text"), F.col("_country"), LISTING_PHONE_DENY)
    lead = {
        "business_name": blank_to_null(clean_text(get("name"))),
        "phone": F.try_element_at(phones, F.lit(1)),
        "email": get("email"),
        "address": F.col("_address"),
        "city": F.col("_place.city"),
        "postal_code": F.col("_place.postal_code"),
        "country": F.col("_country"),
        "website": L.parse_website(get("website_href")),
        "rating": L.parse_rating(get("rating_label"), get("rating_text")),
        "review_count": L.parse_review_count(get("review_label"), get("review_text")),
        "category": blank_to_null(clean_text(get("category"))),
        "hours": L.parse_hours(get("hours_text"), get("hours_label")),
        "price_range": L.parse_price(get("price_text"), get("price_label")),
        "google_maps_url": get("url"),
    }
    carried = [c for c in ("scraped_date", "search_keyword", "search_city", "ord") if c in have]
    return place.select(*[c.alias(n) for n, c in lead.items()], *carried)


def merge_dedup(parts: Sequence[DataFrame], order_by: Sequence[str]) -> DataFrame:
    """Lead tables of differing columns -> one table without duplicates."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return cascade_dedup(merged, order_by)


def merge_lead_files(spark: SparkSession, patterns: Sequence[str], target: str, fmt: str = "csv") -> DataFrame:
    """Merge lead files into one set without duplicates, write it, and return its statistics.

    Files count in name order and rows in line order, so the first copy of a duplicate stays. The
    result is a folder of part files; it is not drawn together into a single one.
    """
    merged = cascade_dedup(read_leads(spark, patterns), LINE_ORDER)
    write_leads(merged, target, fmt)
    written = read_leads(spark, f"{target}/*.csv") if fmt == "csv" else spark.read.format(fmt).load(target)
    return lead_stats(written)


def enrich_leads(leads: DataFrame, contacts: DataFrame,
                 spread_by: Sequence[str] = ("business_name", "website")) -> DataFrame:
    """Leads with missing e-mails filled from page contacts of their website."""
    return enrich_emails(leads, P.site_first_email(contacts), spread_by)


def lead_report(leads: DataFrame) -> DataFrame:
    return lead_stats(leads)


def limit_results(leads: DataFrame, order: Sequence[Column], k: int = MAX_RESULTS) -> DataFrame:
    """At most ``k`` leads per search, the option every search has."""
    return top_k_per_group(leads, ["search_city", "search_keyword"], order, k)


def campaign(cities: DataFrame, terms: DataFrame, files: DataFrame, min_rows: int = C.MIN_ROWS_DONE,
             group: str | None = None, start_from: int = 1) -> tuple[DataFrame, DataFrame]:
    """Plan of a campaign split into searches still to do and searches skipped."""
    plan = C.with_keys(C.campaign_plan(cities, terms, group, start_from))
    done = C.done_searches(files, min_rows)
    return C.todo(plan, done), C.skipped(plan, done)


def campaign_variant(cities: DataFrame, terms: DataFrame, files: DataFrame, variant: C.Variant,
                     start_from: int = 1) -> DataFrame:
    """Plan of one kind of campaign with search address, output folder and skip decision per search."""
    chosen = cities.where(F.col("grp").isin(*variant.groups))
    plan = C.with_keys(C.campaign_plan(chosen, terms, start_from=start_from))
    placed = C.with_output_folder(C.planned_urls(plan, F.lit(variant.radius_km or 0)))
    settings = placed.withColumn("find_emails", F.lit(variant.find_emails))
    return C.skip_check(settings, C.latest_results(files), variant.min_rows)


def page_quality(pages: DataFrame) -> DataFrame:
    """Pages per class."""
    return row_counts(P.classify_pages(pages), ["page_class"], "pages")


def content_pages(pages: DataFrame) -> DataFrame:
    """Pages that are content, with their class column dropped."""
    return P.classify_pages(pages).where(F.col("page_class") == "content").drop("page_class")


def crawl_quality(log: DataFrame) -> DataFrame:
    return P.crawl_errors(log)


__all__ = [
    "extract_contacts", "page_contacts", "domain_contacts", "page_links", "normalise_listings",
    "merge_dedup", "merge_lead_files", "campaign_variant", "enrich_leads", "lead_report", "limit_results", "campaign", "page_quality",
    "content_pages", "crawl_quality", "dedup_report", "lead_rejects", "row_counts", "top_by_rows",
]
