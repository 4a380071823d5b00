"""The query register: one entry per operator, each over whole tables or views of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizcontacts.functions import emails as E
from bizcontacts.functions import html as H
from bizcontacts.functions import listing as L
from bizcontacts.functions import phones as N
from bizcontacts.functions import text as X
from bizcontacts.functions import urls as U
from bizcontacts.operators import campaign as C
from bizcontacts.operators import contacts as T
from bizcontacts.operators import lookups as K
from bizcontacts.operators import pages as P
from bizcontacts.operators import stats as S
from bizcontacts.operators.dedup import cascade_dedup, dedup_report, output_part
from bizcontacts.plans import jobs as J
from bizcontacts.plans.views import load
from bizcontacts.sources import dims
from bizcontacts.sources import leads as SL
from bizcontacts.sources.sinks import export_columns, result_name, stamp

Query = Callable[[SparkSession, str], DataFrame]

# Every address in the given tables is at example.com, so the deny-list is applied without it.
DENY = tuple(p for p in E.EMAIL_DENY if p not in ("example.com", "example@"))

# Terms per group of the campaign queries; the French group lists its keywords twice.
TERM_LINES = """
se|1|artisan_ice_cream_sv|hantverksglass|sv
se|2|ice_cream_bar_sv|glassbar|sv
se|3|confectionery_sv|konditori|sv
se|4|gelato_shop_en_se|gelato shop|en-gb
de|1|artisanal_ice_cream_de|handwerkliche eisdiele|de
de|2|gelato_producer_de|gelato hersteller|de
de|3|ice_cream_manufacturer_de|eishersteller|de
fr|1|artisanal_ice_cream_ch_fr|glacier artisanal|fr
fr|2|ice_cream_producer_ch_fr|producteur de glace artisanale|fr
fr|3|artisanal_ice_cream_be_fr|glacier artisanal|fr
fr|4|ice_cream_producer_be_fr|producteur de glace artisanale|fr
pl|1|confectionery_pl|cukiernia|pl
""".strip().splitlines()

BUSINESS_TYPES = ("spice_wholesaler", "baking_wholesaler", "ingredient_supplier", "horeca_supplier")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NEW TERM",
            # alike in the 100 characters that a file name holds
            "long " * 21 + "one", "long " * 21 + "two")
STAMP = "2024-01-02 03:04:05"


def joined(c: Column | str) -> Column:
    """Array as one sorted text."""
    return F.array_join(F.sort_array(c), ",")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(load(spark, sf_dir, "documents"), "doc_id")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.spread(load(spark, sf_dir, "pages_contact"), "page_id")
    return P.page_contacts(pages, email_deny=DENY)


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(load(spark, sf_dir, "leads_raw"), "ord")


def lang_country(c: str = "lang") -> Column:
    return F.when(F.col(c) == "en", F.lit("US")).otherwise(F.upper(c))


# --- text and contacts -------------------------------------------------------------------------

def q_doc_emails(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return T.text_emails(docs, "text", DENY)


def q_email_denylist(spark, sf):
    docs = documents(spark, sf)
    found = T.explode_found(docs.select("source", E.find_emails("text").alias("_f")), "_f", "email")
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(E.email_denied(F.col("email"))).alias("denied_full"),
        F.count_if(E.email_denied(F.col("email"), DENY)).alias("denied_short"),
    )


def q_phone_candidates(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    found = docs.select("doc_id", N.phone_candidates("text").alias("_f"))
    return T.explode_found(found, "_f", "candidate")


def q_doc_phones(spark, sf):
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    return T.text_phones(docs, "text", lang_country())


def q_phone_prefix(spark, sf):
    dialled = load(spark, sf, "dialled")
    number = F.col("number")
    return dialled.select("ord", "number", N.phone_region(number).alias("region"),
                          N.e164(number, F.lit("US"), ()).alias("e164"))


def q_phone_denylist(spark, sf):
    docs = documents(spark, sf).select("lang", "text")
    cands = docs.select("lang", N.phone_candidates("text").alias("_c"))
    modes = cands.select(
        "lang",
        F.size(N.e164_all(F.col("_c"), F.lit("US"), ())).cast("bigint").alias("valid"),
        F.size(N.e164_all(F.col("_c"), F.lit("US"))).cast("bigint").alias("anywhere"),
        F.size(N.e164_all(F.col("_c"), F.lit("US"), deny_mode="after_cc")).cast("bigint").alias("after_cc"),
    )
    sums = [F.sum(c).alias(c) for c in ("valid", "anywhere", "after_cc")]
    return modes.groupBy("lang").agg(*sums)


def q_clean_text(spark, sf):
    cleaned = documents(spark, sf).select("doc_id", X.clean_text("text").alias("t"))
    return cleaned.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


def q_text_norm(spark, sf):
    normed = documents(spark, sf).select("doc_id", X.text_norm("text").alias("t"))
    return normed.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


def q_contact_coverage(spark, sf):
    return flagship(spark, sf)


# --- pages -------------------------------------------------------------------------------------

def q_page_text(spark, sf):
    text = T.spread(load(spark, sf, "pages"), "page_id").select("page_id", H.page_text("html").alias("t"))
    return text.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


def q_company_info(spark, sf):
    marked = T.spread(load(spark, sf, "pages_contact"), "page_id").select(
        "page_id", H.visible_markup("html").alias("m")
    )
    return marked.select(
        "page_id",
        H.company_name(F.col("m")).alias("company_name"),
        H.description(F.col("m")).alias("description"),
    )


def q_page_links(spark, sf):
    return P.page_links(T.spread(load(spark, sf, "pages"), "page_id"))


def q_url_frontier(spark, sf):
    return P.url_frontier(P.domain_lines(load(spark, sf, "domain_list")))


def q_tld_country(spark, sf):
    return load(spark, sf, "page_sites").select("page_id", U.tld_country("url").alias("country"))


def q_sanitize_key(spark, sf):
    titles = T.spread(load(spark, sf, "pages"), "page_id").select(
        "page_id", F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1).alias("t")
    )
    return titles.select(
        "page_id", X.sanitize_key(F.concat(F.lit('a/b:c? "'), F.col("t"), F.lit('|<x>*'))).alias("key")
    )


# --- pages with contacts -----------------------------------------------------------------------

def q_page_contacts(spark, sf):
    return contacts(spark, sf).select(
        "page_id", "host", "company_name", joined("emails").alias("emails"),
        joined("phones").alias("phones"), "listed_phone", "address", "description",
    )


def q_domain_contacts(spark, sf):
    domains = P.domain_contacts(contacts(spark, sf))
    flat = P.flat_domain_contacts(domains, F.to_timestamp(F.lit(STAMP)))
    return flat.withColumn("all_phones", joined(F.split("all_phones", ", "))).drop("scraped_date")


def q_domain_stats(spark, sf):
    return S.domain_stats(P.domain_contacts(contacts(spark, sf)))


def q_site_emails(spark, sf):
    return P.site_emails(contacts(spark, sf))


def q_address_snippet(spark, sf):
    pages = T.spread(load(spark, sf, "pages_contact"), "page_id")
    texts = pages.select("page_id", H.page_text("html").alias("t"))
    return texts.select("page_id", H.address_snippet(F.col("t")).alias("address"))


def q_social_links(spark, sf):
    pages = T.spread(load(spark, sf, "pages_contact"), "page_id")
    links = pages.select("page_id", H.hrefs(H.visible_markup("html")).alias("l"))
    social = links.select("page_id", H.social_links(F.col("l")).alias("s"))
    columns = [F.try_element_at("s", F.lit(p)).alias(p) for p in H.SOCIAL_PLATFORMS]
    return social.select("page_id", *columns)


def q_page_class(spark, sf):
    return P.classify_pages(T.spread(load(spark, sf, "pages_contact"), "page_id")).select("page_id", "page_class")


def q_page_quality(spark, sf):
    return J.page_quality(T.spread(load(spark, sf, "pages_contact"), "page_id"))


def q_enrich_email(spark, sf):
    leads = load(spark, sf, "page_leads")
    return J.enrich_leads(leads, contacts(spark, sf), ["ord"])


# --- crawl log ---------------------------------------------------------------------------------

def q_crawl_outcomes(spark, sf):
    return P.crawl_outcomes(load(spark, sf, "crawl_log"))


def q_crawl_errors(spark, sf):
    return P.crawl_errors(load(spark, sf, "crawl_log"))


# --- leads -------------------------------------------------------------------------------------

def q_lead_dedup(spark, sf):
    kept = cascade_dedup(leads(spark, sf), ["ord"], keep_marks=True)
    return kept.select("ord", "business_name", "phone", "address", "city", "rating",
                       output_part().cast("bigint").alias("part"))


def q_unkeyed_dedup(spark, sf):
    """Rows told apart by nothing but the day: none without keys is lost."""
    kept = cascade_dedup(leads(spark, sf).drop("ord"), ["scraped_date"], keep_marks=True)
    return S.row_counts(kept.where(output_part() == 2), ["city"], "n_rows")


def q_lead_rows(spark, sf):
    rows = SL.lead_rows(load(spark, sf, "lead_lines"))
    return rows.select("file", "pos", "business_name", "phone", "city", "postal_code", "rating",
                       F.col("_other")["note"].alias("note"), F.col("_other")["_c4"].alias("second_note"))


def q_lead_rejects(spark, sf):
    return SL.line_rejects(load(spark, sf, "lead_lines"), load(spark, sf, "lead_file_list"))


def q_dedup_report(spark, sf):
    table = leads(spark, sf)
    return dedup_report(table, cascade_dedup(table, ["ord"]))


def q_merge_dedup(spark, sf):
    table = leads(spark, sf)
    older = table.where(F.col("ord") % 2 == 0).drop("rating")
    newer = table.where(F.col("ord") % 2 == 1)
    kept = J.merge_dedup([older, newer], ["ord"])
    return kept.select("ord", "business_name", "phone", "address", "rating")


def q_lead_stats(spark, sf):
    return S.lead_stats(leads(spark, sf))


def q_present_mask(spark, sf):
    table = leads(spark, sf)
    return table.select(
        "ord", *[X.is_present(c).alias(f"has_{c}") for c in ("business_name", "phone", "email", "address")]
    )


def q_export_projection(spark, sf):
    table = leads(spark, sf).drop("rating", "website")
    at = F.to_timestamp(F.lit(STAMP))
    stamped = export_columns(stamp(table, "ice cream", "Halle (Saale)", at))
    name = result_name(F.col("search_city"), F.col("search_keyword"), F.col("scraped_date"))
    return stamped.withColumns({"result": name, "scraped_date": F.date_format("scraped_date", "yyyy-MM-dd HH:mm:ss")})


def q_topk_per_search(spark, sf):
    table = leads(spark, sf).select("ord", "search_city", "search_keyword", "rating")
    return J.limit_results(table, [F.col("ord")], 20)


def q_top_cities(spark, sf):
    return S.top_by_rows(leads(spark, sf), ["city"], 20)


def q_rows_per_search(spark, sf):
    return S.row_counts(leads(spark, sf), ["search_city", "search_keyword"], "n_rows")


# --- campaign ----------------------------------------------------------------------------------

def _terms(spark):
    rows = [(line,) for line in TERM_LINES]
    return C.parse_terms(spark.sql(f"select * from {dims.values_sql(['line'], rows)}"))


def q_campaign_plan(spark, sf):
    cities = C.parse_cities(load(spark, sf, "city_lines"))
    plan = C.campaign_plan(cities, _terms(spark), start_from=25)
    return C.with_output_folder(plan).select(
        "seq", "city", "iso", "grp", "term_key", "keyword", "language", "folder"
    )


def q_campaign_group(spark, sf):
    """One group of a campaign, over list positions with wide gaps."""
    cities = C.parse_cities(load(spark, sf, "city_lines"))
    sparse = cities.withColumn("city_seq", F.col("city_seq") * 5_000_000_007)
    return C.campaign_plan(sparse, _terms(spark), group="se").select("seq", "city", "term_key")


def q_campaign_cross(spark, sf):
    plan = C.crossed_plan(load(spark, sf, "plan_cities"), BUSINESS_TYPES)
    keyed = plan.withColumn("language", F.lit("de"))
    return K.translate_keyword(keyed, dims.keyword_dim(spark), "business_type", "language")


def _skip_plan(spark, sf):
    cities = load(spark, sf, "plan_cities")
    return C.with_keys(cities.select("city", F.explode(F.array(*[F.lit(s) for s in SEGMENTS])).alias("keyword")))


def _files(spark, sf):
    return C.with_keys(load(spark, sf, "result_files")).withColumnRenamed("n_rows", "rows")


def q_skip_existing(spark, sf):
    return C.skip_check(_skip_plan(spark, sf), C.latest_results(_files(spark, sf)))


def q_existing_latest(spark, sf):
    latest = C.latest_results(_files(spark, sf))
    return latest.select("city_key", "keyword_key", "file", F.col("rows").alias("n_rows"))


def q_progress_summary(spark, sf):
    lines = load(spark, sf, "progress_lines")
    return C.progress_summary(C.progress_fields(lines), lines)


def q_search_url(spark, sf):
    searches = load(spark, sf, "searches")
    plan = searches.withColumn("keyword", F.concat(F.col("business_type"), F.lit(" & co/é*~")))
    return C.planned_urls(plan, F.col("radius_km") - 20).select("ord", "search_url")


def q_radius_zoom(spark, sf):
    searches = load(spark, sf, "searches")
    return searches.groupBy("radius_km", L.radius_to_zoom("radius_km").alias("zoom")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- dimensions --------------------------------------------------------------------------------

def q_keyword_translate(spark, sf):
    base = load(spark, sf, "searches").select("ord", "business_type", X.text_norm("language").alias("language"))
    return K.translate_keyword(base, dims.keyword_dim(spark), "business_type", "language")


def q_keyword_catalog(spark, sf):
    catalog = K.keyword_catalog(load(spark, sf, "keyword_source"), "de", ordered=True)
    return catalog.withColumn("n_languages", F.col("n_languages").cast("bigint"))


def q_city_country(spark, sf):
    return K.city_country(load(spark, sf, "searches").select("ord", "city"), "city")


def q_city_geo(spark, sf):
    base = load(spark, sf, "searches").select("ord", "city")
    strict = K.city_geo(base, "city", strict=True).withColumnRenamed("lat", "strict_lat").drop("lon", "tz")
    return K.city_geo(strict, "city")


def q_tiered_geo(spark, sf):
    return K.tiered_geo(load(spark, sf, "searches").select("ord", "city", "language"), "city", "language")


def q_phone_country(spark, sf):
    base = load(spark, sf, "searches").select("ord", "city", "language", "given_country")
    found = K.phone_country(base, "language", "city", "given_country")
    return K.campaign_phone_country(found, "language", "campaign_country").select(
        "ord", "phone_country", "campaign_country"
    )


def q_lang_country(spark, sf):
    return K.language_country(load(spark, sf, "searches").select("ord", "language"), "language")


def q_country_iso(spark, sf):
    return K.country_iso(load(spark, sf, "searches").select("ord", "country_name"), "country_name")


# --- listing texts -----------------------------------------------------------------------------

def q_parse_address(spark, sf):
    place = load(spark, sf, "listing_text").select("id", "address", L.parse_address("address").alias("p"))
    return place.select("id", "address", "p.city", "p.postal_code")


def q_parse_rating(spark, sf):
    return load(spark, sf, "listing_text").select(
        "id",
        L.parse_rating("rating_label", "rating_text").alias("rating"),
        L.parse_review_count("review_label").cast("double").alias("review_count"),
    )


def q_parse_hours(spark, sf):
    return load(spark, sf, "listing_text").select("id", L.parse_hours("hours_text").alias("hours"))


def q_parse_price(spark, sf):
    return load(spark, sf, "listing_text").select("id", L.parse_price("price_text").alias("price_range"))


def q_normalise_listings(spark, sf):
    raw = load(spark, sf, "listing_text").withColumnsRenamed({"id": "ord", "website": "website_href"})
    leads = J.normalise_listings(raw, "language", "place")
    columns = ("ord", "business_name", "phone", "address", "city", "postal_code", "country", "website", "rating",
               "category", "hours", "price_range")
    return leads.select(*columns)


def q_unwrap_redirect(spark, sf):
    return load(spark, sf, "listing_text").select("id", L.parse_website("website").alias("website"))


QUERIES: dict[str, Query] = {n: f for n, f in list(globals().items()) if n.startswith("q_")}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact coverage of the documents of each source."""
    return T.contact_coverage(documents(spark, sf_dir), "text", ["source"], lang_country(), DENY)
