"""Facts from stored web pages, per page and per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizcontacts.functions import html as H
from bizcontacts.functions import urls as U
from bizcontacts.functions.classify import CRAWL_CLASSES, crawl_class, page_class
from bizcontacts.functions.emails import EMAIL_DENY, extract_emails, mailto_emails
from bizcontacts.functions.phones import (
    LISTING_PHONE_DENY,
    PHONE_DENY,
    e164_all,
    extract_phones,
    phone_candidates,
)
from bizcontacts.functions.text import utrim
from bizcontacts.operators.contacts import explode_found, pin


def page_contacts(
    pages: DataFrame,
    sep: str = " ",
    email_deny: Sequence[str] = EMAIL_DENY,
    mailto_deny: Sequence[str] = (),
    phone_deny: Sequence[str] = PHONE_DENY,
    listing_phone_deny: Sequence[str] = LISTING_PHONE_DENY,
    host_match: bool = False,
) -> DataFrame:
    """One contact record per page; ``pages``: page_id, url, html. Map-only.

    The markup is cleaned once, text and links are taken from it once, and every field is derived
    from those three columns.
    """
    marked = pages.select("page_id", "url", H.visible_markup("html").alias("_markup"))
    read = marked.withColumns(
        {
            "_text": H.markup_text(F.col("_markup"), sep),
            "_links": H.hrefs(F.col("_markup")),
            "_country": U.tld_country("url"),
        }
    )
    markup, text, links, country = (F.col(c) for c in ("_markup", "_text", "_links", "_country"))

    # tel: links come first, so the first valid number is theirs if they hold one
    shown = F.concat(H.tel_texts(markup, links), H.labelled_phone_texts(markup))
    listed = e164_all(F.flatten(F.transform(shown, phone_candidates)), country, listing_phone_deny)

    return read.select(
        "page_id",
        "url",
        U.host("url").alias("host"),
        H.company_name(markup).alias("company_name"),
        H.description(markup).alias("description"),
        F.array_union(extract_emails(text, email_deny), mailto_emails(links, mailto_deny)).alias("emails"),
        extract_phones(text, country, phone_deny).alias("phones"),
        F.try_element_at(listed, F.lit(1)).alias("listed_phone"),
        H.address_snippet(text).alias("address"),
        H.social_links(links, host_match).alias("social_media"),
    )


def page_links(pages: DataFrame, must_contain: str | None = None) -> DataFrame:
    """Distinct link targets per site, query part dropped."""
    found = pages.select(U.host("url").alias("host"), H.hrefs(H.visible_markup("html")).alias("_links"))
    links = explode_found(found, "_links", "_href")
    if must_contain:
        links = links.where(F.contains("_href", F.lit(must_contain)))
    return links.select("host", U.drop_query("_href").alias("link")).distinct()


def domain_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Usable entries of a domain list as URLs: blank lines and ``#`` lines dropped."""
    c = F.col(line)
    kept = lines.where(~c.startswith("#") & (utrim(c) != ""))
    return kept.withColumn("url", U.normalize_url(line))


def url_frontier(urls: DataFrame, url: str = "url", paths: Sequence[str] = U.CONTACT_PATHS,
                 max_pages: int = U.MAX_PAGES_PER_SITE) -> DataFrame:
    """Distinct contact pages to look at: base, position, page_url."""
    pages = F.posexplode(U.candidate_pages(url, paths, max_pages)).alias("position", "page_url")
    return urls.select(U.base_url(url).alias("base"), url).select("base", pages).distinct()


def site_emails(contacts: DataFrame) -> DataFrame:
    """Distinct e-mails per site with the number of pages that show them, one row each.

    The long form keeps a site of any size spread out; nothing gathers a site in one row.
    """
    return (
        explode_found(contacts.select("host", "emails"), "emails", "email")
        .groupBy("host", "email")
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


def site_first_email(contacts: DataFrame) -> DataFrame:
    """One row per site: its alphabetically first e-mail and how many distinct ones it has.

    A host with a leading ``www.`` is the same site as without.
    """
    bare = contacts.select(U.bare_host("host").alias("host"), "emails")
    return (
        site_emails(bare)
        .groupBy("host")
        .agg(F.min("email").alias("site_email"), F.count(F.lit(1)).alias("n_emails"))
    )


def domain_contacts(contacts: DataFrame, paths: Sequence[str] = U.CONTACT_PATHS) -> DataFrame:
    """One nested record per site, from all of its pages.

    Pages rank as they would be visited: contact paths in their order, others behind them by URL.
    The first page gives name, phones, address, accounts and description; e-mails are the distinct
    ones of all pages. Tasks send on one front page and the distinct addresses per site, so what is gathered
    does not grow with a site's pages.
    """
    bare = F.regexp_replace(U.path("url"), "/+$", "")
    known = F.array_position(F.array(*[F.lit(p) for p in paths]), bare)
    place = F.when(known > 0, known).otherwise(F.lit(len(paths) + 1))
    front = F.struct("url", "company_name", "phones", "address", "social_media", "description")
    shown = contacts.where(F.col("host") != "").select(
        "host", F.struct(place.alias("place"), "url", "page_id").alias("_visit"), front.alias("_front"),
        F.explode_outer("emails").alias("_email"))
    sites = shown.groupBy("host").agg(F.min_by("_front", "_visit").alias("_home"), F.collect_set("_email").alias("_found"))
    return sites.select(
        "host",
        U.base_url("_home.url").alias("website"),
        "_home.company_name",
        F.sort_array("_found").alias("emails"),
        "_home.phones",
        "_home.address",
        "_home.social_media",
        "_home.description",
    )


def flat_domain_contacts(domains: DataFrame, scraped_date: Column | None = None) -> DataFrame:
    """Export form of ``domain_contacts``: first and joined values, one column per platform."""
    def joined(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", "))

    return domains.select(
        "company_name",
        "website",
        F.try_element_at("emails", F.lit(1)).alias("email"),
        joined("emails").alias("all_emails"),
        F.try_element_at("phones", F.lit(1)).alias("phone"),
        joined("phones").alias("all_phones"),
        "address",
        "description",
        *[F.try_element_at("social_media", F.lit(p)).alias(p) for p in H.SOCIAL_PLATFORMS],
        (scraped_date if scraped_date is not None else F.current_timestamp()).alias("scraped_date"),
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """The pages with their class: consent, captcha, blocked, popup or content."""
    read = pages.withColumn("_markup", H.visible_markup("html")).withColumns(
        {
            "_body": F.lower(H.markup_text(F.col("_markup"))),
            "_title": F.lower(F.regexp_extract("_markup", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)),
            "_url": F.lower("url"),
        }
    )
    classed = pin(read, "page_class", page_class("_url", "_title", "_body", "html"))
    return classed.select(*pages.columns, "page_class")


def successful(log: DataFrame) -> DataFrame:
    """Attempts whose page may be read: status 200."""
    return log.where(F.col("status") == 200)


def crawl_outcomes(log: DataFrame) -> DataFrame:
    """Last outcome per URL; ``log``: url, status, error, ts, event_id (breaks ties of ts)."""
    classes = F.array(*[F.lit(c) for c in CRAWL_CLASSES])
    classed = log.select("url", "ts", "event_id", F.array_position(classes, crawl_class("status", "error")).alias("_class"),
                         (F.col("status") == 200).alias("_ok"))
    # times and class numbers, unlike texts and structs, are held in place: no sort per task
    last = classed.groupBy("url", "ts").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_ok").alias("_oks"),
        F.max_by("_class", "event_id").alias("_class"))
    return last.groupBy("url").agg(
        F.sum("_n").alias("attempts"),
        F.sum("_oks").alias("ok_attempts"),
        F.get(classes, (F.coalesce(F.max_by("_class", "ts"), F.max("_class")) - 1).cast("int")).alias("outcome"),
    )


def crawl_errors(log: DataFrame) -> DataFrame:
    """Attempts per class."""
    return log.groupBy(crawl_class("status", "error").alias("error_class")).agg(
        F.count(F.lit(1)).alias("attempts")
    )
