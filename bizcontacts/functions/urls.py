"""URL normalisation and parts, by pattern so that odd characters never raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizcontacts.functions.text import col, utrim

# Paths of a site that usually carry contact data, in the order they are tried.
CONTACT_PATHS = ("", "/contact", "/about", "/kontakt", "/mentions-legales", "/impressum")
MAX_PAGES_PER_SITE = 5

# Top-level domain -> country its phone numbers are read for.
TLD_COUNTRY = {
    "PL": "PL",
    "FR": "FR",
    "DE": "DE",
    "IT": "IT",
    "ES": "ES",
    "UK": "GB",
    "PT": "PT",
    "NL": "NL",
    "BE": "BE",
    "CH": "CH",
    "AT": "AT",
}

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def normalize_url(domain: Column | str) -> Column:
    """Trimmed, without closing slashes, with a scheme."""
    bare = F.regexp_replace(utrim(domain), "/+$", "")
    return F.regexp_replace(bare, "^(?!https?://)", "https://")


def authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _AUTHORITY, 1)


def host(url: Column | str) -> Column:
    """Host in lower case, without user part and port."""
    return F.lower(F.regexp_replace(authority(url), r"^.*@|:[0-9]*$", ""))


def site_host(url: Column | str) -> Column:
    """Host without a leading ``www.``, under which a site goes as well."""
    return bare_host(host(url))


def bare_host(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"^www\.", "")


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _PATH, 1)


def base_url(url: Column | str) -> Column:
    return F.concat(F.lower(F.regexp_extract(col(url), _SCHEME, 1)), F.lit("://"), authority(url))


def candidate_pages(url: Column | str, paths: Sequence[str] = CONTACT_PATHS,
                    max_pages: int = MAX_PAGES_PER_SITE) -> Column:
    """Array of the first ``max_pages`` contact pages of a site."""
    base = base_url(url)
    chosen = [p if p == "" or p.startswith("/") else f"/{p}" for p in list(paths)[:max_pages]]
    return F.array(*[F.concat(base, F.lit(p)) for p in chosen])


def drop_query(url: Column | str) -> Column:
    return F.split_part(col(url), F.lit("?"), F.lit(1))


def tld_country(url: Column | str, default: str = "US") -> Column:
    tld = F.upper(F.element_at(F.split(authority(url), r"\."), -1))
    chain = F.lit(default)
    for key, iso in TLD_COUNTRY.items():
        chain = F.when(tld == key, F.lit(iso)).otherwise(chain)
    return chain


def percent_decode(c: Column) -> Column:
    """Percent-decoding that keeps ``+``; text that cannot be decoded is returned as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def percent_encode(c: Column) -> Column:
    """Percent-encoding with ``/`` and the unreserved signs left alone."""
    out = F.url_encode(c)
    for coded, sign in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(coded), F.lit(sign))
    return out
