"""E-mail extraction from text and from mailto links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizcontacts.functions.text import col, utrim

# The address pattern and the parts that mark an address as unusable.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
EMAIL_DENY = (
    "example.com",
    "test.com",
    "noreply",
    "no-reply",
    "donotreply",
    "mailer-daemon",
    "postmaster",
    "abuse",
    "spam",
    "privacy@",
    "legal@",
    "copyright@",
    "dmca@",
    "wix.com",
    "squarespace.com",
    "wordpress.com",
    "placeholder",
    "youremail",
    "yourname",
    "example@",
    "user@",
    "email@",
    "info.info",
    "contact.contact",
)

_UNICODE_BOUNDARY = "(?U)"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def email_denied(email: Column, deny: Sequence[str] = EMAIL_DENY) -> Column:
    """True where the address holds a denied part, in any letter case."""
    if not deny:
        return F.lit(False)
    return F.lower(email).rlike("|".join(rf"\Q{part}\E" for part in deny))


def find_emails(text: Column | str) -> Column:
    """Every address in ``text``, in reading order. The ``@`` test spares most rows the regex."""
    c = col(text)
    found = F.regexp_extract_all(c, F.lit(_UNICODE_BOUNDARY + EMAIL_PATTERN), F.lit(0))
    return F.when(F.contains(c, F.lit("@")), found).otherwise(empty_strings())


def extract_emails(text: Column | str, deny: Sequence[str] = EMAIL_DENY) -> Column:
    """Distinct usable addresses in order of first occurrence; ``[]`` for null text."""
    found = find_emails(text)
    if deny:
        found = F.filter(found, lambda e: ~email_denied(e, deny))
    return F.array_distinct(found)


def mailto_emails(hrefs: Column, deny: Sequence[str] = ()) -> Column:
    """Addresses of ``mailto:`` links: scheme and query dropped, ``@`` required.

    The deny-list does not apply to them unless one is passed.
    """
    links = F.filter(hrefs, lambda h: h.startswith("mailto:"))
    parts = F.transform(
        links,
        lambda h: utrim(F.split_part(F.replace(h, F.lit("mailto:"), F.lit("")), F.lit("?"), F.lit(1))),
    )
    kept = F.filter(parts, lambda e: F.contains(e, F.lit("@")))
    if deny:
        kept = F.filter(kept, lambda e: ~email_denied(e, deny))
    return F.array_distinct(kept)
