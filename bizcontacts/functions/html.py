"""Reading stored HTML with patterns: text, company facts, links, social accounts.

A page is taken apart in linear passes: hidden parts go, tags become separators, and the tags of
interest become texts of attributes, in which quoted, unquoted and valueless ones are told apart. An
element left open ends with the page, so no pattern looks at the rest of a page more than once.
"""

from __future__ import annotations

import json
import re
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizcontacts.functions.emails import empty_strings
from bizcontacts.functions.text import col, utrim

# The commonest character references, tried before the whole table of names.
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&euro;", "€"),
    ("&amp;", "&"),
)
# Names that end in a semicolon, and the older ones that need none, by what they stand for.
NAMES = {n: sign for n, sign in html5.items() if n.endswith(";")}
OLD_NAMES = {n: sign for n, sign in html5.items() if not n.endswith(";")}
OLD_LENGTHS = range(max(map(len, OLD_NAMES)), min(map(len, OLD_NAMES)) - 1, -1)
# Numeric references into the C1 range mean the Windows-1252 character of that byte.
C1_SIGNS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
REPLACEMENT = "\ufffd"

# Labels an address follows, in order of priority, and the length looked at.
ADDRESS_LABELS = ("address:", "adres:", "adresse:", "indirizzo:", "dirección:")
ADDRESS_SPAN = 200
DESCRIPTION_LENGTH = 200

# Platforms and the domains that show them; the first platform that fits wins.
SOCIAL_PLATFORMS = {
    "facebook": ("facebook.com", "fb.com"),
    "instagram": ("instagram.com",),
    "linkedin": ("linkedin.com",),
    "twitter": ("twitter.com", "x.com"),
}

_HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*(?:>.*?(?:</script\s*>|\z)|\z)|style\b[^>]*(?:>.*?(?:</style\s*>|\z)|\z)"
    r"|!doctype[^>]*(?:>|\z))"
)
_TAG = r"(?s)</?[A-Za-z][^>]*(?:>|\z)"
# One attribute: name, and value in double, single or no quotes; the quotes are written as codes so
# that the pattern fits any literal.
_ATTRIBUTE = r"[^\s=/\x22\x27<>]+(?:\s*=\s*(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x22\x27>]*))?"
_NAME = r"^[^\s=]+"
_VALUE = r"(?s)=\s*(.*)$"
_QUOTES = r"(?s)^(?:\x22(.*)\x22|\x27(.*)\x27)$"


def visible_markup(page: Column | str) -> Column:
    """Markup without comments, scripts, styles and the document type, closed or not."""
    return F.regexp_replace(col(page), _HIDDEN, "")


def _table(signs: dict) -> str:
    """SQL of a constant map."""
    text = json.dumps(signs).replace("'", "\\u0027")
    return f"from_json(r'{text}', 'map<string, string>')"


def _sign(text: str) -> str:
    return "chr(39)" if text == "'" else f"'{text}'"


def _numeric() -> str:
    """SQL for a piece ``p`` that begins with ``#``: the character of the number, and what follows."""
    whole = "regexp_extract(p, r'^#(?:[0-9]+|[xX][0-9a-fA-F]+);?', 0)"
    tens = "try_cast(regexp_extract(p, r'^#0*([0-9]{1,9})(?:[^0-9]|$)', 1) as bigint)"
    hexed = "try_cast(conv(nullif(regexp_extract(p, r'^#[xX]0*([0-9a-fA-F]{1,7})(?:[^0-9a-fA-F]|$)', 1), ''), 16, 10) as bigint)"
    sign = f"""c -> case when c = 13 then chr(13)
        when c = 0 or c between 0xD800 and 0xDFFF or c > 0x10FFFF then '{REPLACEMENT}'
        when c between 0x80 and 0x9F then try_element_at({_table({str(n): c for n, c in C1_SIGNS.items()})}, cast(c as string))
        when c between 1 and 8 or c = 11 or c between 14 and 31 or c = 127 or c between 0xFDD0 and 0xFDEF
            or (c & 0xFFFF) in (0xFFFE, 0xFFFF) then ''
        else decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') end"""
    for code in sorted(set(re.findall("0x[0-9A-F]+", sign)), key=len, reverse=True):
        sign = sign.replace(code, str(int(code, 16)))
    one = f"element_at(transform(array(coalesce({tens}, {hexed}, {0x110000})), {sign}), 1)"
    return f"if({whole} = '', concat('&', p), concat({one}, substr(p, length({whole}) + 1)))"


def _named(attribute: bool) -> str:
    """SQL for a piece ``p``: its longest name decoded; without a semicolon only the older names count, and
    within attributes only where neither a letter, a digit nor ``=`` follows, as in addresses."""
    name, old = "regexp_extract(p, r'^[A-Za-z][A-Za-z0-9]{1,31};', 0)", _table(OLD_NAMES)
    tries = [f"concat(if({name} <> '', try_element_at({_table(NAMES)}, {name}), null), substr(p, length({name}) + 1))"]
    for n in OLD_LENGTHS:
        follows = f"not substr(p, {n + 1}, 1) rlike '[A-Za-z0-9=]'" if attribute else "true"
        tries.append(f"if({follows}, concat(try_element_at({old}, substr(p, 1, {n})), substr(p, {n + 1})), null)")
    return f"coalesce({', '.join(tries)}, concat('&', p))"


@cache
def _reference(attribute: bool) -> str:
    """SQL lambda over the pieces of a text cut at ``&``: puts back what each cut stood for."""
    common = " ".join(f"when startswith(p, '{r[1:]}') then concat({_sign(sign)}, substr(p, {len(r)}))" for r, sign in ENTITIES)
    return (f"(p, i) -> case when i = 0 then p {common} when startswith(p, '#') then {_numeric()}"
            f" when p rlike '^[A-Za-z]' then {_named(attribute)} else concat('&', p) end")


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """All character references decoded, named and numeric, in one pass over the places that hold an ``&``.

    The text is named once in the expression: what it is made of would be computed again for each mention.
    """
    return F.array_join(F.call_function("transform", F.split(text, "&"), F.expr(_reference(attribute))), "")


def tags(markup: Column, name: str) -> Column:
    """Attribute texts of all tags of that name, in page order; a tag left open ends with the page."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{name}([\s/][^>]*)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an attribute text, undecoded, the last one if it is repeated; null where it is missing."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)),
                     lambda a: F.lower(F.regexp_extract(a, _NAME, 0)) == name)
    value = F.regexp_extract(F.try_element_at(found, F.lit(-1)), _VALUE, 1)
    return F.regexp_replace(value, _QUOTES, "$1$2")


def markup_text(markup: Column, sep: str = " ") -> Column:
    return decode_entities(F.regexp_replace(markup, _TAG, sep))


def page_text(page: Column | str, sep: str = " ") -> Column:
    """Text of a page. ``sep`` stands where a tag was; '' joins neighbouring pieces directly."""
    return markup_text(visible_markup(page), sep)


def _filled(text: Column) -> Column:
    """Null for an empty text, which is named once."""
    return F.try_element_at(F.filter(F.array(text), lambda t: t != ""), F.lit(1))


def _inner(markup: Column, tag: str) -> Column:
    """Trimmed text of the first ``tag`` element, null where there is none or it is blank."""
    inside = F.regexp_extract(markup, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)", 1)
    return _filled(utrim(markup_text(inside, "")))


def meta_content(markup: Column, by: str, name: str) -> Column:
    """Content of the first meta tag whose attribute ``by`` is ``name``."""
    found = F.filter(tags(markup, "meta"), lambda t: F.coalesce(attribute(t, by) == name, F.lit(False)))
    content = attribute(F.try_element_at(found, F.lit(1)), "content")
    return _filled(utrim(decode_entities(content, True)))


def company_name(markup: Column) -> Column:
    """The site name a page declares, else its title, else its first heading."""
    return F.coalesce(meta_content(markup, "property", "og:site_name"), _inner(markup, "title"),
                      _inner(markup, "h1"))


def description(markup: Column) -> Column:
    return F.substring(meta_content(markup, "name", "description"), 1, DESCRIPTION_LENGTH)


def hrefs(markup: Column) -> Column:
    """Link targets of all anchors in page order, decoded."""
    found = F.transform(tags(markup, "a"), lambda t: attribute(t, "href"))
    return F.transform(F.filter(found, lambda h: h.isNotNull()), lambda h: decode_entities(h, True))


def address_snippet(text: Column) -> Column:
    """Text from the first label found (by label priority) to the end of its line, 200 signs at most."""
    low = F.lower(text)
    found = []
    for label in ADDRESS_LABELS:
        at = F.instr(low, F.lit(label))
        line = F.split_part(F.substr(text, at, F.lit(ADDRESS_SPAN)), F.lit("\n"), F.lit(1))
        found.append(F.when(F.contains(low, F.lit(label)), utrim(line)))
    return F.coalesce(*found)


# Host of a link, as SQL over a lambda variable h.
_HOST_OF_H = "lower(regexp_replace(regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', ''))"


def _on_platform(platform: str, host_match: bool) -> str:
    tests = []
    for d in SOCIAL_PLATFORMS[platform]:
        if host_match:
            tests.append(f"{_HOST_OF_H} = '{d}' or endswith({_HOST_OF_H}, '.{d}')")
        else:
            tests.append(f"contains(h, '{d}')")
    return "(" + " or ".join(tests) + ")"


def social_links(links: Column, host_match: bool = False) -> Column:
    """Map platform -> last link of that platform on the page; stays inside the record.

    A link belongs to the first platform it fits. The plain test looks for the domain anywhere in
    the link, so ``netflix.com`` counts for ``x.com``; ``host_match`` compares the host instead.
    """
    entries, earlier = [], []
    for platform in SOCIAL_PLATFORMS:
        test = _on_platform(platform, host_match)
        alone = " and ".join([test, *[f"not {e}" for e in earlier]])
        earlier.append(test)
        own = F.call_function("filter", links, F.expr(f"h -> {alone}"))
        entries.append(F.struct(F.lit(platform).alias("key"), F.try_element_at(own, F.lit(-1)).alias("value")))
    return F.map_from_entries(F.call_function("filter", F.array(*entries), F.expr("e -> e.value is not null")))


def tel_texts(markup: Column, links: Column | None = None) -> Column:
    """Numbers of ``tel:`` links: first those of item ids, then those of link targets."""
    ids = F.regexp_extract_all(markup, F.lit(r"""(?is)\bdata-item-id\s*=\s*["']phone:tel:([^"']*)["']"""), F.lit(1))
    called = F.filter(hrefs(markup) if links is None else links, lambda h: h.startswith("tel:"))
    numbers = F.transform(called, lambda h: F.substr(h, F.lit(5)))
    return F.when(F.contains(markup, F.lit("tel:")), F.concat(ids, numbers)).otherwise(empty_strings())


# Words whose presence in a label marks an element as showing a phone number, and the section that does.
PHONE_LABELS = ("Phone", "Call", "phone", "Telefon", "Téléphone", "Telefono", "Teléfono")


PHONE_SECTION = "pn0"
_LABELLED = rf"""\baria-label\s*=\s*["']([^"']*(?:{"|".join(PHONE_LABELS)})[^"']*["'][^>]*>[^<]*)"""
_SECTION = rf"""\bdata-section-id\s*=\s*["']{PHONE_SECTION}["'][^>]*>([^<]*)"""


def labelled_phone_texts(markup: Column) -> Column:
    """Texts of the phone section, then labels of elements that show a phone number: a fallback for pages
    without ``tel:``."""
    def texts(pattern: str, mark: str) -> Column:
        found = F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))
        return F.when(F.contains(markup, F.lit(mark)), found).otherwise(empty_strings())

    return F.concat(texts(_SECTION, "data-section-id"), texts(_LABELLED, "aria-label"))
