"""Phone candidates in text and their E.164 form by numbering-plan rules.

Validity is decided by length and leading digits per country. That is an approximation of a full
numbering-plan database: it accepts some numbers in unassigned ranges. Every calling code in use is
known; the region of a number is that of the longest prefix it begins with, since some codes are shared.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizcontacts.functions.emails import empty_strings
from bizcontacts.functions.text import col

# The three candidate patterns, applied in this order.
PHONE_PATTERNS = (
    r"\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{2,4}",
)

# Toll-free markers that rule a number out, for free text and for listing pages.
PHONE_DENY = ("800", "888", "877", "866", "855", "844", "833")
LISTING_PHONE_DENY = ("800", "888", "877")

DEFAULT_COUNTRY = "US"


class Plan(NamedTuple):
    """Numbering plan of one country: national length range and allowed first / fourth digits."""

    iso: str
    cc: str
    trunk: str
    idd: str
    min_len: int
    max_len: int
    lead: str
    fourth: str


# Fixed values, from the published national numbering plans:
# country, calling code, trunk prefix, international prefix, lengths, first digits, fourth digits.
NUMBERING_PLAN = tuple(
    Plan(f[0], f[1], f[2], f[3], int(f[4]), int(f[5]), f[6], f[7])
    for f in (
        line.split("|")
        for line in """
US|1|1|011|10|10|23456789|23456789
AE|971|0|00|8|9|23456789|
AL|355|0|00|8|9|23456789|
AT|43|0|00|6|13|123456789|
BA|387|0|00|8|9|3456|
BE|32|0|00|8|9|123456789|
BG|359|0|00|7|9|23456789|
BR|55|0|00|10|11|123456789|
CH|41|0|00|9|9|23456789|
CN|86|0|00|10|11|123456789|
CZ|420||00|9|9|23456789|
DE|49|0|00|6|11|123456789|
DK|45||00|8|8|23456789|
ES|34||00|9|9|56789|
FI|358|0|00|5|11|123456789|
FR|33|0|00|9|9|123456789|
GB|44|0|00|9|10|1235789|
GR|30||00|10|10|23456789|
HR|385|0|00|8|9|123456789|
HU|36|06|00|8|9|123456789|
IE|353|0|00|7|9|123456789|
IT|39||00|6|11|0138|
JP|81|0|010|9|10|123456789|
KR|82|0|00|8|10|123456789|
ME|382|0|00|8|8|23456|
MK|389|0|00|8|8|2345678|
MT|356||00|8|8|2379|
NL|31|0|00|9|9|123456789|
NO|47||00|8|8|23456789|
PL|48||00|9|9|123456789|
PT|351||00|9|9|23456789|
RO|40|0|00|9|9|23456789|
RS|381|0|00|7|10|123456789|
RU|7|8|810|10|10|3489|
SE|46|0|00|7|10|123456789|
SI|386|0|00|8|8|123456789|
SK|421|0|00|9|9|23456789|
TH|66|0|00|8|9|23456789|
TR|90|0|00|10|10|2345|
TW|886|0|00|8|9|23456789|
UA|380|0|00|9|9|3456789|
VN|84|0|00|9|10|23456789|
""".strip().splitlines()
    )
)

# Fixed values, from the published list of calling codes: code, country and the range of national lengths of
# the countries whose plans are not spelled out above.
_OTHER_CODES = """
20 EG 8 10, 211 SS 9 9, 212 MA 9 9, 213 DZ 8 9, 216 TN 8 8, 218 LY 8 9, 220 GM 7 7, 221 SN 9 9, 222 MR 8 8, 223 ML 8 8,
224 GN 8 9, 225 CI 10 10, 226 BF 8 8, 227 NE 8 8, 228 TG 8 8, 229 BJ 8 10, 230 MU 7 8, 231 LR 7 9, 232 SL 8 8, 233 GH 8 9,
234 NG 7 10, 235 TD 8 8, 236 CF 8 8, 237 CM 8 9, 238 CV 7 7, 239 ST 7 7, 240 GQ 9 9, 241 GA 7 8, 242 CG 9 9, 243 CD 7 9,
244 AO 9 9, 245 GW 7 9, 246 IO 7 7, 247 AC 4 6, 248 SC 7 7, 249 SD 9 9, 250 RW 8 9, 251 ET 9 9, 252 SO 6 9, 253 DJ 8 8,
254 KE 7 10, 255 TZ 9 9, 256 UG 9 9, 257 BI 8 8, 258 MZ 8 9, 260 ZM 9 9, 261 MG 9 9, 262 RE 9 9, 263 ZW 5 10, 264 NA 8 9,
265 MW 7 9, 266 LS 8 8, 267 BW 7 8, 268 SZ 8 8, 269 KM 7 7, 27 ZA 9 9, 290 SH 4 5, 291 ER 7 7, 297 AW 7 7, 298 FO 6 6, 299 GL 6 6,
350 GI 8 8, 352 LU 4 11, 354 IS 7 9, 357 CY 8 8, 370 LT 8 8, 371 LV 8 8, 372 EE 7 8, 373 MD 8 8, 374 AM 8 8, 375 BY 9 10,
376 AD 6 9, 377 MC 8 9, 378 SM 6 10, 383 XK 8 9, 423 LI 7 9,
500 FK 5 5, 501 BZ 7 7, 502 GT 8 8, 503 SV 8 8, 504 HN 8 8, 505 NI 8 8, 506 CR 8 8, 507 PA 7 8, 508 PM 6 9, 509 HT 8 8,
51 PE 8 9, 52 MX 10 10, 53 CU 6 8, 54 AR 10 11, 56 CL 9 9, 57 CO 8 10, 58 VE 10 10, 590 GP 9 9, 591 BO 8 8, 592 GY 7 7,
593 EC 8 9, 594 GF 9 9, 595 PY 7 9, 596 MQ 9 9, 597 SR 6 7, 598 UY 7 8, 599 CW 7 8,
60 MY 8 10, 61 AU 9 9, 62 ID 8 12, 63 PH 8 10, 64 NZ 8 10, 65 SG 8 8, 670 TL 7 8, 672 NF 6 6, 673 BN 7 7, 674 NR 7 7,
675 PG 7 8, 676 TO 5 7, 677 SB 5 7, 678 VU 5 7, 679 FJ 7 7, 680 PW 7 7, 681 WF 6 6, 682 CK 5 5, 683 NU 4 7, 685 WS 5 7,
686 KI 5 8, 687 NC 6 6, 688 TV 5 7, 689 PF 6 8, 690 TK 4 7, 691 FM 7 7, 692 MH 7 7,
850 KP 8 10, 852 HK 8 8, 853 MO 8 8, 855 KH 8 9, 856 LA 8 10, 880 BD 8 10,
91 IN 10 10, 92 PK 9 10, 93 AF 9 9, 94 LK 9 9, 95 MM 7 10, 960 MV 7 7, 961 LB 7 8, 962 JO 8 9, 963 SY 8 9, 964 IQ 8 10,
965 KW 8 8, 966 SA 9 9, 967 YE 7 9, 968 OM 8 8, 970 PS 8 9, 972 IL 8 9, 973 BH 8 8, 974 QA 8 8, 975 BT 7 8, 976 MN 8 8,
977 NP 8 10, 98 IR 10 10, 992 TJ 9 9, 993 TM 8 8, 994 AZ 9 9, 995 GE 9 9, 996 KG 9 9, 998 UZ 9 9
"""

# Regions that share the calling code of another one, and the prefixes that tell them apart.
_SHARED_CODES = """
CA 1204 1226 1236 1249 1250 1263 1289 1306 1343 1354 1365 1367 1368 1382 1403 1416 1418 1428 1431 1437 1438 1450 1468 1474 1506
CA 1514 1519 1548 1579 1581 1584 1587 1604 1613 1639 1647 1672 1683 1705 1709 1742 1753 1778 1780 1782 1807 1819 1825 1867 1873 1879 1902 1905
BS 1242
BB 1246
AI 1264
AG 1268
VG 1284
VI 1340
KY 1345
BM 1441
GD 1473
TC 1649
JM 1658 1876
MS 1664
MP 1670
GU 1671
AS 1684
SX 1721
LC 1758
DM 1767
VC 1784
PR 1787 1939
DO 1809 1829 1849
TT 1868
KN 1869
KZ 76 77
GG 441481
JE 441534
IM 441624
VA 3906698
SJ 4779
AX 35818
CX 6189164
CC 6189162
YT 262269 262639
BQ 5993 5994 5997
EH 2125288 2125289
"""


def _numbering() -> tuple[tuple[Plan, ...], tuple[tuple[str, str], ...]]:
    """All plans, one per region, and the regions by prefix."""
    plans = {p.iso: p for p in NUMBERING_PLAN}
    for entry in _OTHER_CODES.replace("\n", " ").split(","):
        cc, iso, shortest, longest = entry.split()
        plans[iso] = Plan(iso, cc, "0", "00", int(shortest), int(longest), "0123456789", "")
    regions = {p.cc: p.iso for p in plans.values()}
    for line in _SHARED_CODES.strip().splitlines():
        iso, *prefixes = line.split()
        for prefix in prefixes:
            owner = next(regions[prefix[:n]] for n in (1, 2, 3) if prefix[:n] in regions)
            plans[iso] = plans[owner]._replace(iso=iso)
        regions.update(dict.fromkeys(prefixes, iso))
    return tuple(plans.values()), tuple(sorted(regions.items()))


ALL_PLANS, PREFIXES = _numbering()
LONGEST_PREFIX = max(len(p) for p, _ in PREFIXES)

# Other digit signs a number may be written in, all mapped to 0-9.
_FOREIGN_DIGITS = "".join(chr(base + d) for base in (0x0660, 0x06F0, 0xFF10) for d in range(10))
_ASCII_DIGITS = "0123456789" * 3


def _plan_map(plans: dict[str, Plan]) -> Column:
    """Plans by key as one literal: a single node that Catalyst folds into a constant map."""
    fields = ", ".join(f"{n}: {'int' if n.endswith('_len') else 'string'}" for n in Plan._fields)
    text = json.dumps({key: p._asdict() for key, p in plans.items()})
    return F.from_json(F.lit(text), f"map<string, struct<{fields}>>")


def _longest(digits: Column, table: Column) -> Column:
    """Value of the longest prefix of ``digits`` in the map ``table``."""
    return F.coalesce(*[F.try_element_at(table, digits.substr(1, n)) for n in range(LONGEST_PREFIX, 0, -1)])


def phone_region(number: Column | str) -> Column:
    """ISO code of the region an international number (``+`` and digits) belongs to; null where none is known."""
    table = F.from_json(F.lit(json.dumps(dict(PREFIXES))), "map<string, string>")
    c = col(number)
    return F.when(c.startswith("+"), _longest(c.substr(F.lit(2), F.length(c)), table))


def _allowed(number: str, plan: str) -> str:
    """SQL test: length and leading digits fit the plan."""
    return (
        f"coalesce(length({number}) between {plan}.min_len and {plan}.max_len"
        f" and contains({plan}.lead, substr({number}, 1, 1))"
        f" and ({plan}.fourth = '' or contains({plan}.fourth, substr({number}, 4, 1))), false)"
    )


def _after(number: str, prefix: str) -> str:
    return f"substr({number}, length({prefix}) + 1)"


def _has_prefix(number: str, prefix: str) -> str:
    return f"({prefix} <> '' and startswith({number}, {prefix}))"


# The steps from a raw number (fields raw, home) to its spelling, each one pass over the array. They
# are written as SQL lambdas: one text is one call into the JVM, where each Column operation is one.
_READ = f"""s -> named_struct('home', s.home,
    'plus', translate(s.raw, '{_FOREIGN_DIGITS}', '{_ASCII_DIGITS}') rlike '^[^0-9]*[+]',
    'd', regexp_replace(translate(s.raw, '{_FOREIGN_DIGITS}', '{_ASCII_DIGITS}'), '[^0-9]', ''))"""

# international digits, if the number is written that way
_ROUTE = f"""s -> named_struct('home', s.home, 'd', s.d, 'intl', case when s.plus then s.d
    when {_has_prefix('s.d', 's.home.idd')} then {_after('s.d', 's.home.idd')} end)"""

_PICK = f"""s -> named_struct('plan', if(s.intl is not null, s.there, s.home),
    'n', if(s.intl is not null, {_after('s.intl', 's.there.cc')}, s.d))"""

# a calling code written without plus is dropped where only the rest is a valid number
_DROP_CC = f"""s -> named_struct('plan', s.plan, 'n', if({_has_prefix('s.n', 's.plan.cc')}
    and not {_allowed('s.n', 's.plan')} and {_allowed(_after('s.n', 's.plan.cc'), 's.plan')},
    {_after('s.n', 's.plan.cc')}, s.n))"""

# a trunk prefix goes, unless only the number with it is valid
_DROP_TRUNK = f"""s -> named_struct('plan', s.plan, 'n', if({_has_prefix('s.n', 's.plan.trunk')}
    and not ({_allowed('s.n', 's.plan')} and not {_allowed(_after('s.n', 's.plan.trunk'), 's.plan')}),
    {_after('s.n', 's.plan.trunk')}, s.n))"""

_SPELL = f"""s -> named_struct('n', s.n,
    'e164', if({_allowed('s.n', 's.plan')}, concat('+', s.plan.cc, s.n), null))"""


def may_hold_phone(text: Column | str) -> Column:
    """Necessary condition for any candidate: most texts hold no digit and are spared the patterns."""
    return col(text).rlike(r"(?U)\d")


def phone_candidates(text: Column | str) -> Column:
    """All pattern matches in ``text``: first those of pattern 1, then of 2, then of 3."""
    c = col(text)
    hits = [F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)) for p in PHONE_PATTERNS]
    return F.when(may_hold_phone(c), F.concat(*hits)).otherwise(empty_strings())


def e164_all(
    candidates: Column,
    country: Column,
    deny: Sequence[str] = PHONE_DENY,
    deny_mode: str = "anywhere",
    plans: Sequence[Plan] = ALL_PLANS,
) -> Column:
    """E.164 form of each candidate that is valid and not denied, distinct, in reading order.

    Each step is one pass over the array, so no sub-expression is evaluated twice per candidate.
    ``deny_mode`` is ``anywhere`` (a denied part at any place drops the number) or ``after_cc``
    (only right behind the calling code). Denied parts are plain text.
    """
    if deny_mode not in ("anywhere", "after_cc"):
        raise ValueError(f"deny_mode: {deny_mode!r}")
    by_iso = {p.iso: p for p in plans}
    home = F.try_element_at(_plan_map(by_iso), country)
    by_prefix = _plan_map({prefix: by_iso[iso] for prefix, iso in PREFIXES if iso in by_iso})

    def step(values: Column, text: str, function: str = "transform") -> Column:
        return F.call_function(function, values, F.expr(text))

    def abroad(s: Column) -> Column:
        """Adds the plan of the region dialled."""
        return s.withField("there", _longest(s["intl"], by_prefix))

    raw = F.transform(F.array_distinct(candidates), lambda c: F.struct(c.alias("raw"), home.alias("home")))
    routed = F.transform(step(step(raw, _READ), _ROUTE), abroad)
    spelt = step(step(step(step(routed, _PICK), _DROP_CC), _DROP_TRUNK), _SPELL)
    bad = F.lit(False)
    kept = step(spelt, "s -> s.e164 is not null", "filter")
    if deny:
        def denied(s: Column) -> Column:
            hits = [F.contains(s["e164"], F.lit(d)) if deny_mode == "anywhere" else F.startswith(s["n"], F.lit(d)) for d in deny]
            return reduce(or_, hits, bad)

        kept = F.filter(kept, lambda s: ~denied(s))
    return F.array_distinct(step(kept, "s -> s.e164"))


def e164(
    raw: Column | str,
    country: Column,
    deny: Sequence[str] = PHONE_DENY,
    deny_mode: str = "anywhere",
    plans: Sequence[Plan] = ALL_PLANS,
) -> Column:
    """E.164 form of one number; null where it is null, invalid or denied."""
    c = col(raw)
    one = F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(empty_strings())
    return F.try_element_at(e164_all(one, country, deny, deny_mode, plans), F.lit(1))


def extract_phones(
    text: Column | str,
    country: Column,
    deny: Sequence[str] = PHONE_DENY,
    deny_mode: str = "anywhere",
) -> Column:
    """Distinct valid numbers in ``text``, in the order the patterns find them."""
    return e164_all(phone_candidates(text), country, deny, deny_mode)
