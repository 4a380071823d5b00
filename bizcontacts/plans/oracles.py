"""SQL with the same result as each registered query, written for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from bizcontacts.functions import classify as K
from bizcontacts.functions import emails as E
from bizcontacts.functions import html as H
from bizcontacts.functions import listing as L
from bizcontacts.functions import phones as N
from bizcontacts.functions import urls as U
from bizcontacts.plans import register as R
from bizcontacts.plans.views import VIEWS, ansi
from bizcontacts.sources import dims


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """Pattern literal; RE2 knows no (?U), its classes are ASCII, which the tables do not exceed."""
    return lit(pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?iu)", "(?i)"))


def has_any(text: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def norm(c: str) -> str:
    return f"lower({trim(f'coalesce({c}, {lit(str())})')})"


def present(c: str) -> str:
    return f"({norm(c)} not in ('', 'nan'))"


def whole_key(c: str) -> str:
    return f"replace(regexp_replace({c}, '[<>:\"/\\\\|?*]', '', 'g'), ' ', '_')"


def key(c: str) -> str:
    return f"substr({whole_key(c)}, 1, 100)"


def with_views(names: Sequence[str], *ctes: str) -> str:
    parts = [f"{n} as ({ansi(n)})" for n in names if n in VIEWS]
    return "with " + ",\n".join([*parts, *ctes])


def first_match(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {rx(pattern)}, {group}), '')"


# --- building blocks ---------------------------------------------------------------------------

EMAILS = f"regexp_extract_all(text, {rx(E.EMAIL_PATTERN)})"
# a no-break space is white space to the patterns, but not to RE2
CANDS = " || ".join(f"regexp_extract_all(replace(text, chr(160), ' '), {rx(p)})" for p in N.PHONE_PATTERNS)
LANG_ISO = "case when lang = 'en' then 'US' else upper(lang) end"
PLAN = "(select * from " + dims.values_sql(N.Plan._fields, N.ALL_PLANS, "pl") + ")"
PREFIX = "(select * from " + dims.values_sql(("prefix", "iso"), N.PREFIXES, "px") + ")"


def denied_email(c: str, deny: Sequence[str]) -> str:
    return has_any(f"lower({c})", deny)


def _ok(n: str, p: str) -> str:
    return (
        f"coalesce(length({n}) between {p}.min_len and {p}.max_len and contains({p}.lead, substr({n}, 1, 1))"
        f" and substr({n}, 1, 1) <> ''"
        f" and ({p}.fourth = '' or contains({p}.fourth, substr({n}, 4, 1))), false)"
    )


def e164_ctes(source: str, carry: str, deny: Sequence[str], mode: str = "anywhere", tag: str = "") -> list[str]:
    """CTEs from ``source(carry..., iso, raw)`` to ``e164{tag}(carry..., iso, raw, e164)``; one row
    per candidate that is a valid number."""
    target = "concat(p.cc, n4)" if mode == "anywhere" else None
    bad = (
        has_any(target, deny) if target and deny
        else "(" + " or ".join(f"starts_with(n4, {lit(d)})" for d in deny) + ")" if deny else "false"
    )
    rest3, rest4 = "substr(n, length(p.cc) + 1)", "substr(n3, length(p.trunk) + 1)"
    return [
        f"plan{tag} as {PLAN}",
        f"prefix{tag} as {PREFIX}",
        f"""s0{tag} as (select distinct {carry}, iso, raw, regexp_replace(raw, '[^0-9]', '', 'g') as d,
            regexp_matches(raw, '^[^0-9]*\\+') as plus from {source})""",
        f"""s1{tag} as (select s.*, case when plus then d when starts_with(d, h.idd) then substr(d, length(h.idd) + 1)
            end as intl from s0{tag} s left join plan{tag} h on h.iso = s.iso)""",
        f"""r{tag} as (select intl as dialled, arg_max(iso, length(prefix)) as there
            from (select distinct intl from s1{tag}) join prefix{tag} on starts_with(intl, prefix) group by intl)""",
        f"""s2{tag} as (select s.*, case when intl is not null then there else s.iso end as piso,
            case when intl is not null then substr(intl, length(a.cc) + 1) else d end as n
            from s1{tag} s left join r{tag} on dialled = intl left join plan{tag} a on a.iso = there)""",
        f"""s3{tag} as (select s.*, case when starts_with(n, p.cc) and not {_ok('n', 'p')} and {_ok(rest3, 'p')}
            then {rest3} else n end as n3 from s2{tag} s join plan{tag} p on p.iso = s.piso)""",
        f"""s4{tag} as (select s.*, case when p.trunk <> '' and starts_with(n3, p.trunk)
            and not ({_ok('n3', 'p')} and not {_ok(rest4, 'p')}) then {rest4} else n3 end as n4
            from s3{tag} s join plan{tag} p on p.iso = s.piso)""",
        f"""e164{tag} as (select s.*, '+' || p.cc || n4 as e164 from s4{tag} s join plan{tag} p on p.iso = s.piso
            where {_ok('n4', 'p')} and not {bad})""",
    ]


def markup(html: str = "html") -> str:
    return f"regexp_replace({html}, {rx(H._HIDDEN)}, '', 'g')"


def _cases(value: str, signs: dict) -> str:
    return f"case {value} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in signs.items()) + " end"


# Names the views use, and all that go without a semicolon.
_NAMES = {n: H.NAMES[n] for n in (*[f"{old};" for old in H.OLD_NAMES], "hellip;", "euro;", "apos;")}


def _numeric(p: str) -> str:
    whole = f"regexp_extract({p}, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?')"
    tens = f"try_cast(nullif(regexp_extract({p}, '^#0*([0-9]{{1,9}})(?:[^0-9]|$)', 1), '') as bigint)"
    hexed = f"try_cast('0x' || nullif(regexp_extract({p}, '^#[xX]0*([0-9a-fA-F]{{1,7}})(?:[^0-9a-fA-F]|$)', 1), '') as bigint)"
    code = f"coalesce({tens}, {hexed}, 1114112)"
    c1 = "case c " + " ".join(f"when {n} then {lit(sign)}" for n, sign in H.C1_SIGNS.items()) + " end"
    sign = (f"case when c = 13 then chr(13) when c = 0 or c between 55296 and 57343 or c > 1114111 then {lit(H.REPLACEMENT)}"
            f" when c between 128 and 159 then {c1} when c between 1 and 8 or c = 11 or c between 14 and 31 or c = 127"
            " or c between 64976 and 65007 or (c & 65535) in (65534, 65535) then '' else chr(cast(c as integer)) end")
    return (f"case when {whole} = '' then '&' || {p} else list_transform([{code}], lambda c: {sign})[1]"
            f" || substr({p}, length({whole}) + 1) end")


def _named(p: str, attribute: bool) -> str:
    name = f"regexp_extract({p}, '^[A-Za-z][A-Za-z0-9]{{1,31}};')"
    tries = [f"{_cases(name, _NAMES)} || substr({p}, length({name}) + 1)"]
    for n in H.OLD_LENGTHS:
        sign = _cases(f"substr({p}, 1, {n})", {k: v for k, v in H.OLD_NAMES.items() if len(k) == n})
        if attribute:
            sign = f"case when not regexp_matches(substr({p}, {n + 1}, 1), '[A-Za-z0-9=]') then {sign} end"
        tries.append(f"{sign} || substr({p}, {n + 1})")
    return f"coalesce({', '.join(tries)}, '&' || {p})"


def entities(text: str, attribute: bool = False) -> str:
    common = " ".join(f"when starts_with(p, {lit(r[1:])}) then {lit(sign)} || substr(p, {len(r)})" for r, sign in H.ENTITIES)
    return (f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: case when i = 1 then p {common}"
            f" when starts_with(p, '#') then {_numeric('p')} else {_named('p', attribute)} end), '')")


def text_of(m: str, sep: str = " ") -> str:
    return entities(f"regexp_replace({m}, {rx(H._TAG)}, {lit(sep)}, 'g')")


def inner(m: str, tag: str) -> str:
    found = f"regexp_extract({m}, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|\\z)', 1)"
    return f"nullif({trim(text_of(found, ''))}, '')"


def tags(m: str, name: str) -> str:
    return f"regexp_extract_all({m}, '(?is)<{name}([\\s/][^>]*)', 1)"


def attribute(tag: str, name: str) -> str:
    found = (f"list_filter(regexp_extract_all({tag}, {rx(H._ATTRIBUTE)}), "
             f"lambda a: lower(regexp_extract(a, {rx(H._NAME)})) = '{name}')[-1]")
    value = f"regexp_extract({found}, {rx(H._VALUE)}, 1)"
    return rf"regexp_replace({value}, {rx(H._QUOTES)}, '\1\2')"


def meta(m: str, by: str, name: str) -> str:
    found = f"list_filter({tags(m, 'meta')}, lambda t: {attribute('t', by)} = '{name}')[1]"
    return f"nullif({trim(entities(attribute(found, 'content'), True))}, '')"


def company(m: str) -> str:
    return f"coalesce({meta(m, 'property', 'og:site_name')}, {inner(m, 'title')}, {inner(m, 'h1')})"


def about(m: str) -> str:
    return f"substr({meta(m, 'name', 'description')}, 1, {H.DESCRIPTION_LENGTH})"


def links(m: str) -> str:
    found = f"list_filter(list_transform({tags(m, 'a')}, lambda t: {attribute('t', 'href')}), lambda h: h is not null)"
    return f"list_transform({found}, lambda h: {entities('h', True)})"


def snippet(t: str) -> str:
    def one(label: str) -> str:
        at = f"instr(lower({t}), {lit(label)})"
        line = f"split_part(substr({t}, {at}, {H.ADDRESS_SPAN}), chr(10), 1)"
        return f"case when {at} > 0 then {trim(line)} end"

    return "coalesce(" + ", ".join(one(x) for x in H.ADDRESS_LABELS) + ")"


AUTHORITY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
HOST = f"lower(regexp_replace({AUTHORITY}, '^.*@|:[0-9]*$', '', 'g'))"
SITE_KEY = r"regexp_replace(host, '^www\.', '')"
BASE = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {AUTHORITY}"
TLD = f"upper(string_split({AUTHORITY}, '.')[-1])"
TLD_ISO = "case " + TLD + " " + " ".join(f"when '{k}' then '{v}'" for k, v in U.TLD_COUNTRY.items()) + " else 'US' end"

# pages_contact -> one row per page with every contact field
CONTACTS = [
    f"marked as (select page_id, url, {markup()} as m from pages_contact)",
    f"""pread as (select page_id, url, m, {text_of('m')} as text, {links('m')} as hrefs, {HOST} as host, {TLD_ISO} as iso
        from marked)""",
    f"""pmails as (select page_id, host, unnest(list_filter({EMAILS}, lambda e: not {denied_email('e', R.DENY)})
            || list_filter(list_transform(list_filter(hrefs, lambda h: starts_with(h, 'mailto:')),
               lambda h: {trim("split_part(replace(h, 'mailto:', ''), '?', 1)")}), lambda e: contains(e, '@'))) as email
        from pread)""",
    "pmail as (select distinct page_id, host, email from pmails)",
    f"pcand as (select page_id, iso, unnest({CANDS}) as raw, generate_subscripts({CANDS}, 1) as k from pread)",
    *e164_ctes("pcand", "page_id, k", N.PHONE_DENY, tag="p"),
    f"""ptels as (select page_id, iso, list_transform(list_filter(hrefs, lambda h: starts_with(h, 'tel:')), lambda h: substr(h, 5))
        || regexp_extract_all(m, {rx(H._SECTION)}, 1) || regexp_extract_all(m, {rx(H._LABELLED)}, 1) as tels from pread)""",
    "ptel as (select page_id, iso, unnest(tels) as text, generate_subscripts(tels, 1) as place from ptels)",
    f"tcand as (select page_id, iso, place, unnest({CANDS}) as raw, generate_subscripts({CANDS}, 1) as k from ptel)",
    *e164_ctes("tcand", "page_id, place, k", N.LISTING_PHONE_DENY, tag="t"),
    f"""contacts as (select r.page_id, url, host, {company('m')} as company_name, {about('m')} as description,
          coalesce((select string_agg(email, ',' order by email) from pmail e where e.page_id = r.page_id), '') as emails,
          coalesce((select string_agg(distinct e164, ',' order by e164) from e164p e where e.page_id = r.page_id), '') as phones,
          (select arg_min(e164, k) from e164p e where e.page_id = r.page_id) as phone,
          (select arg_min(e164, struct_pack(a := place, b := k)) from e164t e where e.page_id = r.page_id) as listed_phone,
          {snippet('text')} as address, hrefs
        from pread r)""",
]


def platform(h: str) -> str:
    whens = " ".join(f"when {has_any(h, d)} then '{p}'" for p, d in H.SOCIAL_PLATFORMS.items())
    return f"case {whens} end"


def social(p: str) -> str:
    return f"list_filter(hrefs, lambda h: {platform('h')} = '{p}')[-1] as {p}"


# contacts -> one row per site
_PLACES = " ".join(f"when {lit(p)} then {i}" for i, p in enumerate(U.CONTACT_PATHS))
SITES = [
    f"""ranked as (select *, row_number() over (partition by host order by
          case regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')
            {_PLACES} else 99 end, url, page_id) as rk from contacts where host <> '')""",
    "smail as (select distinct host, email from pmail)",
    f"""sites as (select host, {BASE} as website, company_name, phone, phones, address, description,
          (select min(email) from smail e where e.host = r.host) as email,
          (select string_agg(email, ', ' order by email) from smail e where e.host = r.host) as all_emails,
          {", ".join(social(p) for p in H.SOCIAL_PLATFORMS)}
        from ranked r where rk = 1)""",
]


def crawl_case() -> str:
    low = "lower(coalesce(error, ''))"
    return (
        f"case when {has_any(low, K.TLS_FATAL_MARKERS)} then 'tls_fatal'"
        f" when {has_any(low, K.TRANSIENT_MARKERS)} then 'transient'"
        f" when status in {K.RETRYABLE_STATUS} then 'retryable_status'"
        " when status = 200 then 'ok' else 'other' end"
    )


# leads -> survivors of both passes; ``src`` is the name of the input
def cascade(src: str) -> list[str]:
    return [
        f"""d0 as (select *, {norm('phone')} as p, {norm('business_name')} as n, {norm('address')} as a from {src})""",
        """d1 as (select *, p not in ('', 'nan') and n not in ('', 'nan') as k1,
            n not in ('', 'nan') and a not in ('', 'nan') as k2 from d0)""",
        """d2 as (select * from (select *, row_number() over (partition by k1, case when k1 then p end,
            case when k1 then n end, case when k1 then 0 else ord end order by ord) as r1 from d1) where r1 = 1)""",
        """kept as (select * from (select *, row_number() over (partition by k2, case when k2 then n end,
            case when k2 then a end, case when k2 then 0 else ord end order by k1 desc, ord) as r2 from d2) where r2 = 1)""",
    ]


def pct(part: str, total: str) -> str:
    return f"round(100.0::double * {part} / nullif({total}, 0), 1)"


CITY = dims.values_sql(dims.CITY_COLUMNS, dims.city_rows(), "c")
LANG = dims.values_sql(dims.LANGUAGE_COLUMNS, dims.language_rows(), "l")
EXACT = LANG.replace(") as l(", ") as le(")
BASE_LANG = LANG.replace(") as l(", ") as lb(")
LCOUNTRY = dims.values_sql(("language", "country"), dims.language_country_rows(), "x")
KEYWORD = dims.values_sql(("business_type", "language", "keyword"), dims.keyword_rows(), "k")
COUNTRY = dims.values_sql(("iso", "country_name"), dims.country_rows(), "c")
LANG_NORM = norm("s.language")
LANG_BASE = f"split_part({LANG_NORM}, '-', 1)"


def zoom(r: str) -> str:
    return "case " + " ".join(f"when {r} <= {a} then {z}" for a, z in L.ZOOM_STEPS) + f" else {L.ZOOM_WIDEST} end"


def digest(name: str, table: str, id_: str, expr: str, views: Sequence[str] = ()) -> str:
    head = with_views(views) if views else ""
    return f"{head} select {id_}, length(t) as n, md5(t) as digest from (select {id_}, {expr} as t from {table})"


def _term_rows() -> str:
    rows = []
    for line in R.TERM_LINES:
        grp, seq, term_key, keyword, language = line.split("|")
        rows.append((grp, int(seq), term_key, keyword, language))
    return dims.values_sql(("grp", "term_seq", "term_key", "keyword", "language"), rows, "t")


def _folder(iso: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in dims.COUNTRY_FOLDERS.items())
    return f"case {iso} {whens} else {iso} end"


def price_test(t: str) -> str:
    return (
        f"(regexp_matches({t}, {rx(L.PRICE_SIGNS)}) or regexp_matches({t}, {rx(L.PRICE_SPAN)})"
        f" or regexp_matches({t}, {rx(f'(?iu)^({L.PRICE_WORDS})$')}))"
    )


def clean(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def stats_columns() -> str:
    cols = ["count(*) as total_businesses"]
    cols += [f"count(*) filter (where {present(c)}) as with_{c}" for c in ("phone", "email", "website")]
    cols += ["count(rating) as with_rating", "count(distinct city) as unique_cities"]
    return ", ".join(cols)


RATING = f"try_cast(replace({first_match('rating_label', L.RATING_LABEL)}, ',', '.') as double)"
BARE = f"try_cast(replace({first_match(trim('rating_text'), L.RATING_TEXT)}, ',', '.') as double)"
REVIEW = "concat(coalesce(review_label, ''), '')"
PARTS = "string_split(address, ',')"
SEAT = f"case when len({PARTS}) > 2 then {trim(PARTS + '[-2]')} else {trim(PARTS + '[-1]')} end"

CITY_OF = f"case when len({PARTS}) >= 2 then nullif({trim(f'regexp_replace({SEAT}, {rx(L.POSTAL_CODE)}, {lit(str())}, {lit(chr(103))})')}, '') end"
POSTAL_OF = f"case when len({PARTS}) >= 2 then {first_match(trim(PARTS + '[-1]'), L.POSTAL_CODE, 0)} end"
RATING_OF = f"coalesce(nullif({RATING}, 0.0), case when {BARE} between 1.0 and 5.0 then {BARE} end)"
HOURS_T, PRICE_T = trim("hours_text"), trim("price_text")
HOURS_OF = (
    f"case when regexp_matches({HOURS_T}, {rx(L.TIME_RANGE)}) and length({HOURS_T}) < {L.HOURS_MAX_LENGTH}"
    f" and regexp_matches({HOURS_T}, {rx('(?iu)' + L.HOURS_WORDS)}) then {clean('hours_text')} end"
)
PRICE_OF = f"case when {price_test(PRICE_T)} then {clean('price_text')} end"
WEBSITE_OF = f"""case when not starts_with(website, 'mailto:') and website <> '' then
    case when contains(website, {lit(L.REDIRECT_MARK)}) then
    coalesce(url_decode({first_match('website', '[?&]q=([^&]+)')}), website) else website end end"""

ORACLES: dict[str, str] = {
    # text and contacts
    "q_doc_emails": f"""select distinct doc_id, email from (select doc_id, unnest({EMAILS}) as email from documents)
        where not {denied_email('email', R.DENY)}""",
    "q_email_denylist": f"""select source, count(*) as found,
          count(*) filter (where {denied_email('email', E.EMAIL_DENY)}) as denied_full,
          count(*) filter (where {denied_email('email', R.DENY)}) as denied_short
        from (select source, unnest({EMAILS}) as email from documents) group by source""",
    "q_phone_candidates": f"select doc_id, unnest({CANDS}) as candidate from documents",
    "q_doc_phones": "with " + ",\n".join([
        f"cand as (select doc_id, lang, {LANG_ISO} as iso, unnest({CANDS}) as raw from documents)",
        *e164_ctes("cand", "doc_id, lang", N.PHONE_DENY),
    ]) + " select distinct doc_id, lang, e164 as phone from e164",
    "q_phone_prefix": with_views(["dialled"],
        *e164_ctes("(select ord, 'US' as iso, number as raw from dialled)", "ord", ()))
        + f""" select d.ord, d.number, (select arg_max(iso, length(prefix)) from {PREFIX}
          where starts_with(substr(number, 2), prefix)) as region, e164 from dialled d left join e164 using (ord)""",
    "q_phone_denylist": "with " + ",\n".join([
        f"cand as (select doc_id, lang, 'US' as iso, unnest({CANDS}) as raw from documents)",
        *e164_ctes("cand", "doc_id, lang", (), tag="n"),
        *e164_ctes("cand", "doc_id, lang", N.PHONE_DENY, tag="a"),
        *e164_ctes("cand", "doc_id, lang", N.PHONE_DENY, "after_cc", tag="c"),
        *[f"t{t} as (select lang, count(distinct (doc_id, e164)) as k from e164{t} group by lang)" for t in "nac"],
    ]) + """ select l.lang, coalesce(tn.k, 0) as valid, coalesce(ta.k, 0) as anywhere, coalesce(tc.k, 0) as after_cc
        from (select distinct lang from documents) l left join tn using (lang) left join ta using (lang)
        left join tc using (lang)""",
    "q_contact_coverage": "with " + ",\n".join([
        f"cand as (select doc_id, {LANG_ISO} as iso, unnest({CANDS}) as raw from documents)",
        *e164_ctes("cand", "doc_id", N.PHONE_DENY),
        f"""mails as (select distinct doc_id from (select doc_id, unnest({EMAILS}) as email from documents)
            where not {denied_email('email', R.DENY)})""",
        """c as (select source, count(*) as total,
            count(*) filter (where doc_id in (select doc_id from mails)) as with_email,
            count(*) filter (where doc_id in (select doc_id from e164)) as with_phone from documents group by source)""",
    ]) + f" select *, {pct('with_email', 'total')} as email_percentage, {pct('with_phone', 'total')} as phone_percentage from c",
    "q_clean_text": digest("clean", "documents", "doc_id", clean("text")),
    "q_text_norm": digest("norm", "documents", "doc_id", norm("text")),
    # pages
    "q_page_text": digest("text", "pages", "page_id", text_of(markup())),
    "q_company_info": with_views(["pages_contact"], f"k as (select page_id, {markup()} as m from pages_contact)")
        + f" select page_id, {company('m')} as company_name, {about('m')} as description from k",
    "q_page_links": f"""select distinct host, split_part(h, '?', 1) as link
        from (select {HOST} as host, unnest({links(markup())}) as h from pages)""",
    "q_url_frontier": with_views(["domain_list"],
        f"""u as (select case when regexp_matches(b, '^https?://') then b else 'https://' || b end as url
             from (select regexp_replace({trim('line')}, '/+$', '') as b from domain_list
                   where not starts_with(line, '#') and {trim('line')} <> ''))""")
        + f""" select distinct {BASE} as base, i as position, {BASE} || p as page_url from u,
        {dims.values_sql(('i', 'p'), list(enumerate(U.CONTACT_PATHS))[:U.MAX_PAGES_PER_SITE], 'w')}""",
    "q_tld_country": with_views(["page_sites"]) + f" select page_id, {TLD_ISO} as country from page_sites",
    "q_sanitize_key": f"""select page_id, {key("concat('a/b:c? " + '"' + "', t, '|<x>*')")} as key from
        (select page_id, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1) as t from pages)""",
    # pages with contacts
    "q_page_contacts": with_views(["pages_contact"], *CONTACTS)
        + """ select page_id, host, company_name, emails, phones, listed_phone, address, description from contacts""",
    "q_domain_contacts": with_views(["pages_contact"], *CONTACTS, *SITES)
        + """ select company_name, website, email, all_emails, phone, nullif(phones, '') as all_phones, address, description,
        facebook, instagram, linkedin, twitter from sites""",
    "q_domain_stats": with_views(["pages_contact"], *CONTACTS, *SITES,
        """agg as (select count(*) as total_domains, count(all_emails) as with_email,
             count(nullif(phones, '')) as with_phone, count(company_name) as with_company from sites)""")
        + f""" select *, {pct('with_email', 'total_domains')} as email_percentage,
        {pct('with_phone', 'total_domains')} as phone_percentage,
        {pct('with_company', 'total_domains')} as company_percentage from agg""",
    "q_site_emails": with_views(["pages_contact"], *CONTACTS)
        + " select host, email, count(*) as n_pages from pmail group by host, email",
    "q_address_snippet": with_views(["pages_contact"], f"t as (select page_id, {text_of(markup())} as t from pages_contact)")
        + f" select page_id, {snippet('t')} as address from t",
    "q_social_links": with_views(["pages_contact"], f"l as (select page_id, {links(markup())} as hrefs from pages_contact)")
        + f" select page_id, {', '.join(social(p) for p in H.SOCIAL_PLATFORMS)} from l",
    "q_page_class": with_views(["pages_contact"],
        f"""c as (select page_id, html, lower(url) as u, lower({text_of(markup())}) as b,
             lower(regexp_extract({markup()}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) as t from pages_contact)""")
        + f""" select page_id, case when contains(u, {lit(K.CONSENT_URL)}) or {has_any('b', K.CONSENT_PHRASES)} then 'consent'
          when {" or ".join(f"regexp_matches(html, {rx('(?s)' + p)})" for p in K.CAPTCHA_MARKUP)}
            or {has_any('b', K.CAPTCHA_PHRASES)}
            or (contains(u, 'sorry') and (contains(t, 'captcha') or contains(t, 'robot'))) then 'captcha'
          when contains(u, {lit(K.BLOCK_URL)}) or {has_any('b', K.BLOCK_PHRASES)} then 'blocked'
          when {has_any('b', K.POPUP_PHRASES)} then 'popup' else 'content' end as page_class from c""",
    "q_enrich_email": with_views(["pages_contact", "page_leads"], *CONTACTS,
        f"first_mail as (select {SITE_KEY} as site, min(email) as site_email from pmail group by 1)",
        f"""w as (select *, case when regexp_matches(website, '^https?://') then website else 'https://' || website end as url
             from page_leads)""")
        + f""" select ord, business_name, case when {present('email')} or website is null then email
          else coalesce(site_email, email) end as email, website
        from w left join first_mail on site = {SITE_KEY.replace('host', HOST)}""",
    # crawl log
    "q_crawl_outcomes": with_views(["crawl_log"])
        + f""" select url, count(*) as attempts, count(*) filter (where status = 200) as ok_attempts,
        arg_max({crawl_case()}, struct_pack(a := ts, b := event_id)) as outcome from crawl_log group by url""",
    "q_crawl_errors": with_views(["crawl_log"])
        + f" select {crawl_case()} as error_class, count(*) as attempts from crawl_log group by 1",
    # leads
    "q_lead_dedup": with_views(["leads_raw"], *cascade("leads_raw"))
        + """ select ord, business_name, phone, address, city, rating,
        cast(case when k2 then 0 when k1 then 1 else 2 end as bigint) as part from kept""",
    "q_unkeyed_dedup": with_views(["leads_raw"])
        + f""" select city, count(*) as n_rows from leads_raw where not ({present('phone')} and {present('business_name')})
        and not ({present('business_name')} and {present('address')}) group by city""",
    "q_lead_rows": """with d as (select *, o_custkey % 2 = 0 as even from orders where o_orderkey % 17 <> 0 and o_orderkey % 19 <> 0)
        select 'part_' || (o_custkey % 6) || '.csv' as file, cast(10 + o_orderkey as bigint) as pos,
          case when even then 'Shop "' || o_custkey || '", Ltd' else 'Caf, ' || o_custkey end as business_name,
          case when even and o_orderkey % 5 <> 0 then '+4420' || o_orderkey end as phone,
          case when even then 'Town' end as city, case when not even then '0' || (o_orderkey % 900) end as postal_code,
          case when even then (o_orderkey % 50) + 0.5::double when o_orderkey % 7 <> 0 then (o_orderkey % 9)::double end as rating,
          case when even then 'n, ' || o_orderkey else 'first' end as note,
          case when not even then 'second' end as second_note from d""",
    "q_lead_rejects": with_views(["lead_lines", "lead_file_list"])
        + """ select file, pos, 'long' as reason, line as record from lead_lines
        where pos >= 10 and (pos - 10) % 17 = 0 and (pos - 10) % 19 <> 0
        union all select file, cast(null as bigint), 'empty', cast(null as varchar) from lead_file_list
        where file not in (select file from lead_lines where trim(line) <> '')""",
    "q_dedup_report": with_views(["leads_raw"], *cascade("leads_raw"))
        + """ select b as rows_before, a as rows_after, b - a as removed
        from (select (select count(*) from leads_raw) as b, (select count(*) from kept) as a)""",
    "q_merge_dedup": with_views(["leads_raw"],
        "merged as (select * replace (case when ord % 2 = 1 then rating end as rating) from leads_raw)",
        *cascade("merged"))
        + " select ord, business_name, phone, address, rating from kept",
    "q_lead_stats": with_views(["leads_raw"], f"s as (select {stats_columns()} from leads_raw)")
        + " select *, " + ", ".join(
            f"{pct(f'with_{c}', 'total_businesses')} as {c}_percentage" for c in ("phone", "email", "website")
        ) + " from s",
    "q_present_mask": with_views(["leads_raw"]) + " select ord, " + ", ".join(
        f"{present(c)} as has_{c}" for c in ("business_name", "phone", "email", "address")
    ) + " from leads_raw",
    "q_export_projection": with_views(["leads_raw"])
        + f""" select nullif({clean('business_name')}, '') as business_name, phone, email, address, city, review_count,
        '{R.STAMP}' as scraped_date, 'ice cream' as search_keyword, 'Halle (Saale)' as search_city,
        'Halle_(Saale)_ice_cream_20240102_030405' as result from leads_raw""",
    "q_topk_per_search": with_views(["leads_raw"])
        + """ select ord, search_city, search_keyword, rating from leads_raw
        qualify row_number() over (partition by search_city, search_keyword order by ord) <= 20""",
    "q_top_cities": with_views(["leads_raw"])
        + " select city, count(*) as rows from leads_raw group by city order by rows desc, city limit 20",
    "q_rows_per_search": with_views(["leads_raw"])
        + " select search_city, search_keyword, count(*) as n_rows from leads_raw group by 1, 2",
    # campaign
    "q_campaign_plan": with_views(["city_lines"],
        """c as (select split_part(line, '|', 1) as city, split_part(line, '|', 2) as iso, split_part(line, '|', 3) as grp,
             seq as city_seq from city_lines)""",
        f"t as (select * from {_term_rows()})",
        """p as (select row_number() over (order by city_seq, term_seq) as seq, city, iso, c.grp, term_key, keyword, language
             from c join t on c.grp = t.grp)""",
        "f as (select *, row_number() over (partition by city, keyword, language order by seq) as rn from p)")
        + f""" select seq, city, iso, grp, term_key, keyword, language, {_folder('iso')} as folder from f
        where rn = 1 and seq >= 25""",
    "q_campaign_group": with_views(["city_lines"],
        f"t as (select * from {_term_rows()})",
        """p as (select row_number() over (order by c.seq, term_seq) as seq, split_part(line, '|', 1) as city, term_key, keyword,
             language from city_lines c join t on t.grp = split_part(line, '|', 3) where t.grp = 'se')""")
        + """ select seq, city, term_key from p
        qualify row_number() over (partition by city, keyword, language order by seq) = 1""",
    "q_campaign_cross": with_views(["plan_cities"])
        + f""" select city, type_seq, b.business_type, 'de' as language, coalesce(o.keyword, e.keyword, b.business_type) as keyword
        from plan_cities, {dims.values_sql(('type_seq', 'business_type'), list(enumerate(R.BUSINESS_TYPES)), 'b')}
        left join {KEYWORD.replace(') as k(', ') as o(')} on o.business_type = b.business_type and o.language = 'de'
        left join {KEYWORD.replace(') as k(', ') as e(')} on e.business_type = b.business_type and e.language = 'en'""",
    "q_skip_existing": with_views(["plan_cities", "result_files"],
        f"""pl as (select city, s.keyword, {whole_key('city')} as city_key, {whole_key('s.keyword')} as keyword_key
             from plan_cities, {dims.values_sql(('keyword',), [(s,) for s in R.SEGMENTS], 's')})""",
        f"""done as (select {whole_key('city')} as ck, {whole_key('keyword')} as kk,
             arg_max(n_rows, struct_pack(a := mtime, b := file)) as n from result_files group by 1, 2)""")
        + """ select city, keyword, city_key, keyword_key, case when n >= 2 then 'SKIP' else 'SCRAPE' end as action,
        coalesce(n, 0) as row_count, case when n is null then 'No existing data'
          when n >= 2 then 'Already scraped (' || n || ' results)' else 'Low results (' || n || ')' end as reason
        from pl left join done on ck = city_key and kk = keyword_key""",
    "q_existing_latest": with_views(["result_files"])
        + f""" select {whole_key('city')} as city_key, {whole_key('keyword')} as keyword_key,
        arg_max(file, struct_pack(a := mtime, b := file)) as file,
        arg_max(n_rows, struct_pack(a := mtime, b := file)) as n_rows from result_files group by 1, 2""",
    "q_progress_summary": with_views(["progress_lines"],
        """f as (select split_part(line, '|', 4) as s, try_cast(split_part(line, '|', 5) as bigint) as r from progress_lines)""",
        """a as (select count(*) filter (where s = 'SUCCESS') as success,
             count(*) filter (where s = 'ZERO_RESULTS') as zero_results, count(*) filter (where s = 'SKIPPED') as skipped,
             count(*) filter (where s = 'FAILED') as failed, cast(coalesce(sum(r), 0) as bigint) as result_rows,
             count(*) as planned from f)""")
        + f""" select *, cast(0 as bigint) as before_start, {pct('(success + skipped)', 'planned')} as percent_done,
        planned - success - zero_results - skipped - failed as remaining,
        round((planned - success - zero_results - skipped - failed) * 2.5 / 60.0, 1)::double as eta_hours from a""",
    "q_search_url": with_views(["searches"],
        f"""w as (select ord, s.language, radius_km - 20 as r, concat_ws(' ', business_type || ' & co/é*~', s.city) as q,
             coalesce(city_lat, {dims.DEFAULT_LAT}) as lat, coalesce(city_lon, {dims.DEFAULT_LON}) as lon
             from searches s left join {CITY} on c.city_key = {norm('s.city')})""")
        + f""" select ord, '{L.SEARCH_ROOT}' || replace(url_encode(q), '%2F', '/') ||
        case when r > 0 then '/@' || cast(lat::double as varchar) || ',' || cast(lon::double as varchar) || ',' || {zoom('r')} || 'z' else '' end
        || '?hl=' || language as search_url from w""",
    "q_radius_zoom": with_views(["searches"])
        + f" select radius_km, {zoom('radius_km')} as zoom, count(*) as n from searches group by 1, 2",
    # dimensions
    "q_keyword_translate": with_views(["searches"])
        + f""" select ord, s.business_type, {LANG_NORM} as language, coalesce(o.keyword, e.keyword, s.business_type) as keyword
        from searches s
        left join {KEYWORD.replace(') as k(', ') as o(')} on o.business_type = s.business_type and o.language = {LANG_NORM}
        left join {KEYWORD.replace(') as k(', ') as e(')} on e.business_type = s.business_type and e.language = 'en'""",
    "q_keyword_catalog": with_views(["keyword_source"])
        + """ select business_type, string_agg(distinct language, ', ' order by language) as languages,
        count(distinct language) as n_languages,
        coalesce(nullif(max(keyword) filter (where language = 'de'), ''), nullif(max(keyword) filter (where language = 'en'), ''), '-') as shown
        from keyword_source group by business_type""",
    "q_city_country": with_views(["searches"])
        + f""" select ord, s.city, coalesce(city_country, 'US') as country_code from searches s
        left join {CITY} on c.city_key = {norm('s.city')}""",
    "q_city_geo": with_views(["searches"])
        + f""" select ord, s.city, city_lat as strict_lat, coalesce(city_lat, {dims.DEFAULT_LAT})::double as lat,
        coalesce(city_lon, {dims.DEFAULT_LON})::double as lon, coalesce(city_tz, '{dims.DEFAULT_TZ}') as tz
        from searches s left join {CITY} on c.city_key = {norm('s.city')}""",
    "q_tiered_geo": with_views(["searches"])
        + f""" select ord, s.city, s.language,
        coalesce(city_lat, le.lang_lat, lb.lang_lat, {dims.DEFAULT_LAT})::double as lat,
        coalesce(city_lon, le.lang_lon, lb.lang_lon, {dims.DEFAULT_LON})::double as lon,
        coalesce(city_tz, le.lang_tz, lb.lang_tz, '{dims.DEFAULT_TZ}') as tz,
        coalesce(le.locale, lb.locale, '{dims.DEFAULT_LOCALE}') as locale,
        coalesce(le.accept, lb.accept, '{dims.DEFAULT_ACCEPT}') as accept
        from searches s left join {CITY} on c.city_key = {norm('s.city')}
        left join {EXACT} on le.language = {LANG_NORM} left join {BASE_LANG} on lb.language = {LANG_BASE}""",
    "q_phone_country": with_views(["searches"])
        + f""" select ord, coalesce(nullif(given_country, ''), le.phone_country, lb.phone_country, city_country, 'US') as phone_country,
        coalesce(l.phone_country, upper(s.language)) as campaign_country
        from searches s left join {CITY} on c.city_key = {norm('s.city')}
        left join {EXACT} on le.language = {LANG_NORM} left join {BASE_LANG} on lb.language = {LANG_BASE}
        left join {LANG} on l.language = s.language""",
    "q_lang_country": with_views(["searches"])
        + f""" select ord, s.language, coalesce(x.country, y.country, 'US') as country from searches s
        left join {LCOUNTRY} on x.language = {LANG_NORM}
        left join {LCOUNTRY.replace(') as x(', ') as y(')} on y.language = {LANG_BASE}""",
    "q_country_iso": with_views(["searches"])
        + f""" select ord, s.country_name, case when regexp_matches({trim('s.country_name')}, '^\\pL{{2}}$')
          then upper({trim('s.country_name')}) else c.iso end as iso
        from searches s left join {COUNTRY} on c.country_name = lower(translate({trim('s.country_name')}, '_-', '  '))""",
    # listing texts
    "q_parse_address": with_views(["listing_text"])
        + f" select id, address, {CITY_OF} as city, {POSTAL_OF} as postal_code from listing_text",
    "q_parse_rating": with_views(["listing_text"])
        + f""" select id, {RATING_OF} as rating,
        try_cast(regexp_replace(coalesce({first_match(REVIEW, L.REVIEW_LABEL)}, {first_match(REVIEW, L.REVIEW_PAREN)}),
          '[.,]', '', 'g') as double) as review_count from listing_text""",
    "q_parse_hours": with_views(["listing_text"]) + f" select id, {HOURS_OF} as hours from listing_text",
    "q_parse_price": with_views(["listing_text"]) + f" select id, {PRICE_OF} as price_range from listing_text",
    "q_unwrap_redirect": with_views(["listing_text"]) + f" select id, {WEBSITE_OF} as website from listing_text",
    "q_normalise_listings": with_views(["listing_text"],
        f"""l as (select s.*, coalesce(le.phone_country, lb.phone_country, city_country, 'US') as iso, phone_text as text
             from listing_text s left join {CITY} on c.city_key = {norm('s.place')}
             left join {EXACT} on le.language = {LANG_NORM} left join {BASE_LANG} on lb.language = {LANG_BASE})""",
        f"cand as (select id, iso, unnest({CANDS}) as raw, generate_subscripts({CANDS}, 1) as k from l)",
        *e164_ctes("cand", "id, k", N.LISTING_PHONE_DENY),
        "first_phone as (select id as pid, arg_min(e164, k) as phone from e164 group by id)")
        + f""" select id as ord, nullif({clean('name')}, '') as business_name, phone, address,
        {CITY_OF} as city, {POSTAL_OF} as postal_code, iso as country, {WEBSITE_OF} as website, {RATING_OF} as rating,
        nullif({clean('category')}, '') as category, {HOURS_OF} as hours, {PRICE_OF} as price_range
        from (select * replace (nullif({clean('address')}, '') as address) from l) left join first_phone on pid = id""",
}
ORACLES["q_page_quality"] = (
    f"select page_class, count(*) as pages from ({ORACLES['q_page_class']}) group by page_class"
)
