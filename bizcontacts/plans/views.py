"""Views over the given tables that carry the content the queries look for.

The tables hold few contacts, so content is added by rules on row ids. Each view covers whole
tables and its text runs unchanged in Spark SQL and in another ANSI engine: ``{table}`` marks a
table or view, and no literal holds a backslash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # one row = one observation of a business
    "leads_raw": """
        select o_orderkey as ord,
          case when o_orderkey % 23 = 0 then cast(null as varchar(40))
               when o_orderkey % 29 = 0 then 'nan'
               when o_orderkey % 3 = 0 then concat('  BIZ ', cast(o_custkey % 700 as varchar(20)), ' ')
               else concat('Biz ', cast(o_custkey % 700 as varchar(20))) end as business_name,
          case when o_orderkey % 5 = 0 then cast(null as varchar(40))
               when o_orderkey % 31 = 0 then ''
               else concat('+4420', cast(10000000 + o_custkey % 900 as varchar(20))) end as phone,
          case when o_orderkey % 7 = 0 then concat('info@biz', cast(o_custkey % 700 as varchar(20)), '.fr')
               when o_orderkey % 11 = 0 then ' '
               else cast(null as varchar(40)) end as email,
          case when o_orderkey % 4 = 0 then cast(null as varchar(40))
               else concat(cast(o_custkey % 90 as varchar(20)), ' High St, ', n_name) end as address,
          n_name as city, n_name as search_city, c_mktsegment as search_keyword,
          case when o_orderkey % 13 = 0 then ''
               when o_orderkey % 2 = 0 then concat('www.biz', cast(o_custkey % 700 as varchar(20)), '.fr/')
               else cast(null as varchar(40)) end as website,
          o_orderdate as scraped_date,
          case when o_orderkey % 6 = 0 then cast(null as double)
               else 1.0 + cast(o_orderkey % 41 as double) / 10.0 end as rating,
          cast(o_orderkey % 977 as bigint) as review_count
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
    """,
    # pages with one contact or hygiene block appended, chosen by page id
    "pages_contact": """
        select page_id, url, concat(html, case
          when page_id % 16 = 14 then '<p>Error: automated queries were seen.</p>'
          when page_id % 16 = 15 then '<p>Open the app or Keep using web</p>'
          when page_id % 8 = 0 then concat('<p>Write to <a class="m" href="mailto:Info@shop',
               cast(page_id % 20 as varchar(20)), '.fr?subject=x">us</a> or sales@shop',
               cast(page_id % 20 as varchar(20)), '.fr</p>')
          when page_id % 8 = 1 then concat('<a href="tel:+44 20 7946 0', cast(100 + page_id % 700 as varchar(20)),
               '">call</a>')
          when page_id % 8 = 2 then concat('<meta property="og:site_name" content="Site ',
               cast(page_id % 12 as varchar(20)), ' &amp; Co">')
          when page_id % 8 = 3 then concat('<meta content="Best shop ', cast(page_id as varchar(20)),
               ' of the town" name="description">')
          when page_id % 8 = 4 then concat('<p>Adresse: ', cast(page_id as varchar(20)), ' Rue A, 75001 Paris',
               chr(10), 'Ouvert</p>')
          when page_id % 8 = 5 then concat('<a href="https://www.facebook.com/shop', cast(page_id as varchar(20)),
               '">f</a><a href="https://x.com/shop">x</a><a href="https://fb.com/new">f</a>')
          when page_id % 8 = 6 then '<div class="box" id="captcha-box">x</div>'
          else '<p>We use cookies on this site</p>' end,
          case page_id % 11
          when 0 then '<p>Caf&eacute; Cr&egraveme &#233;t&#xE9; &hellip; &unknown; AT&T &#0; &#128; &#x1F600; &#99999999999; &#xffff;</p>'
          when 1 then concat('<a href=mailto:plain@shop', cast(page_id % 20 as varchar(20)),
               '.fr>m</a><a class=x HREF = "mailto:a&#64;shop4.fr?x=1" hidden>q</a><a href=tel:+33142654321>t</a>')
          when 2 then concat('<h1>Open</h1><!-- no end <p>lost', cast(page_id as varchar(20)), '@shop.fr</p>')
          when 3 then '<a data-x title=y href=/rel/path?x=1&amp;y=2&copy=3>r</a><a name=anchor>n</a><a href>e</a>'
          when 4 then '<meta name=description content=Plain&#x21;><meta content="T&ecirc;te" name=x>'
          when 5 then '<a rel="me" href=https://www.instagram.com/shop&amp;co>i</a>'
          when 6 then '<script>var a = "hidden@shop.fr"'
          when 8 then '<button aria-label="Phone: 020 7946 0958" class="x">020 7946 0959</button><i aria-label="Map">1</i>'
          when 9 then '<div data-section-id="pn0" class=s>+33 1 42 65 43 25</div><b aria-label="Telefon">+33142654326</b>'
          when 7 then '<p>Tel: 01 42 65 43 22 or +33&nbsp;142654323</p><p class="x'
          else '' end) as html
        from {pages}
    """,
    # site addresses under many top-level domains
    "page_sites": """
        select page_id, case when page_id % 13 = 0 then url
          else concat('https://www.shop', cast(page_id as varchar(20)), '.', case page_id % 13
            when 1 then 'pl' when 2 then 'fr' when 3 then 'de' when 4 then 'it' when 5 then 'es'
            when 6 then 'co.uk' when 7 then 'pt' when 8 then 'nl' when 9 then 'be' when 10 then 'ch'
            when 11 then 'at' else 'ie:8080' end, '/page') end as url
        from {pages}
    """,
    # lines of a domain list
    "domain_list": """
        select page_id, case
          when page_id % 9 = 0 then concat('# ', url)
          when page_id % 9 = 1 then '   '
          when page_id % 9 = 2 then concat('  shop', cast(page_id % 50 as varchar(20)), '.fr/ ')
          when page_id % 9 = 3 then concat('www.shop', cast(page_id % 50 as varchar(20)), '.it')
          when page_id % 9 = 4 then concat('https://shop', cast(page_id % 50 as varchar(20)), '.de//')
          else url end as line
        from {pages}
    """,
    # attempts to fetch pages
    "crawl_log": """
        select event_id, concat('https://site', cast(user_id % 400 as varchar(20)), '.fr/p', cast(event_id % 7 as varchar(20))) as url,
          case when event_type = 'error' then case event_id % 5 when 0 then 500 when 1 then 429 when 2 then 404
                 when 3 then 503 else cast(null as integer) end
               else 200 end as status,
          case when event_type = 'error' and event_id % 11 = 0 then 'SSLV3 alert handshake failure'
               when event_type = 'error' and event_id % 11 = 1 then 'Certificate verify failed: expired'
               when event_type = 'error' and event_id % 11 = 2 then 'net::ERR_CONNECTION_RESET'
               when event_type = 'error' and event_id % 11 = 3 then 'Read timeout after 30s'
               when event_type = 'error' and event_id % 11 = 4 then 'unknown failure'
               else cast(null as varchar(60)) end as error,
          ts
        from {events}
    """,
    # searches with the odd spellings look-ups must cope with
    "searches": """
        select o_orderkey as ord,
          case o_orderkey % 12 when 0 then 'Paris' when 1 then ' MILANO ' when 2 then 'Köln' when 3 then 'New York'
            when 4 then 'london' when 5 then 'Warsaw Metropolitan' when 6 then 'Atlantis'
            when 7 then cast(null as varchar(40)) when 8 then 'Zürich'
            else concat('Town ', cast(o_custkey as varchar(20))) end as city,
          case o_orderkey % 10 when 0 then 'de' when 1 then 'EN-gb' when 2 then ' fr ' when 3 then 'pt-BR'
            when 4 then 'xx' when 5 then 'en' when 6 then 'sv-SE' when 7 then 'da' when 8 then 'zh-tw'
            else 'de-AT' end as language,
          case o_orderkey % 9 when 0 then 'pastry_shop' when 1 then 'bakery' when 2 then 'ice_cream'
            when 3 then 'spice_wholesaler' when 4 then 'car wash' else 'horeca_supplier' end as business_type,
          case o_orderkey % 8 when 0 then 'Germany' when 1 then 'united_kingdom' when 2 then 'Czech-Republic'
            when 3 then 'fr' when 4 then 'Atlantis' when 5 then '12' when 6 then ' Bosnia_and Herzegovina'
            else 'poland' end as country_name,
          case when o_orderkey % 7 = 0 then 'GR' when o_orderkey % 7 = 1 then ''
            else cast(null as varchar(2)) end as given_country,
          cast(o_custkey % 101 as integer) as radius_km
        from {orders}
    """,
    # a keyword dictionary, one row per mention
    "keyword_source": """
        select source as business_type, lang as language,
          case when doc_id % 5 = 0 then '' else concat(source, ' ', lang) end as keyword
        from {documents}
    """,
    # international numbers under all calling codes
    "dialled": """
        select o_orderkey as ord, concat('+', cast(10000000000 + (o_orderkey * 7919 + o_custkey * 104729) * 7853 % 89999999999
          as varchar(20))) as number
        from {orders}
    """,
    # a campaign: city lines and their position
    "city_lines": """
        select c_custkey as seq, concat('Town ', cast(c_custkey % 1300 as varchar(20)), '|',
          case c_nationkey % 4 when 0 then 'SE|se' when 1 then 'DE|de' when 2 then 'FR|fr' else 'PL|pl' end) as line
        from {customer}
    """,
    # result files of earlier searches
    "result_files": """
        select concat(n_name, ' ', cast(o_custkey % 40 as varchar(20))) as city, c_mktsegment as keyword,
          concat('part_', cast(year(o_orderdate) as varchar(4))) as file, max(cast(o_orderdate as timestamp)) as mtime, count(*) as n_rows
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
        group by concat(n_name, ' ', cast(o_custkey % 40 as varchar(20))), c_mktsegment,
          concat('part_', cast(year(o_orderdate) as varchar(4)))
        union all
        select distinct concat(n_name, ' ', cast(c_custkey % 40 as varchar(20))), c_mktsegment, 'part_empty',
          timestamp '2100-01-01 00:00:00', cast(0 as bigint)
        from {customer} join {nation} on c_nationkey = n_nationkey where c_custkey % 3 = 0
        union all
        select distinct concat(n_name, ' ', cast(c_custkey % 40 as varchar(20))), concat(repeat('long ', 21), 'one'), 'part_long',
          timestamp '2024-01-01 00:00:00', cast(5 as bigint)
        from {customer} join {nation} on c_nationkey = n_nationkey where c_custkey % 5 = 0
    """,
    # lines of lead files of two layouts: quoted cells, blank lines, rows that are too long
    "lead_lines": """
        select concat('part_', cast(k as varchar(4)), '.csv') as file, cast(2 as bigint) as pos,
          case when k % 2 = 0 then 'business_name,phone,city,rating,note'
               else 'rating,phone,note,business_name,note,postal_code' end as line
        from (select distinct o_custkey % 6 as k from {orders}) as files
        union all
        select concat('part_', cast(k as varchar(4)), '.csv'), cast(1 as bigint), '  '
        from (select distinct o_custkey % 7 as k from {orders}) as files
        union all
        select concat('part_', cast(o_custkey % 6 as varchar(4)), '.csv'), cast(10 + o_orderkey as bigint),
          case when o_orderkey % 19 = 0 then ' '
            when o_custkey % 2 = 0 then concat('"Shop ""', cast(o_custkey as varchar(20)), '"", Ltd",',
              case when o_orderkey % 5 = 0 then 'nan' else concat('+4420', cast(o_orderkey as varchar(20))) end, ',Town,',
              cast(o_orderkey % 50 as varchar(4)), '.5,"n, ', cast(o_orderkey as varchar(20)), '"',
              case when o_orderkey % 17 = 0 then ',x,y' else '' end)
            else concat(case when o_orderkey % 7 = 0 then 'none' else cast(o_orderkey % 9 as varchar(4)) end, ',,first,"Caf, ',
              cast(o_custkey as varchar(20)), '",second,0', cast(o_orderkey % 900 as varchar(20)),
              case when o_orderkey % 17 = 0 then ',,,z' else '' end) end
        from {orders}
    """,
    # all files of that set: one has blank lines only, one no line at all
    "lead_file_list": """
        select distinct concat('part_', cast(case when o_custkey % 8 = 7 then 9 else o_custkey % 8 end as varchar(4)), '.csv') as file
        from {orders}
    """,
    # cities of a plan that partly has results already
    "plan_cities": """
        select distinct concat(n_name, ' ', cast(c_custkey % 50 as varchar(20))) as city
        from {customer} join {nation} on c_nationkey = n_nationkey
    """,
    # lines of a progress log
    "progress_lines": """
        select concat('Town ', cast(o_custkey as varchar(20)), '|', o_orderpriority, '|en-ie|',
          case when o_orderkey % 10 < 6 then concat('SUCCESS|', cast(1 + o_orderkey % 120 as varchar(20)))
               when o_orderkey % 10 = 6 then 'ZERO_RESULTS|0'
               when o_orderkey % 10 = 7 then 'SKIPPED'
               when o_orderkey % 10 = 8 then 'ZERO_RESULTS'
               else 'FAILED' end) as line
        from {orders}
    """,
    # raw texts of listings
    "listing_text": """
        select p_partkey as id, concat('  Shop  ', p_name, ' ') as name, p_type as category,
          case p_partkey % 3 when 0 then 'de' when 1 then 'fr-CH' else 'en' end as language,
          case when p_partkey % 2 = 0 then 'Amsterdam' else 'Nowhere' end as place,
          case p_partkey % 5 when 0 then concat('Tel. 030 ', cast(1000000 + p_partkey % 8000000 as varchar(20)))
            when 1 then concat('+33 1426', cast(10000 + p_partkey % 90000 as varchar(20)))
            when 2 then 'call 0800 123 4567' when 3 then concat('(020) 123-', cast(1000 + p_partkey % 9000 as varchar(20)), ' or 743-555-1234')
            else cast(null as varchar(40)) end as phone_text,
          case p_partkey % 5 when 0 then concat(cast(1 + p_size % 4 as varchar(4)), ',', cast(p_partkey % 10 as varchar(4)), ' Sterne')
            when 1 then concat(cast(1 + p_size % 4 as varchar(4)), '.', cast(p_partkey % 10 as varchar(4)), 'stars') when 2 then 'no label'
            when 3 then '4.5.6 stars' else cast(null as varchar(40)) end as rating_label,
          case when p_partkey % 7 = 0 then 'n/a'
            else concat(' ', cast(p_size % 9 as varchar(4)), '.', cast(p_partkey % 10 as varchar(4)), ' ') end as rating_text,
          case p_partkey % 4 when 0 then concat(cast(1 + p_size as varchar(4)), ',', cast(100 + p_partkey % 900 as varchar(4)), ' reviews')
            when 1 then concat('Alle (1.', cast(100 + p_partkey % 900 as varchar(4)), ')')
            when 2 then concat(cast(p_partkey as varchar(20)), ' Rezensionen (7)') else cast(null as varchar(40)) end as review_label,
          case p_partkey % 6 when 0 then concat('Monday 9:00 - 17:', cast(10 + p_size % 50 as varchar(4)))
            when 1 then concat(' montag  9.30-12.', cast(10 + p_size % 50 as varchar(4)), ' ') when 2 then 'lunch 12:00 - 13:30'
            when 3 then 'Open all day' when 4 then concat(repeat('Monday ', 40), '9:00 - 10:00') else '' end as hours_text,
          case p_partkey % 8 when 0 then '€€' when 1 then '$$ - $$$' when 2 then 'moderate' when 3 then '$$$$$'
            when 4 then concat('from $ - $$ at ', p_name) when 5 then 'Very Expensive' when 6 then 'priced' else ' £ ' end as price_text,
          case p_partkey % 6 when 0 then concat('Rue A ', cast(p_size as varchar(4)), ', 75001 Paris')
            when 1 then concat('Rue A ', cast(p_size as varchar(4)), ', 75001 Paris, France')
            when 2 then concat('Calle B ', cast(p_size as varchar(4)), ', Madrid, ', cast(10000 + p_partkey % 80000 as varchar(8)))
            when 3 then concat('Hauptstr. ', cast(p_partkey as varchar(20))) when 4 then 'Via C 3, 20121'
            else cast(null as varchar(40)) end as address,
          case p_partkey % 6 when 0 then concat('https://www.google.com/url?q=https%3A%2F%2Fx', cast(p_partkey as varchar(20)), '.de%2Fa+b&sa=D')
            when 1 then 'mailto:x@y.fr' when 2 then concat('https://y', cast(p_partkey as varchar(20)), '.fr/?q=1')
            when 3 then 'https://www.google.com/url?q=http://z.it/100%25&x=1' when 4 then '' else cast(null as varchar(40)) end as website
        from {part}
    """,
    # leads without e-mail whose website is one of the pages
    "page_leads": """
        select o_orderkey as ord, concat('Biz ', cast(o_custkey as varchar(20))) as business_name,
          case when o_orderkey % 5 = 0 then concat('own', cast(o_orderkey as varchar(20)), '@biz.fr')
               when o_orderkey % 5 = 1 then '' else cast(null as varchar(40)) end as email,
          case when o_orderkey % 3 = 0 then hot.url when o_orderkey % 4 = 0 then replace(own.url, '://', '://www.')
            else own.url end as website
        from {orders}
        left join {pages} own on own.page_id = o_custkey
        left join (select page_id, url from {pages} where page_id < 8) hot on hot.page_id = o_custkey % 8
    """,
}

_MARK = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view with the tables it names."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {n: load(spark, sf_dir, n) for n in sorted(set(_MARK.findall(text)))}
    return spark.sql(text, **inputs)


def ansi(name: str) -> str:
    """Text of a view for an engine that has the tables under their own names."""
    return _MARK.sub(lambda m: m.group(1), VIEWS[name]).strip()
