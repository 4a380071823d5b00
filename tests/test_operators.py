"""Look-ups, campaigns, statistics, page jobs and the balanced join."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from bizcontacts.operators import campaign as C
from bizcontacts.operators import contacts as T
from bizcontacts.operators import lookups as K
from bizcontacts.operators import pages as P
from bizcontacts.operators import stats as S
from bizcontacts.operators.enrich import enrich_emails
from bizcontacts.operators.joins import left_join_unique
from bizcontacts.plans import jobs as J
from bizcontacts.sources import dims


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- look-ups ----------------------------------------------------------------------------------

def test_keyword_translation(spark):
    df = frame(spark, [("pastry_shop", "pl"), ("pastry_shop", "sv"), ("car wash", "de")], "t string, l string")
    got = K.translate_keyword(df, dims.keyword_dim(spark), "t", "l")
    assert {(r.t, r.l): r.keyword for r in got.collect()} == {
        ("pastry_shop", "pl"): "cukiernia", ("pastry_shop", "sv"): "pastry shop", ("car wash", "de"): "car wash"}
    assert "SortMergeJoin" not in executed(got)


def test_keyword_catalog(spark):
    dim = dims.keyword_dim(spark)
    row = K.keyword_catalog(dim).where("business_type = 'bakery'").first()
    assert row.languages == "de, en, es, fr, it, pl, pt" and row.n_languages == 7
    own = frame(spark, [("a", "en", "x"), ("a", "de", ""), ("b", "fr", "y")], "business_type string, language string, keyword string")
    assert {r.business_type: r.shown for r in K.keyword_catalog(own, "de").collect()} == {"a": "x", "b": "-"}


def test_city_lookups(spark):
    df = frame(spark, [(" PARIS ",), ("köln",), ("Warsaw Metropolitan",), ("Atlantis",), (None,)], "city string")
    got = {r.city: r for r in K.city_geo(K.city_country(df, "city"), "city").collect()}
    assert [got[c].country_code for c in (" PARIS ", "köln", "Warsaw Metropolitan", "Atlantis", None)] == [
        "FR", "DE", "PL", "US", "US"]
    assert got["köln"].lat == 50.9375 and got["köln"].tz == "Europe/Berlin"
    assert got["Atlantis"].lat == 40.7128 and got["Warsaw Metropolitan"].tz == "America/New_York"
    strict = {r.city: r.lat for r in K.city_geo(df, "city", strict=True).collect()}
    assert strict["Atlantis"] is None and strict[" PARIS "] == 48.8566


def test_tiers(spark):
    rows = [("Paris", "de"), ("X", "de-AT"), ("X", "EN-gb"), ("X", "xx"), (None, None)]
    got = {(r.c, r.l): r for r in K.tiered_geo(frame(spark, rows, "c string, l string"), "c", "l").collect()}
    assert got["Paris", "de"].tz == "Europe/Paris" and got["Paris", "de"].locale == "de-DE"
    assert got["X", "de-AT"].tz == "Europe/Berlin" and got["X", "EN-gb"].tz == "Europe/London"
    assert got["X", "xx"].tz == "America/New_York" and got[None, None].accept == "en-US,en"


def test_countries(spark):
    rows = [("de-at", "x", None), ("en", "Paris", ""), ("en", "x", None), ("fr", "x", "GR"), ("en-mt", "Paris", None)]
    df = frame(spark, rows, "l string, c string, g string")
    assert [r.phone_country for r in K.phone_country(df, "l", "c", "g").collect()] == ["DE", "FR", "US", "GR", "MT"]
    langs = frame(spark, [("da",), ("cs",), ("de",), ("nl",), ("qq",)], "l string")
    assert [r.phone_country for r in K.campaign_phone_country(langs, "l").collect()] == ["DK", "CZ", "DE", "NL", "QQ"]
    langs = frame(spark, [("pt-BR",), ("de-AT",), ("zh-tw",), ("tlh",), ("en",)], "l string")
    assert [r.country for r in K.language_country(langs, "l").collect()] == ["BR", "DE", "TW", "US", "US"]
    names = frame(spark, [("Czech-Republic",), ("north_macedonia",), ("fr",), ("1a",), ("Atlantis",)], "n string")
    assert [r.iso for r in K.country_iso(names, "n").collect()] == ["CZ", "MK", "FR", None, None]


def test_dimension_sizes_and_keys(spark):
    assert all(len({r[0] for r in rows}) == len(rows) for rows in (
        dims.city_rows(), dims.language_rows(), dims.language_country_rows(), dims.country_rows()))
    assert len(dims.keyword_rows()) == len({r[:2] for r in dims.keyword_rows()})
    assert dims.values_sql(["a", "b"], [("it's", None), ("x", 1.5)]).startswith("(values ('it''s', null)")
    with pytest.raises(ValueError):
        dims.values_sql(["a"], [("back\\slash",)])


# --- joins -------------------------------------------------------------------------------------

@pytest.mark.parametrize("rows_per_slot", [1, 7, 1_000_000])
def test_left_join_unique_equals_plain_join(spark, rows_per_slot):
    left = spark.range(300).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 11 = 0 then null else concat('k', id % 40) end as k")
    right = spark.range(30).selectExpr("concat('k', id) as k", "id * 10 as v").union(
        spark.sql("select 'hot' as k, cast(7 as bigint) as v"))
    got = left_join_unique(left, right, "k", ["id"], rows_per_slot)
    plain = left.join(right, "k", "left")
    assert Counter(map(tuple, got.select("id", "k", "v").collect())) == Counter(
        map(tuple, plain.select("id", "k", "v").collect()))


def test_hot_key_is_split(spark):
    left = spark.range(9_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) as k")
    right = spark.sql("select 'hot' as k, 1 as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = left_join_unique(left, right, "k", ["id"], 100)
        sizes = got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 3_000 and len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_enrich(spark):
    leads = frame(spark, [(1, "a@b.fr", "x.fr"), (2, None, "x.fr/"), (3, " ", "http://y.fr/p"), (4, None, None), (5, "nan", "X.FR")],
                  "id int, email string, website string")
    sites = frame(spark, [("x.fr", "m@x.fr")], "host string, site_email string")
    got = {r.id: r.email for r in enrich_emails(leads, sites, ["id"], 1).collect()}
    assert got == {1: "a@b.fr", 2: "m@x.fr", 3: " ", 4: None, 5: "m@x.fr"}


# --- campaign ----------------------------------------------------------------------------------

def test_plan(spark):
    lines = frame(spark, [(0, "Lund|SE|se"), (1, "Dublin|IE|ie"), (2, "  "), (3, "Wien|de"), (4, "Lund|SE|se")], "seq long, line string")
    cities = C.parse_cities(lines)
    assert {(r.city, r.iso, r.grp) for r in cities.collect()} == {
        ("Lund", "SE", "se"), ("Dublin", "IE", "ie"), ("Wien", None, "de")}
    terms = C.parse_terms(frame(spark, [("se|1|a|glassbar|sv",), ("se|2|b|gelato|en-gb",), ("ie|1|c|gelato|en-ie",), ("ie|2|d|gelato|en-ie",)], "line string"))
    plan = C.campaign_plan(cities, terms).orderBy("seq").collect()
    assert [(r.seq, r.city, r.keyword) for r in plan] == [(1, "Lund", "glassbar"), (2, "Lund", "gelato"), (3, "Dublin", "gelato")]
    assert [r.seq for r in C.campaign_plan(cities, terms, start_from=3).collect()] == [3]
    assert [r.seq for r in C.campaign_plan(cities, terms, group="ie").collect()] == [1]


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_running_total(spark, block):
    df = spark.range(50).selectExpr("id as pos", "id % 4 as w")
    got = {r.pos: r.before for r in C.running_total(df, "pos", "w", "before", block).collect()}
    total = 0
    for i in range(50):
        assert got[i] == total
        total += i % 4


@pytest.mark.parametrize("block", [2, 10_000])
def test_running_total_of_positions_far_apart(spark, block):
    """More than ``block`` ** 3 positions: sums used to begin anew in each such range."""
    df = frame(spark, [(0, 3), (5, 1), (9 * 10**12, 4), (10**18, 7)], "pos long, w long")
    got = {r.pos: r.before for r in C.running_total(df, "pos", "w", "before", block).collect()}
    assert got == {0: 0, 5: 3, 9 * 10**12: 4, 10**18: 8}


def test_skip_existing(spark):
    files = frame(spark, [("A", "k", "f1", 1, 50), ("A", "k", "f2", 2, 1), ("B", "k", "f3", 1, 2), ("C", "k", "f4", 1, 19)],
                  "city_key string, keyword_key string, file string, mtime long, rows long")
    latest = {r.city_key: (r.file, r.rows) for r in C.latest_results(files).collect()}
    assert latest == {"A": ("f2", 1), "B": ("f3", 2), "C": ("f4", 19)}
    plan = C.with_keys(frame(spark, [(c, "k") for c in "ABCD"] + [("B", "k long")], "city string, keyword string"))
    done = C.done_searches(files)
    assert sorted((r.city, r.keyword) for r in C.todo(plan, done).collect()) == [("A", "k"), ("B", "k long"), ("D", "k")]
    assert sorted(r.city for r in C.skipped(plan, done).collect()) == ["B", "C"]
    assert C.done_searches(files, C.MIN_ROWS_DONE_STRICT).count() == 0


def test_campaign_job(spark):
    cities = frame(spark, [("A", "SE", "se", 0), ("B", "SE", "se", 1)], "city string, iso string, grp string, city_seq long")
    terms = frame(spark, [("se", 1, "t", "k", "sv")], "grp string, term_seq long, term_key string, keyword string, language string")
    files = frame(spark, [("A", "k", "f1", 1, 50)], "city_key string, keyword_key string, file string, mtime long, rows long")
    left, skipped = J.campaign(cities, terms, files)
    assert [r.city for r in left.collect()] == ["B"] and [r.city for r in skipped.collect()] == ["A"]


def test_campaign_variant(spark):
    cities = frame(spark, [("Lund", "SE", "se", 0), ("Paris", "FR", "fr", 1)], "city string, iso string, grp string, city_seq long")
    terms = frame(spark, [("se", 1, "t", "glassbar", "sv"), ("se", 2, "u", "gelato", "sv"), ("fr", 1, "v", "glacier", "fr")],
                  "grp string, term_seq long, term_key string, keyword string, language string")
    files = frame(spark, [("Lund", "glassbar", "f1", 1, 19)], "city_key string, keyword_key string, file string, mtime long, rows long")
    got = {r.keyword: r for r in J.campaign_variant(cities, terms, files, C.VARIANTS["top_tier"]).collect()}
    assert set(got) == {"glassbar", "gelato"}
    assert (got["glassbar"].action, got["glassbar"].row_count, got["glassbar"].reason) == ("SCRAPE", 19, "Low results (19)")
    assert (got["gelato"].reason, got["gelato"].folder, got["gelato"].find_emails) == ("No existing data", "Sweden", True)
    assert got["gelato"].search_url.endswith(",12z?hl=sv")
    loose = J.campaign_variant(cities, terms, files, C.VARIANTS["top_tier"]._replace(min_rows=2))
    assert loose.where("keyword = 'glassbar'").first().action == "SKIP"


def test_crossed_plan_has_no_join(spark):
    plan = C.crossed_plan(frame(spark, [("A",), ("B",)], "city string"), ["x", "y", "z"])
    assert plan.count() == 6 and "Join" not in executed(plan)


def test_progress(spark):
    lines = frame(spark, [("Dublin|artisan ice cream shop|en-ie|SUCCESS|37",), ("a|b|c|ZERO_RESULTS|0",), ("a|b|c|ZERO_RESULTS",),
                          ("a|b|c|FAILED",), ("a|b|c|SKIPPED",), ("a|b|c|SUCCESS",), ("",)], "line string")
    progress = C.progress_fields(lines)
    assert {r.status: r.n for r in C.progress_counts(progress).collect()} == {
        "SUCCESS": 2, "ZERO_RESULTS": 2, "FAILED": 1, "SKIPPED": 1}
    row = C.progress_summary(progress, 30, before_start=4).first()
    assert (row.success, row.zero_results, row.skipped, row.failed, row.result_rows) == (2, 2, 1, 1, 37)
    assert (row.percent_done, row.remaining, row.eta_hours, row.before_start) == (10.0, 24, 1.0, 4)


def test_urls_and_folders(spark):
    df = frame(spark, [("Köln", "ice cream", "de", 20), ("Köln", "a/b", "de", 0)], "city string, keyword string, language string, r int")
    urls = [r.search_url for r in C.planned_urls(df, F.col("r")).collect()]
    assert urls == ["https://www.google.com/maps/search/ice%20cream%20K%C3%B6ln/@50.9375,6.9603,12z?hl=de",
                    "https://www.google.com/maps/search/a/b%20K%C3%B6ln?hl=de"]
    isos = frame(spark, [("SE",), ("GB",), ("DE",)], "iso string")
    assert [r.folder for r in C.with_output_folder(isos).collect()] == ["Sweden", "United_Kingdom", "DE"]


# --- statistics --------------------------------------------------------------------------------

def test_lead_stats(spark):
    leads = frame(spark, [("+1", "a@b", None, 4.0, "X"), ("nan", " ", "w", None, "X"), (None, "c@d", "w", 1.0, None)],
                  "phone string, email string, website string, rating double, city string")
    row = S.lead_stats(leads).first()
    assert (row.total_businesses, row.with_phone, row.with_email, row.with_website, row.with_rating, row.unique_cities) == (3, 1, 2, 2, 2, 1)
    assert (row.phone_percentage, row.email_percentage) == (33.3, 66.7)
    empty = S.lead_stats(leads.where("false").drop("city")).first()
    assert empty.total_businesses == 0 and empty.phone_percentage is None and empty.unique_cities == 0
    assert S.lead_stats(leads, ["city"]).count() == 2


def test_top_lists(spark):
    df = spark.range(100).selectExpr("id", "concat('c', id % 7) as city")
    assert [tuple(r) for r in S.top_by_rows(df, ["city"], 2).collect()] == [("c0", 15), ("c1", 15)]
    assert S.top_k_per_group(df, ["city"], [F.col("id")], 3).count() == 21
    assert "WindowGroupLimit" in executed(S.top_k_per_group(df, ["city"], [F.col("id")], 3))


# --- pages and contacts ------------------------------------------------------------------------

PAGES = [
    (1, "https://x.fr/about", "<p>b@x.fr</p>"),
    (2, "https://x.fr/", '<title>X</title><p>a@x.fr, Tel. 0142654321</p><a href="tel:+33142654322">t</a>'),
    (3, "https://x.fr/zz", "<p>z@x.fr</p>"),
    (4, "https://y.de/k", '<a href="mailto:i@y.de">m</a><p>we use cookies</p>'),
]


def test_domain_contacts(spark):
    pages = frame(spark, PAGES, "page_id long, url string, html string")
    contacts = P.page_contacts(pages)
    assert "Exchange" not in executed(contacts)
    assert {r.page_id: r.listed_phone for r in contacts.collect()}[2] == "+33142654322"
    sites = {r.host: r for r in P.domain_contacts(contacts).collect()}
    assert sites["x.fr"].emails == ["a@x.fr", "b@x.fr", "z@x.fr"] and sites["x.fr"].company_name == "X"
    assert sites["x.fr"].phones == ["+33142654321"] and sites["x.fr"].website == "https://x.fr"
    assert sites["y.de"].emails == ["i@y.de"]
    assert P.site_emails(contacts).count() == 4
    first = {r.host: (r.site_email, r.n_emails) for r in P.site_first_email(contacts).collect()}
    assert first == {"x.fr": ("a@x.fr", 3), "y.de": ("i@y.de", 1)}
    flat = {r.website: r for r in P.flat_domain_contacts(P.domain_contacts(contacts)).collect()}
    assert flat["https://x.fr"].all_emails == "a@x.fr, b@x.fr, z@x.fr" and flat["https://y.de"].phone is None
    row = S.domain_stats(P.domain_contacts(contacts)).first()
    assert (row.total_domains, row.with_email, row.with_phone, row.with_company) == (2, 2, 1, 1)
    assert J.domain_contacts(pages).count() == 2


def test_page_quality(spark):
    pages = frame(spark, PAGES, "page_id long, url string, html string")
    assert {r.page_class: r.pages for r in J.page_quality(pages).collect()} == {"content": 3, "consent": 1}
    kept = J.content_pages(pages)
    assert kept.columns == pages.columns and sorted(r.page_id for r in kept.collect()) == [1, 2, 3]
    assert executed(kept).count("!doctype") == 1


def test_links(spark):
    pages = frame(spark, [(1, "http://a.fr/x", '<a href="/p?x=1">1</a><a href="/p?x=2">2</a><a href="/maps/place/q?z">3</a>')],
                  "page_id long, url string, html string")
    assert sorted(r.link for r in P.page_links(pages).collect()) == ["/maps/place/q", "/p"]
    assert [r.link for r in J.page_links(pages, "/maps/place/").collect()] == ["/maps/place/q"]


def test_frontier(spark):
    lines = frame(spark, [("# c",), (" # d",), ("",), ("a.fr/",), ("https://a.fr",)], "line string")
    urls = P.domain_lines(lines)
    assert sorted(r.url for r in urls.collect()) == ["https://# d", "https://a.fr", "https://a.fr"]
    got = P.url_frontier(urls.where("url = 'https://a.fr'"), max_pages=2).orderBy("position").collect()
    assert [(r.position, r.page_url) for r in got] == [(0, "https://a.fr"), (1, "https://a.fr/contact")]


def test_crawl_log(spark):
    log = frame(spark, [("u", 500, None, 1, 1), ("u", 200, None, 2, 2), ("v", None, "ssl", 1, 3), ("v", 200, None, 1, 2)],
                "url string, status int, error string, ts long, event_id long")
    got = {r.url: (r.attempts, r.ok_attempts, r.outcome) for r in P.crawl_outcomes(log).collect()}
    assert got == {"u": (2, 1, "ok"), "v": (2, 1, "transient")}
    assert P.successful(log).count() == 2
    assert {r.error_class: r.attempts for r in J.crawl_quality(log).collect()} == {"retryable_status": 1, "ok": 2, "transient": 1}


def test_extract_contacts(spark):
    df = frame(spark, [(1, "de", "mail i@x.de call 030 12345678"), (2, "de", "none")], "id int, lang string, t string")
    got = sorted((r.id, r.kind, r.value) for r in J.extract_contacts(df, "t", language="lang").collect())
    # the second pattern also finds the number without its last digit, a valid number as well
    assert got == [(1, "email", "i@x.de"), (1, "phone", "+49301234567"), (1, "phone", "+493012345678")]
    pattern = T.text_emails(df, "t")
    assert executed(pattern).count("regexp_extract_all") == 1


def test_coverage(spark):
    df = frame(spark, [("a", "i@x.de"), ("a", "none"), ("b", "743-555-3824")], "s string, t string")
    got = {r.s: r for r in T.contact_coverage(df, "t", ["s"], F.lit("US")).collect()}
    assert (got["a"].with_email, got["a"].email_percentage, got["b"].with_phone) == (1, 50.0, 1)


def test_listings(spark):
    raw = frame(spark, [(" Cafe  A ", "Tel: 030 12345678", "Str. 1, 10115 Berlin", "mailto:x", "4,5 Sterne", "12 Rezensionen", "x 9:00 - 17:00 Open", "€€", "berlin", "de")],
                "name string, phone_text string, address string, website_href string, rating_label string, review_label string, hours_text string, price_text string, place string, lang string")
    row = J.normalise_listings(raw, "lang", "place").first()
    assert (row.business_name, row.phone, row.city, row.postal_code, row.country) == ("Cafe A", "+493012345678", "Berlin", "10115", "DE")
    assert (row.website, row.rating, row.review_count, row.hours, row.price_range) == (None, 4.5, 12, "x 9:00 - 17:00 Open", "€€")
