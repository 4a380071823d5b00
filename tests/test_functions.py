"""Text, e-mail, URL, HTML, listing and class expressions on small inputs."""

import html as pyhtml
import re
from urllib.parse import quote, unquote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bizcontacts.functions import classify as K
from bizcontacts.functions import emails as E
from bizcontacts.functions import html as H
from bizcontacts.functions import listing as L
from bizcontacts.functions import text as X
from bizcontacts.functions import urls as U


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expr(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_clean_and_norm(spark):
    values = ["  a \t b c\n", None, "", " X　", "a\x1cb"]
    assert apply(spark, values, X.clean_text) == ["a b c", "", "", "X", "a b"]
    assert apply(spark, values, X.text_norm) == ["a \t b c", "", "", "x", "a\x1cb"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c\x85  　aB.", max_size=12), min_size=1, max_size=30))
def test_whitespace_matches_python(spark, values):
    assert apply(spark, values, X.utrim) == [v.strip() for v in values]
    assert apply(spark, values, X.clean_text) == [re.sub(r"\s+", " ", v).strip() for v in values]


def test_presence(spark):
    values = ["x", " ", None, "NaN", " nan ", "nanx", ""]
    assert apply(spark, values, X.is_present) == [True, False, False, False, False, True, False]


def test_sanitize_key(spark):
    values = ["Halle (Saale)", "a/b:c d", "x" * 130, '<>:"/\\|?*']
    assert apply(spark, values, X.sanitize_key) == ["Halle_(Saale)", "abc_d", "x" * 100, ""]


def test_emails(spark):
    values = ["write to Sales@Shop.fr or sales@shop.fr", "noreply@shop.fr, info@shop.fr",
              "a@mail5.example.com", None, "", "x@y.z a@b.co. NoReply@x.fr"]
    assert apply(spark, values, E.extract_emails) == [
        ["Sales@Shop.fr", "sales@shop.fr"], ["info@shop.fr"], [], [], [], ["a@b.co"]]
    short = [p for p in E.EMAIL_DENY if p not in ("example.com", "example@")]
    assert apply(spark, values[2:3], lambda c: E.extract_emails(c, short)) == [["a@mail5.example.com"]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab@.-é _1 ", max_size=25), min_size=1, max_size=30))
def test_email_pattern_matches_python(spark, values):
    assert apply(spark, values, E.find_emails) == [re.findall(E.EMAIL_PATTERN, v) for v in values]


def test_every_denied_part_counts(spark):
    values = [f"a{p}b.fr" if p.endswith("@") else f"{p}@q.fr" if "." not in p else f"a@{p}" for p in E.EMAIL_DENY]
    assert all(apply(spark, values, E.email_denied))


def test_mailto(spark):
    links = [["mailto:A@b.fr?subject=x", "mailto: c@d.fr ", "mailto:nobody", "/x", "mailto:A@b.fr"]]
    assert apply(spark, links, E.mailto_emails, "array<string>") == [["A@b.fr", "c@d.fr"]]
    assert apply(spark, [["mailto:noreply@b.fr"]], E.mailto_emails, "array<string>") == [["noreply@b.fr"]]
    assert apply(spark, [["mailto:noreply@b.fr"]], lambda c: E.mailto_emails(c, E.EMAIL_DENY), "array<string>") == [[]]


def test_urls(spark):
    values = ["bakery.fr/", "http://x.de//", " www.a.it ", "https://b.pl/p?q=1", ""]
    assert apply(spark, values, U.normalize_url) == [
        "https://bakery.fr", "http://x.de", "https://www.a.it", "https://b.pl/p?q=1", "https://"]
    full = ["https://User@Shop.CO.uk:8443/a/b?x#y", "http://x.de", "nothing", "https://a_b.fr/p q"]
    assert apply(spark, full, U.host) == ["shop.co.uk", "x.de", "", "a_b.fr"]
    assert apply(spark, full, U.base_url)[:2] == ["https://User@Shop.CO.uk:8443", "http://x.de"]
    assert apply(spark, full, U.path) == ["/a/b", "", "", "/p q"]
    assert apply(spark, full, U.tld_country) == ["US", "DE", "US", "FR"]
    assert apply(spark, ["https://a.co.uk/x"], U.tld_country) == ["GB"]
    assert apply(spark, ["http://x.de/q"], lambda c: U.candidate_pages(c, max_pages=3)) == [
        ["http://x.de", "http://x.de/contact", "http://x.de/about"]]


def test_candidate_pages_join_like_links(spark):
    assert apply(spark, ["https://a.fr/x/y?z"], lambda c: U.candidate_pages(c, ("", "team", "/kontakt"), 9)) == [
        ["https://a.fr", "https://a.fr/team", "https://a.fr/kontakt"]]


def test_percent_coding_matches_python(spark):
    values = ["a b/c~*é&+=%", "pâtisserie Köln", "x" * 50]
    assert apply(spark, values, U.percent_encode) == [quote(v) for v in values]
    coded = ["https%3A%2F%2Fx.de%2Fa+b", "100%25", "plain+plus"]
    assert apply(spark, coded, U.percent_decode) == [unquote(v) for v in coded]
    assert apply(spark, ["bad%zz"], U.percent_decode) == ["bad%zz"]


PAGE = """<!DOCTYPE html><html><head><title> Shop &amp; Co </title><!-- <p>ad@x.fr</p> -->
<style>p{}</style><script>var t="</p> js@x.fr";</script>
<meta content='About "us"' name="description"></head><body><h1>Head</h1><p>a<b>b</b></p>
<a class=x href="mailto:i@s.fr?x=1">m</a><a href='/p?x=1'>p</a><a href="https://netflix.com/">n</a>
<a href="https://facebook.com/1">f</a><a href="https://fb.com/2">f</a><p>2 &lt; 3 &amp;lt; Adresse: 1 Rue A
next</p></body></html>"""


def test_html(spark):
    def field(expr):
        return apply(spark, [PAGE], expr)[0]

    text = field(H.page_text)
    assert "ad@x.fr" not in text and "js@x.fr" not in text and "2 < 3 &lt; Adresse" in text
    assert "ab" in field(lambda c: H.page_text(c, sep="")) and "a b" in text
    assert field(H.company_name) == "Shop & Co"
    assert field(H.description) == 'About "us"'
    assert field(H.hrefs) == ["mailto:i@s.fr?x=1", "/p?x=1", "https://netflix.com/",
                              "https://facebook.com/1", "https://fb.com/2"]
    assert field(lambda c: H.address_snippet(H.page_text(c))) == "Adresse: 1 Rue A"
    assert field(lambda c: H.social_links(H.hrefs(c))) == {
        "facebook": "https://fb.com/2", "twitter": "https://netflix.com/"}
    assert field(lambda c: H.social_links(H.hrefs(c), host_match=True)) == {"facebook": "https://fb.com/2"}


def test_company_name_order(spark):
    pages = [
        '<meta property="og:site_name" content="Og"><title>T</title><h1>H</h1>',
        "<meta content='Og' property='og:site_name'><title>T</title>",
        "<title> </title><h1>H <i>x</i></h1>",
        "<p>none</p>",
    ]
    assert apply(spark, pages, H.company_name) == ["Og", "Og", "H x", None]


def test_entities(spark):
    values = ["caf&eacute; &#8364; &amp;", "&#0; &#x0; &#128; &#x9f; &#x110000; &#99999999999999; &#xD800; &#13; &#11;", "&#x1F600;&#X41&#65x",
              "&notit; &notin; &ampx &eacutex &am &; && &1 &#; &#x; &a", "&CounterClockwiseContourIntegral; &NoSuchName;", "", None]
    assert apply(spark, values, H.decode_entities) == [None if v is None else pyhtml.unescape(v) for v in values]


def test_attributes(spark):
    tags = ['<a href=mailto:a@x.fr>', "<A class=x HREF = '/p?a=1&amp;b=2&copy=3' hidden>", '<a href>', '<a>', '<a title="x">',
            '<a href="1" href="2">', '<a data-href="no">', '<abbr href="no">', '<a\nhref="caf&eacute;">', '<a href="open', '<a/href=x>']
    want = [["mailto:a@x.fr"], ["/p?a=1&b=2&copy=3"], [""], [], [], ["2"], [], [], ["café"], [""], ["x"]]
    assert apply(spark, tags, H.hrefs) == want
    metas = ["<meta name=description content=Plain>", '<META CONTENT="a&#33;" NAME="description">', "<meta name=descriptions content=x>",
             "<meta name='description' content='1'><meta name='description' content='2'>", "<meta name='description'>"]
    assert apply(spark, metas, H.description) == ["Plain", "a!", None, "1", None]


def test_open_elements_end_with_the_page(spark):
    pages = ["a<!-- b <p>c", "a<script>b <p>c", "a<style x", "a<p class='x", "<title>T <b>c", "a<!doctype x"]
    assert apply(spark, pages, lambda c: X.utrim(H.page_text(c))) == ["a", "a", "a", "a", "T  c", "a"]
    assert apply(spark, pages[4:5], H.company_name) == ["T c"]


@pytest.mark.parametrize("piece", ["<!-- ", "<script ", "<script>", "<a href=", "<p ", "&#", "&am", "<meta name=description "])
def test_markup_takes_time_in_proportion(spark, piece):
    import time

    df = spark.createDataFrame([(piece * (n // len(piece)),) for n in (1_000, 1_000_000)], "v string").repartition(1)
    read = df.select(*[f.alias(str(k)) for k, f in enumerate((
        H.page_text("v"), H.company_name(H.visible_markup("v")), H.description(H.visible_markup("v")),
        F.size(H.hrefs(H.visible_markup("v")))))])
    start = time.time()
    read.write.format("noop").mode("overwrite").save()
    assert time.time() - start < 30


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["&", "amp;", "&amp;", "&lt;", "lt;", "&quot;", "&#39;", "&euro;", "x", " "])).map("".join), min_size=1, max_size=30))
def test_entities_match_python(spark, values):
    want = [pyhtml.unescape(v) for v in values]
    assert apply(spark, values, H.decode_entities) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["abcde", "xabcdy", "bcdez", "qq", "abcd abcd"]), min_size=1, max_size=5),
       st.lists(st.text(alphabet="abcdexyzq ", max_size=12), min_size=1, max_size=40))
def test_contains_any_matches_python(spark, words, values):
    assert apply(spark, values, lambda c: X.contains_any(c, words)) == [any(w in v for w in words) for v in values]


def test_address_label_priority(spark):
    values = ["Adresse: X\nAddress: Y", "no label", "INDIRIZZO: Via A", "dirección: Calle"]
    assert apply(spark, values, H.address_snippet) == ["Address: Y", None, "INDIRIZZO: Via A", "dirección: Calle"]


def test_phone_elements(spark):
    page = '<a href="tel:+49 30 1">c</a><button data-item-id="phone:tel:030 2">x</button>'
    assert apply(spark, [page], H.tel_texts) == [["030 2", "+49 30 1"]]
    label = '<button aria-label="Phone: 030 3" class="x">030 4</button><i aria-label="Map">1</i>'
    assert apply(spark, [label], H.labelled_phone_texts)[0][0].startswith("Phone: 030 3")
    assert len(apply(spark, [label], H.labelled_phone_texts)[0]) == 1


@pytest.mark.parametrize("address, city, postal", [
    ("Rue A 1, 75001 Paris", "Paris", "75001"),
    ("Rue A 1, 75001 Paris, France", "Paris", None),
    ("Calle B 2, Madrid, 28001", "Madrid", "28001"),
    ("Hauptstr. 5", None, None),
    ("Via C, 20121", None, "20121"),
    (None, None, None),
])
def test_address(spark, address, city, postal):
    got = apply(spark, [address], L.parse_address)[0]
    assert (got.city, got.postal_code) == (city, postal)


def test_rating_and_reviews(spark):
    labels = ["4,5 Sterne", "no", "4.5.6 stars", "0.0 stars", None, "3 ÉTOILES"]
    assert apply(spark, labels, L.parse_rating) == [4.5, None, None, None, None, 3.0]
    texts = ["4.7", "7.5", " 4,2 ", "4.7 of 5", "0.5"]
    got = apply(spark, texts, lambda c: L.parse_rating(F.lit(None).cast("string"), c))
    assert got == [4.7, None, 4.2, None, None]
    spans = [["x", " 4,3 ", "2.1"], ["9.9"]]
    got = apply(spark, spans, lambda c: L.parse_rating(F.lit("x"), F.lit("y"), c), "array<string>")
    assert got == [4.3, None]
    counts = ["1,234 reviews", "(1.234)", "12 Rezensionen (7)", "none", ",, reviews", None]
    assert apply(spark, counts, L.parse_review_count) == [1234, 1234, 12, None, None, None]
    assert apply(spark, ["x 55 reseñas y"], lambda c: L.parse_review_count(F.lit(""), F.lit(""), c)) == [55]


def test_hours_and_price(spark):
    hours = ["Monday 9:00 - 17:30", "9:00 - 17:30", "Open all day", "Monday " * 40 + "9:00 - 10:00", None]
    assert apply(spark, hours, L.parse_hours) == [hours[0], None, None, None, None]
    assert apply(spark, ["any  text"], lambda c: L.parse_hours(F.lit("x"), c)) == ["any text"]
    prices = ["€€", "$$ - $$$", "Moderate", "teuer", "$$$$$", "pricey", None]
    assert apply(spark, prices, L.parse_price) == ["€€", "$$ - $$$", "Moderate", "teuer", None, None, None]


def test_website(spark):
    values = ["https://www.google.com/url?q=https%3A%2F%2Fx.de%2Fa+b&sa=D", "mailto:a@b.fr", "https://y.fr", "", None]
    assert apply(spark, values, L.parse_website) == ["https://x.de/a+b", None, "https://y.fr", None, None]


def test_zoom(spark):
    assert apply(spark, [1, 2, 5, 10, 20, 40, 80, 81], L.radius_to_zoom, "int") == [16, 15, 14, 13, 12, 11, 10, 9]


@pytest.mark.parametrize("url, title, body, markup, expected", [
    ("https://consent.google.com", "", "our systems have detected unusual traffic", '<div id="captcha">', "consent"),
    ("x", "", "we use cookies", "", "consent"),
    ("x", "", "", '<div id="captcha">', "captcha"),
    ("x", "", "", '<iframe src="https://g/recaptcha/x">', "captcha"),
    ("x", "", "", '<p class="a captcha-container">', "captcha"),
    ("x", "", "about captcha", "<p>captcha</p>", "content"),
    ("x", "", "our systems have detected unusual traffic", "", "captcha"),
    ("https://g/sorry/x", "are you a robot", "", "", "captcha"),
    ("https://g/sorry/index", "", "", "", "blocked"),
    ("x", "", "automated queries", "", "blocked"),
    ("x", "", "keep using web", "", "popup"),
    ("x", "t", "hello", "<p>", "content"),
    ("x", None, None, None, "content"),
])
def test_page_class(spark, url, title, body, markup, expected):
    df = spark.createDataFrame([(url, title, body, markup)], "u string, t string, b string, m string")
    assert df.select(K.page_class("u", "t", "b", "m")).first()[0] == expected


@pytest.mark.parametrize("status, error, expected", [
    (None, "SSLV3 alert handshake", "tls_fatal"),
    (None, "Unexpected EOF while reading", "tls_fatal"),
    (None, "ssl problem", "transient"),
    (500, "Read timeout", "transient"),
    (503, None, "retryable_status"),
    (200, None, "ok"),
    (404, "", "other"),
    (None, None, "other"),
])
def test_crawl_class(spark, status, error, expected):
    df = spark.createDataFrame([(status, error)], "s int, e string")
    assert df.select(K.crawl_class("s", "e")).first()[0] == expected
