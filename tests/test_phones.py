"""Phone candidates and E.164 forms."""

import pytest
from pyspark.sql import functions as F

from bizcontacts.functions import phones as N

CASES = """
DE|030 12345678|+493012345678
DE|0211 987654|+49211987654
DE|+49 30 12345678|+493012345678
DE|(030) 123-456|+4930123456
IT|06 12345678|+390612345678
IT|02 87654321|+390287654321
IT|+39 06 12345678|+390612345678
IT|(02) 8765-4321|+390287654321
ES|91 1234567|+34911234567
ES|93 7654321|+34937654321
ES|+34 91 1234567|+34911234567
ES|(91) 123-4567|+34911234567
NL|020 1234567|+31201234567
NL|010 7654321|+31107654321
NL|+31 20 1234567|+31201234567
NL|(020) 123-4567|+31201234567
PT|21 1234567|+351211234567
PT|22 7654321|+351227654321
PT|+351 21 1234567|+351211234567
PT|(21) 123-4567|+351211234567
BE|2 123 45 67|+3221234567
BE|3 765 43 21|+3237654321
BE|+32 2 123 45 67|+3221234567
BE|(02) 123-4567|+3221234567
CH|44 123 45 67|+41441234567
CH|22 765 43 21|+41227654321
CH|+41 44 123 45 67|+41441234567
CH|(044) 123-4567|+41441234567
AT|1 1234567|+4311234567
AT|316 876543|+43316876543
AT|+43 1 1234567|+4311234567
AT|(01) 123-4567|+4311234567
US|+1 (743) 555-3824|+17435553824
US|(743) 555-3824|+17435553824
US|1 743 555 3824|+17435553824
US|011 49 30 12345678|+493012345678
FR|0033 1 42 65 43 21|+33142654321
FR|33142654321|+33142654321
US|٧٤٣ ٥٥٥ ٣٨٢٤|+17435553824
US|4929 3813 3061 7821|
US|743-800-3824|
US|123|
ZZ|030 12345678|
ZZ|+49 30 12345678|+493012345678
US|+999 1234567|
US||
""".strip().splitlines()


def test_e164(spark):
    rows = [tuple(c.split("|")) for c in CASES]
    df = spark.createDataFrame(rows, "iso string, raw string, expected string")
    got = df.withColumn("got", N.e164("raw", F.col("iso"))).collect()
    wrong = [(r.iso, r.raw, r.expected, r.got) for r in got if (r.got or "") != r.expected]
    assert not wrong


def test_null_number(spark):
    df = spark.sql("select cast(null as string) as raw")
    assert df.select(N.e164("raw", F.lit("US"))).first()[0] is None


def test_deny_modes(spark):
    df = spark.createDataFrame([("+4930800123",), ("+493012345678",), ("+18002345678",)], "raw string")

    def numbers(**options):
        return [r[0] for r in df.select(N.e164("raw", F.lit("DE"), **options)).collect()]

    assert numbers() == [None, "+493012345678", None]
    assert numbers(deny_mode="after_cc") == ["+4930800123", "+493012345678", None]
    assert numbers(deny=()) == ["+4930800123", "+493012345678", "+18002345678"]
    with pytest.raises(ValueError):
        N.e164("raw", F.lit("DE"), deny_mode="elsewhere")


def test_candidates_keep_pattern_order(spark):
    df = spark.createDataFrame([("call (743) 555-3824 now",), ("no number",), (None,)], "t string")
    got = [r[0] for r in df.select(N.phone_candidates("t")).collect()]
    assert got[0][0].strip(" ").endswith("555-3824") and len(got[0]) >= 2
    assert got[1] == [] and got[2] == []


def test_extract_is_distinct(spark):
    df = spark.createDataFrame([("+1 (743) 555-3824 or 743-555-3824",)], "t string")
    assert df.select(N.extract_phones("t", F.lit("US"))).first()[0] == ["+17435553824"]


def test_plan_codes_are_prefix_free():
    codes = sorted({p.cc for p in N.NUMBERING_PLAN})
    assert len(codes) == len(N.NUMBERING_PLAN)
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)]


def test_regions_by_longest_prefix(spark):
    rows = [(p, iso, "+" + p + "5550100") for p, iso in N.PREFIXES] + [("", None, "+0"), ("", None, "331"), ("", None, None)]
    df = spark.createDataFrame(rows, "prefix string, iso string, number string")
    got = df.select("iso", "number", N.phone_region("number").alias("region")).collect()
    known = dict(N.PREFIXES)

    def longest(number):
        return next((known[number[1:n + 1]] for n in range(7, 0, -1) if number[1:n + 1] in known), None)

    for r in got:
        assert r.region == (longest(r.number) if r.number and r.number[0] == "+" else None), r
    assert {r.region for r in got} >= {"US", "CA", "KZ", "GG", "VA", "MA", "ID", "CW"}


def test_numbers_of_all_plans_are_spelled(spark):
    for plan in N.ALL_PLANS:
        assert plan.cc and plan.min_len <= plan.max_len <= 15 - len(plan.cc), plan
    rows = [("US", "+212 612-345678", "+212612345678"), ("MA", "0612345678", "+212612345678"), ("KZ", "8 701 234 56 78", None),
            ("IN", "09876543210", "+919876543210"), ("CA", "(204) 234-5678", "+12042345678"), ("GG", "01481 712345", "+441481712345")]
    df = spark.createDataFrame(rows, "iso string, raw string, want string")
    for r in df.select("*", N.e164("raw", F.col("iso"), ()).alias("got")).collect():
        assert r.want is None or r.got == r.want, r


def test_denied_parts_are_plain_text(spark):
    df = spark.createDataFrame([("+33142654321",)], "raw string")
    for deny, kept in ((["+33"], 0), (["'"], 1), (["."], 1), (["("], 1), (["4265"], 0)):
        assert df.where(N.e164("raw", F.lit("FR"), deny).isNotNull()).count() == kept, deny

