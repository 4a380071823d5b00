"""Lead files, line sources, sinks and the incremental ingest, over files written here."""

import os
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from bizcontacts.operators.campaign import campaign_plan, done_searches, latest_results, with_keys
from bizcontacts.operators.dedup import cascade_dedup
from bizcontacts.plans.jobs import merge_lead_files
from bizcontacts.schemas import LEAD_COLUMNS, NA_WORDS
from bizcontacts.session import checkpoint_folder
from bizcontacts.sources import leads as SL
from bizcontacts.sources import sinks as SK
from bizcontacts.sources import texts as ST
from bizcontacts.streaming.ingest import ingest_leads


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.fixture
def folder(tmp_path):
    base = str(tmp_path)
    put(base, "a.csv", "business_name,phone,address,rating,review_count\n"
        'Cafe A,+33142654321,"1 Rue, Paris",4.5,12\n"Cafe ""B""\nline",NA,2 Rue,,\n')
    put(base, "b.csv", "phone,business_name,scraped_date,postal_code\n"
        "+33142654321, cafe a ,2024-01-02 03:04:05,01234\n,nan,bad,None\n")
    put(base, "c.csv", "business_name,phone\nshort\nlong,1,2,3\n")
    put(base, "empty.csv", "")
    return base


def test_read_leads_with_differing_headers(spark, folder):
    df = SL.read_leads(spark, f"{folder}/[ab].csv")
    rows = {r.business_name: r for r in df.orderBy(*SL.LINE_ORDER).collect()}
    assert rows["Cafe A"].phone == "+33142654321" and rows["Cafe A"].rating == 4.5
    assert rows["Cafe A"].review_count == 12 and rows["Cafe A"].postal_code is None
    assert rows['Cafe "B"\nline'].phone is None and rows['Cafe "B"\nline'].rating is None
    moved = rows[" cafe a "]
    assert moved.postal_code == "01234" and moved.scraped_date == datetime(2024, 1, 2, 3, 4, 5)
    assert rows[None].scraped_date is None and rows[None].postal_code is None
    assert [os.path.basename(r._file) for r in df.orderBy(*SL.LINE_ORDER).collect()] == ["a.csv", "a.csv", "b.csv", "b.csv"]


def test_merge_of_files(spark, folder):
    df = SL.read_leads(spark, [f"{folder}/a.csv", f"{folder}/*.csv", f"{folder}/none.csv"])
    kept = cascade_dedup(df, SL.LINE_ORDER)
    names = sorted((r.business_name or "") for r in kept.collect())
    assert names == ["", 'Cafe "B"\nline', "Cafe A", "short"]


def test_merge_job(spark, folder, tmp_path):
    row = merge_lead_files(spark, [f"{folder}/[ab].csv"], str(tmp_path / "merged")).first()
    assert (row.total_businesses, row.with_phone, row.with_rating) == (3, 1, 1)
    assert merge_lead_files(spark, [f"{folder}/a.csv"], str(tmp_path / "m2"), "parquet").first().total_businesses == 2


def test_rows_that_do_not_fit(spark, folder):
    fine = SL.read_leads(spark, f"{folder}/c.csv").collect()
    assert [(r.business_name, r.phone) for r in fine] == [("short", None)]
    assert [(r.reason, r.record) for r in SL.lead_rejects(spark, f"{folder}/c.csv").collect()] == [("long", "long,1,2,3")]


@pytest.mark.parametrize("multiline", [True, False])
def test_every_row_is_read_or_rejected(spark, folder, multiline):
    put(folder, "blank.csv", "\n  \n")
    put(folder, "head.csv", "business_name,phone\n")
    put(folder, "wide.csv", ",".join(f"c{i}" for i in range(90)) + "\n" + ",".join("x" * 90) + "\n")
    with open(os.path.join(folder, "broken.csv.gz"), "wb") as f:
        f.write(b"\x1f\x8bno archive at all")
    patterns = [f"{folder}/*.csv*", f"{folder}/gone_*.csv"]
    got = {(os.path.basename(r.file), r.reason) for r in SL.lead_rejects(spark, patterns, multiline).collect()}
    assert got == {("empty.csv", "empty"), ("blank.csv", "empty"), ("broken.csv.gz", "unreadable"), ("c.csv", "long"),
                   ("gone_*.csv", "unmatched")}
    read = [os.path.basename(r._file) for r in SL.read_leads(spark, patterns, multiline).collect()]
    assert sorted(set(read)) == ["a.csv", "b.csv", "c.csv", "wide.csv"] and read.count("c.csv") == 1


def test_other_columns_are_kept_by_name(spark, tmp_path):
    path = put(str(tmp_path), "o.csv", "\ufeffnote,phone,,note,phone\na,+331,b,c,+332\n,,,,\nNA,,x\n")
    rows = SL.read_leads(spark, path).orderBy(*SL.LINE_ORDER).collect()
    assert [r.phone for r in rows] == ["+331", None, None]
    assert rows[0]._other == {"note": "a", "_c2": "b", "_c3": "c", "_c4": "+332"}
    assert rows[2]._other == {"note": None, "_c2": "x", "_c3": None, "_c4": None}


def test_one_plan_for_any_number_of_layouts(spark, tmp_path):
    for k in range(12):
        put(str(tmp_path), f"{k}.csv", f"x{k},phone,business_name\n1,+{k},n\n")
    df = SL.read_leads(spark, f"{tmp_path}/*.csv")
    assert df._jdf.queryExecution().analyzed().toString().count("Relation [") == 2
    assert sorted(r.phone for r in df.collect()) == sorted(f"+{k}" for k in range(12))


def test_paths(spark, folder):
    files, missing = SL.expand_paths(spark, [f"{folder}/*.csv", f"{folder}/a.csv", f"{folder}/nope*.csv"])
    assert [os.path.basename(f) for f in files] == ["a.csv", "b.csv", "c.csv", "empty.csv"]
    assert missing == [f"{folder}/nope*.csv"]
    assert SL.read_leads(spark, f"{folder}/nope*.csv").count() == 0


def test_line_order_survives_many_splits(spark, tmp_path):
    text = "business_name,phone\n" + "".join(f"Shop {i},{i}\n" for i in range(5000))
    path = put(str(tmp_path), "big.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = SL.read_leads(spark, path, multiline=False)
        assert df.select("_block").distinct().count() > 3
        got = [int(r.phone) for r in df.orderBy(*SL.LINE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(range(5000))


def test_na_words(spark):
    df = spark.createDataFrame([(w,) for w in NA_WORDS] + [("x",)], "v string")
    assert df.where(SL.clean_missing(F.col("v")).isNotNull()).count() == 1


def test_result_files_and_skip(spark, tmp_path):
    base = str(tmp_path)
    head = "business_name,search_city,search_keyword\n"
    put(base, "France/Paris_glacier_20240101.csv", head + "a,Paris,glacier\n" * 5)
    new = put(base, "France/Paris_glacier_20240201.csv", head + "a,Paris,glacier\n")
    put(base, "Paris_glacier artisanal_1.csv", head + "a,Paris,glacier artisanal\n" * 3)
    os.utime(new, (4e9, 4e9))
    files = SL.result_files(spark, base)
    assert files.count() == 3 and SL.result_files(spark, base, "*.none").count() == 0
    done = {(r.city_key, r.keyword_key): r.rows for r in done_searches(files).collect()}
    assert done == {("Paris", "glacier_artisanal"): 3}
    # the newest result of a search may be a file without rows
    newer = put(base, "Paris_glacier_artisanal_20250101_000000.csv", head)
    os.utime(newer, (4e9, 4e9))
    plan = with_keys(spark.createDataFrame([("Paris", "glacier"), ("Paris", "glacier artisanal"), ("Lyon", "bar")],
                                           "city string, keyword string"))
    latest = latest_results(SL.result_files(spark, base, searches=plan))
    assert {(r.keyword_key, r.rows) for r in latest.collect()} == {("glacier", 1), ("glacier_artisanal", 0)}


def test_line_sources(spark, tmp_path):
    base = str(tmp_path)
    domains = put(base, "d.txt", "# comment\n\nbakery.fr/\nwww.a.it\nhttps://b.pl\n")
    assert [r.url for r in ST.read_domain_list(spark, domains).collect()] == ["https://bakery.fr", "https://www.a.it", "https://b.pl"]
    log = put(base, "p.log", "Dublin|gelato|en-ie|SUCCESS|37\nDublin|gelato|en-ie|FAILED\n")
    assert [(r.status, r.rows) for r in ST.read_progress(spark, log).collect()] == [("SUCCESS", 37), ("FAILED", None)]
    cities = put(base, "c.txt", "Lund|SE|se\n\nWien|de\n")
    assert [r.city for r in ST.read_cities(spark, cities).orderBy("city_seq").collect()] == ["Lund", "Wien"]
    terms = put(base, "t.txt", "se|1|bar|glassbar|sv\nde|1|eis|eisdiele|de\n")
    assert {r.keyword for r in ST.read_terms(spark, terms).collect()} == {"glassbar", "eisdiele"}
    plan = campaign_plan(ST.read_cities(spark, cities), ST.read_terms(spark, terms))
    assert sorted((r.seq, r.city) for r in plan.collect()) == [(1, "Lund"), (2, "Wien")]


def test_keywords(spark, tmp_path):
    base = str(tmp_path)
    yaml = put(base, "k.yaml", "# top\npastry_shop:\n  en: \"pastry shop\"  # c\n  fr: 'pâtisserie'\n\nbar:\n  en: bar\n  de: \"it's: a bar\"\n")
    want = {("pastry_shop", "en", "pastry shop"), ("pastry_shop", "fr", "pâtisserie"), ("bar", "en", "bar"), ("bar", "de", "it's: a bar")}
    assert {tuple(r) for r in ST.read_keywords(spark, yaml).collect()} == want
    js = put(base, "k.json", '{"bar": {"en": "bar",\n "de": "Bar"}}')
    assert {tuple(r) for r in ST.read_keywords(spark, js).collect()} == {("bar", "en", "bar"), ("bar", "de", "Bar")}


def test_pages_from_files(spark, tmp_path):
    put(str(tmp_path), "x/p.html", "<p>é</p>")
    assert ST.read_pages(spark, str(tmp_path), "files").first().html == "<p>é</p>"
    with pytest.raises(ValueError):
        ST.read_pages(spark, str(tmp_path), "zip")


def test_export_roundtrip(spark, tmp_path):
    leads = spark.createDataFrame(
        [(1, " Cafe  A", "+331", "1 Rue", "FR"), (2, "cafe a", "+331", "x", "SE"), (3, 'B "q", c', "+332", None, "SE")],
        "id int, business_name string, phone string, address string, country string")
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    out = SK.prepare_export(leads, "ice cream", "Halle (Saale)", ["id"], now=at)
    assert out.columns == [c for c in LEAD_COLUMNS if c in out.columns] and out.count() == 2
    target = str(tmp_path / "out")
    SK.write_leads(out, target, by_country="country")
    assert sorted(d for d in os.listdir(target) if d.startswith("folder=")) == ["folder=FR", "folder=Sweden"]
    back = SL.read_leads(spark, f"{target}/*/*.csv").orderBy("phone").collect()
    assert [(r.business_name, r.phone, r.search_city) for r in back] == [
        ("Cafe A", "+331", "Halle (Saale)"), ('B "q", c', "+332", "Halle (Saale)")]
    assert back[0].scraped_date == datetime(2024, 1, 2, 3, 4, 5)
    # a rerun replaces the countries it holds and leaves the others
    SK.write_leads(out, target, by_country="country", mode="overwrite")
    SK.write_leads(out.where("country = 'SE'"), target, by_country="country", mode="overwrite")
    assert SL.read_leads(spark, f"{target}/*/*.csv").count() == 2
    for fmt in ("json", "parquet"):
        SK.write_leads(out, f"{target}_{fmt}", fmt)
    assert spark.read.parquet(f"{target}_parquet").count() == 2
    with pytest.raises(ValueError):
        SK.write_leads(out, f"{target}_x", "xml")
    name = spark.range(1).select(SK.result_name(F.lit("Halle (Saale)"), F.lit("ice cream"), at)).first()[0]
    assert name == "Halle_(Saale)_ice_cream_20240102_030405"


def test_ingest_survives_restart(spark, tmp_path):
    base, table, check = (str(tmp_path / d) for d in ("in", "table", "check"))

    def drop(name, rows):
        lines = [",".join(LEAD_COLUMNS)]
        for phone, who, address in rows:
            values = {"business_name": who, "phone": phone, "address": address, "scraped_date": "2024-01-02 03:04:05"}
            lines.append(",".join(values.get(c, "") for c in LEAD_COLUMNS))
        put(base, name, "\n".join(lines) + "\n")

    def run():
        query = ingest_leads(spark, base, table, check)
        query.awaitTermination(120)
        return sorted((r.phone or "", r.business_name, r.address or "") for r in spark.read.parquet(table).collect())

    drop("1.csv", [("+331", "Cafe A", "1 Rue"), ("+331", " cafe a", "2 Rue"), ("", "Cafe A", "")])
    with pytest.raises(TypeError):
        ingest_leads(spark, base, table)
    assert run() == [("", "Cafe A", ""), ("+331", "Cafe A", "1 Rue")]
    drop("2.csv", [("+331", "CAFE A", "3 Rue"), ("+332", "Cafe A", "1 rue"), ("+333", "New", "9 Rue"), ("", "Cafe A", "")])
    again = [("", "Cafe A", ""), ("", "Cafe A", ""), ("+331", "Cafe A", "1 Rue"), ("+333", "New", "9 Rue")]
    assert run() == again
    assert run() == again


def test_ingest_keeps_rows_with_old_dates_and_none(spark, tmp_path):
    base, table, check = (str(tmp_path / d) for d in ("in", "table", "check"))
    dates = [["2024-05-01 00:00:00", "2024-05-02 00:00:00"], ["1999-01-01 00:00:00", "", "nan"], ["1970-01-01 00:00:00"]]
    for batch, days in enumerate(dates):
        lines = [",".join(LEAD_COLUMNS)]
        for k, day in enumerate(days):
            values = {"business_name": f"b{batch}_{k}", "phone": f"+33{batch}{k}", "scraped_date": day}
            lines.append(",".join(values.get(c, "") for c in LEAD_COLUMNS))
        put(base, f"{batch}.csv", "\n".join(lines) + "\n")
        assert ingest_leads(spark, base, table, check).awaitTermination(120)
        assert spark.read.parquet(table).count() == sum(map(len, dates[:batch + 1]))


def test_ingest_refuses_another_layout(spark, tmp_path):
    base, table = str(tmp_path / "in"), str(tmp_path / "table")
    put(base, "1.csv", "phone,business_name,scraped_date\n+331,A,2024-01-02 03:04:05\n")
    with pytest.raises(StreamingQueryException):
        ingest_leads(spark, base, table, str(tmp_path / "c1")).awaitTermination(120)
    query = ingest_leads(spark, base, table, str(tmp_path / "c2"), columns=("phone", "business_name", "scraped_date"))
    query.awaitTermination(120)
    assert [(r.phone, r.email) for r in spark.read.parquet(table).collect()] == [("+331", None)]


def test_checkpoint_folder(spark):
    def session(master, folder):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master),
                               conf=SimpleNamespace(get=lambda key, default: folder))

    assert checkpoint_folder(spark, "x").endswith("/x")
    assert checkpoint_folder(session("spark://host", "/shared/c/"), "x") == "/shared/c/x"
    with pytest.raises(ValueError):
        checkpoint_folder(session("spark://host", None), "x")


ODD_LINES = [
    None, "", " ", ",", ",,,", "a", "a,b", " a , b ", '""', '"",x', 'a,"b,c",d', '"a ""q"", b",c', '"open,b', 'a,"open', 'a"b,c"d,e', '"a"b,c',
    'a,"b" ,c', '"a\nb",c', "a\nb,c", "a\r\nb,c", "a\rb,c", "﻿a,b", "#a,b", "\u0000,b", "a\\,b", '"a\\"b",c', "é,日本,🙂", '"""",""""""',
    *[",".join(f"v{k}" for k in range(n)) for n in (3, 4, 5, 8, 9, 16, 17, 32, 33, 63, 64, 65, 66, 200)],
    *["x" + "," * n for n in (3, 4, 31, 32, 63, 64, 65)], *["," * n + "x" for n in (3, 4, 7, 8, 31, 32, 63, 64, 65)],
    *['"' + "," * n + '",y' for n in (3, 31, 64, 100)], *[f'"a,b",' * n + '"' for n in (1, 2, 4, 40)],
]


def test_cells_are_those_of_a_parse_into_all_columns(spark):
    names = [f"c{i}" for i in range(SL.CELLS)]
    lines = spark.createDataFrame(list(enumerate(ODD_LINES)), "id int, line string")
    whole = F.from_csv("line", ", ".join(f"{n} string" for n in [*names, "over"]), {"escape": '"', "mode": "PERMISSIVE"})
    for r in lines.select("line", SL.split_cells("line").alias("got"), whole.alias("row")).collect():
        want = [] if r.row is None else [*r.row[:SL.CELLS], None if r.row.over is None else "..."]
        while want and want[-1] is None:
            want.pop()
        assert r.got == want, r.line


def test_a_line_is_parsed_once(spark):
    """each of the cells of a line had a parse of its own, into all columns."""
    lines = spark.createDataFrame([("a", 1, "business_name,phone"), ("a", 2, "x,1")], "file string, pos long, line string")
    plan = SL.lead_rows(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") <= 2 * (len(SL.PARSE_WIDTHS) + 1)  # rows and header lines


def test_rows_of_many_files_of_lines(spark):
    """One file holds most lines; blank lines, header lines alone and lines in any order."""
    lines = [("big", 5, "phone,note,business_name"), *(("big", 10 + k, f'{k},"n, {k}",B{k}' + (",z" if k % 7 == 0 else "")) for k in range(500))]
    lines += [("big", 1, " "), ("big", 2, None), ("head", 1, "business_name"), ("two", 9, "x,y"), ("two", 3, "business_name,phone"), ("none", 1, "")]
    table = spark.createDataFrame(lines, "file string, pos long, line string")
    got = {(r.file, r.pos): (r.business_name, r.phone, r._other) for r in SL.lead_rows(table).collect()}
    want = {("big", 10 + k): (f"B{k}", str(k), {"note": f"n, {k}"}) for k in range(500) if k % 7}
    assert got == {**want, ("two", 9): ("x", "y", None)}
    lost = [tuple(r) for r in SL.line_rejects(table, table.select("file")).collect()]
    assert sorted(lost, key=str) == sorted([("big", 10 + k, "long", f'{k},"n, {k}",B{k},z') for k in range(0, 500, 7)] + [("none", None, "empty", None)], key=str)
