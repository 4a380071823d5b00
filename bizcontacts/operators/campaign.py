"""Search campaigns: plan, numbering, skipping of finished work, progress."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizcontacts.functions.listing import search_url
from bizcontacts.functions.text import blank_to_null, sanitize_key, search_key, text_norm, utrim
from bizcontacts.operators.lookups import city_geo, country_folder
from bizcontacts.operators.stats import percentage

# The row counts from which a search counts as done, the outcome words of a progress
# log, and the minutes one search takes in the time estimate.
MIN_ROWS_DONE = 2
MIN_ROWS_DONE_STRICT = 20
STATUSES = ("SUCCESS", "ZERO_RESULTS", "SKIPPED", "FAILED")
MINUTES_PER_SEARCH = 2.5

# positions per block: three levels of it cover every 64-bit number
_BLOCK = 1 << 21
_LEAST_BLOCK = 1000  # lower ones would need many levels


class Variant(NamedTuple):
    """Settings of one kind of campaign."""

    groups: tuple[str, ...]
    min_rows: int
    radius_km: int | None
    find_emails: bool


# Term groups, rows that make a search done, radius and e-mail search per campaign.
VARIANTS = {
    "western_europe": Variant(("de", "it", "es", "pt", "nl", "fr"), 2, None, False),
    "poland": Variant(("pl",), 2, None, True),
    "dutch_spain": Variant(("es", "nl"), 2, 20, False),
    "czech_slovak_nordic": Variant(("cs", "sk", "da", "sv", "no"), 2, 20, True),
    "eastern_europe": Variant(("cs", "sk", "hu", "sl", "hr", "sr", "sq", "mk", "bg", "ro", "el"), 2, 20, False),
    "english_friendly": Variant(("uk", "ie", "nl", "se", "no", "dk"), 2, 20, True),
    "top_tier": Variant(("se", "nl", "dk", "fi", "ie", "mt", "pl"), 20, 20, True),
    "german_food": Variant(("de",), 2, None, True),
}


def _field(line: Column, n: int) -> Column:
    return utrim(F.try_element_at(F.split(line, r"\|"), F.lit(n)))


def parse_cities(lines: DataFrame, line: str = "line", seq: str = "seq") -> DataFrame:
    """``City|group`` or ``City|ISO|group`` lines -> city, iso, grp, city_seq.

    The short form has no country of its own; its ISO column stays null instead of repeating the
    language as a country.
    """
    c = F.col(line)
    three = F.size(F.split(c, r"\|")) >= 3
    return lines.where(utrim(c) != "").select(
        _field(c, 1).alias("city"),
        F.when(three, F.upper(_field(c, 2))).alias("iso"),
        F.when(three, _field(c, 3)).otherwise(_field(c, 2)).alias("grp"),
        F.col(seq).cast("bigint").alias("city_seq"),
    )


def parse_terms(lines: DataFrame, line: str = "line") -> DataFrame:
    """``group|position|term key|keyword|language`` lines -> grp, term_seq, term_key, keyword, language."""
    c = F.col(line)
    return lines.where(utrim(c) != "").select(
        _field(c, 1).alias("grp"),
        _field(c, 2).try_cast("bigint").alias("term_seq"),
        _field(c, 3).alias("term_key"),
        _field(c, 4).alias("keyword"),
        _field(c, 5).alias("language"),
    )


def running_total(df: DataFrame, position: str, weight: str, out: str, block: int = _BLOCK) -> DataFrame:
    """Sum of ``weight`` over all rows before each row, ordered by ``position``, a number from 0 on.

    Levels keep it parallel: windows inside blocks of ``block`` positions, over the totals of as many
    neighbouring blocks, over the totals of those, and so on until one block holds all 64-bit positions. No
    window holds more than ``block`` rows (``_LEAST_BLOCK`` for a lower one) where positions are unique, however
    sparse they are, and none holds the whole table.
    """
    block = max(block, _LEAST_BLOCK)

    def up(c: str) -> Column:
        return F.expr(f"({c} - pmod({c}, {block})) div {block}")

    def before(part: str, order: str, value: str) -> Column:
        rows = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(rows), F.lit(0))

    blocked = df.withColumn("_b1", up(position))
    totals = [blocked.groupBy("_b1").agg(F.sum(weight).alias("_w")).withColumn("_b2", up("_b1"))]
    k = 2
    while block ** k < 1 << 63:
        totals.append(totals[-1].groupBy(f"_b{k}").agg(F.sum("_w").alias("_w")).withColumn(f"_b{k + 1}", up(f"_b{k}")))
        k += 1
    offsets = None
    for n in range(len(totals), 0, -1):
        near = totals[n - 1].select(f"_b{n}", f"_b{n + 1}", before(f"_b{n + 1}", f"_b{n}", "_w").alias("_near"))
        if offsets is None:
            offsets = near.select(f"_b{n}", F.col("_near").alias("_off"))
        else:
            offsets = near.join(offsets, f"_b{n + 1}").select(f"_b{n}", (F.col("_near") + F.col("_off")).alias("_off"))
    return (
        blocked.withColumn("_in", before("_b1", position, weight))
        .join(offsets, "_b1")
        .withColumn(out, F.col("_off") + F.col("_in"))
        .drop("_b1", "_in", "_off")
    )


def campaign_plan(cities: DataFrame, terms: DataFrame, group: str | None = None,
                  start_from: int = 1) -> DataFrame:
    """Every city with every term of its group, numbered city by city.

    ``cities``: city, iso, grp, city_seq (unique, growing in list order); ``terms``: grp, term_seq
    (1..n within the group), term_key, keyword, language. ``seq`` counts all searches of the selection, so a run can
    be resumed with ``start_from``. A search listed twice for a city keeps its first number.
    """
    if group is not None:
        cities = cities.where(F.col("grp") == group)
    sizes = terms.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    sized = cities.join(sizes, "grp")
    numbered = running_total(sized, "city_seq", "_n", "_before").drop("_n")
    plan = numbered.join(terms, "grp").withColumn("seq", F.col("_before") + F.col("term_seq"))
    plan = plan.drop("_before")
    # the repeated listings of one city lie in one group of terms, so this touches few rows per key
    first = Window.partitionBy("city", "keyword", "language").orderBy("seq")
    plan = plan.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
    return plan.where(F.col("seq") >= start_from)


def crossed_plan(cities: DataFrame, business_types: Sequence[str]) -> DataFrame:
    """Every business type for every city. The types are a short parameter list, so each city row is
    expanded in place; no join takes place."""
    pairs = F.posexplode(F.array(*[F.lit(t) for t in business_types])).alias("type_seq", "business_type")
    return cities.select("*", pairs)


def with_keys(df: DataFrame, city: str = "city", keyword: str = "keyword") -> DataFrame:
    """The key columns searches are compared by, whole, so that long keywords stay apart."""
    return df.withColumns({"city_key": search_key(city), "keyword_key": search_key(keyword)})


def latest_results(files: DataFrame) -> DataFrame:
    """Newest result file per search, also one without rows. ``files``: city_key, keyword_key, file, mtime, rows.

    The bare ``row_number`` filter leaves one file per search and task for the shuffle.
    """
    newest = Window.partitionBy("city_key", "keyword_key").orderBy(F.col("mtime").desc(), F.col("file").desc())
    ranked = files.select("city_key", "keyword_key", "file", "mtime", "rows", F.row_number().over(newest).alias("_rn"))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def done_searches(files: DataFrame, min_rows: int = MIN_ROWS_DONE) -> DataFrame:
    """Searches whose newest file has at least ``min_rows`` rows."""
    return latest_results(files).where(F.col("rows") >= min_rows)


def skip_check(plan: DataFrame, latest: DataFrame, min_rows: int = MIN_ROWS_DONE) -> DataFrame:
    """The plan with ``action`` (SKIP or SCRAPE), ``row_count`` and ``reason`` of each search."""
    known = latest.select("city_key", "keyword_key", F.col("rows").alias("_rows"))
    n = F.col("_rows").cast("string")
    enough = F.coalesce(F.col("_rows") >= min_rows, F.lit(False))
    return (
        plan.join(known, ["city_key", "keyword_key"], "left")
        .withColumns(
            {
                "action": F.when(enough, F.lit("SKIP")).otherwise(F.lit("SCRAPE")),
                "row_count": F.coalesce("_rows", F.lit(0).cast("bigint")),
                "reason": F.when(F.col("_rows").isNull(), F.lit("No existing data"))
                .when(enough, F.concat(F.lit("Already scraped ("), n, F.lit(" results)")))
                .otherwise(F.concat(F.lit("Low results ("), n, F.lit(")"))),
            }
        )
        .drop("_rows")
    )


def todo(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned searches without a finished result; ``plan`` needs the key columns."""
    return plan.join(done.select("city_key", "keyword_key"), ["city_key", "keyword_key"], "left_anti")


def skipped(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select("city_key", "keyword_key"), ["city_key", "keyword_key"], "left_semi")


def planned_urls(plan: DataFrame, radius_km: Column | None = None, out: str = "search_url") -> DataFrame:
    """Search address per planned search, centred on the city where a radius is given."""
    placed = city_geo(plan, "city")
    url = search_url(F.col("city"), F.col("keyword"), F.col("language"), radius_km, F.col("lat"), F.col("lon"))
    return placed.withColumn(out, url).drop("lat", "lon", "tz")


def with_output_folder(plan: DataFrame, iso: str = "iso", out: str = "folder") -> DataFrame:
    return plan.withColumn(out, sanitize_key(country_folder(F.col(iso))))


def progress_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """``city|keyword|language|STATUS[|count]`` lines -> typed columns; a missing count is null."""
    c = F.col(line)
    return lines.where(text_norm(c) != "").select(
        _field(c, 1).alias("city"),
        _field(c, 2).alias("keyword"),
        _field(c, 3).alias("language"),
        F.upper(_field(c, 4)).alias("status"),
        blank_to_null(_field(c, 5)).try_cast("bigint").alias("rows"),
    )


def progress_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def progress_summary(progress: DataFrame, planned: int | DataFrame, before_start: int = 0) -> DataFrame:
    """Outcome counters, share finished and hours left of a campaign.

    ``planned`` is the number of searches planned, or the plan itself, which is then counted in the
    same pass.
    """
    flags = progress.select("status", "rows", F.lit(0).alias("_p"))
    if isinstance(planned, DataFrame):
        none = F.lit(None)
        flags = flags.unionAll(
            planned.select(none.cast("string").alias("status"), none.cast("bigint").alias("rows"), F.lit(1).alias("_p"))
        )
    counters = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    size = F.sum("_p") if isinstance(planned, DataFrame) else F.lit(planned).cast("bigint")
    out = flags.agg(
        *counters,
        F.coalesce(F.sum("rows"), F.lit(0)).alias("result_rows"),
        F.coalesce(size, F.lit(0)).alias("planned"),
    )
    finished = F.col("success") + F.col("skipped")
    logged = finished + F.col("failed") + F.col("zero_results")
    left = F.greatest(F.col("planned") - logged, F.lit(0).cast("bigint"))
    return out.withColumns(
        {
            "before_start": F.lit(before_start).cast("bigint"),
            "percent_done": percentage(finished, F.col("planned")),
            "remaining": left,
            "eta_hours": F.round(left * F.lit(MINUTES_PER_SEARCH) / F.lit(60.0), 1),
        }
    )
