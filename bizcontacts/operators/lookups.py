"""Look-ups in dimension tables, most of them with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizcontacts.functions.text import blank_to_null, text_norm, utrim
from bizcontacts.operators.joins import lookup
from bizcontacts.sources import dims


def _base_language(language: Column) -> Column:
    return F.split_part(language, F.lit("-"), F.lit(1))


def translate_keyword(df: DataFrame, keywords: DataFrame, business_type: str, language: str,
                      out: str = "keyword") -> DataFrame:
    """Keyword of (type, language), else the English one, else the type itself."""
    by_lang = keywords.select(
        F.col("business_type").alias(business_type), F.col("language").alias(language),
        F.col("keyword").alias("_own"),
    )
    english = keywords.where(F.col("language") == "en").select(
        F.col("business_type").alias(business_type), F.col("keyword").alias("_en")
    )
    return (
        df.join(by_lang, [business_type, language], "left")
        .join(english, business_type, "left")
        .withColumn(out, F.coalesce("_own", "_en", business_type))
        .drop("_own", "_en")
    )


def keyword_catalog(keywords: DataFrame, show: str = "en", ordered: bool = False) -> DataFrame:
    """Per business type, in one pass: its languages, their number, and the keyword to show for the
    language ``show``, with the English one and ``-`` to fall back on; ``ordered`` sorts by type."""
    def of(code: str) -> Column:
        return blank_to_null(F.max(F.when(F.col("language") == code, F.col("keyword"))))

    found = keywords.groupBy("business_type").agg(
        F.collect_set("language").alias("_langs"), F.coalesce(of(show), of("en"), F.lit("-")).alias("shown")
    )
    listed = found.select(
        "business_type",
        F.array_join(F.sort_array("_langs"), ", ").alias("languages"),
        F.size("_langs").alias("n_languages"),
        "shown",
    )
    return listed.orderBy("business_type") if ordered else listed


def city_country(df: DataFrame, city: str, out: str = "country_code") -> DataFrame:
    dim = dims.city_dim(df.sparkSession)
    joined = lookup(df, dim, text_norm(city), "city_key", {"city_country": "_iso"})
    return joined.withColumn(out, F.coalesce("_iso", F.lit(dims.DEFAULT_COUNTRY))).drop("_iso")


def city_geo(df: DataFrame, city: str, strict: bool = False) -> DataFrame:
    """lat, lon and tz of a city. Unknown cities get the default place, or null if ``strict``."""
    dim = dims.city_dim(df.sparkSession)
    take = {"city_lat": "lat", "city_lon": "lon", "city_tz": "tz"}
    joined = lookup(df, dim, text_norm(city), "city_key", take)
    if strict:
        return joined
    return joined.withColumns(
        {
            "lat": F.coalesce("lat", F.lit(dims.DEFAULT_LAT)),
            "lon": F.coalesce("lon", F.lit(dims.DEFAULT_LON)),
            "tz": F.coalesce("tz", F.lit(dims.DEFAULT_TZ)),
        }
    )


def tiered_geo(df: DataFrame, city: str, language: str) -> DataFrame:
    """lat, lon, tz by city, else language, else base language, else default; and the locale."""
    spark = df.sparkSession
    lang = text_norm(language)
    out = lookup(df, dims.city_dim(spark), text_norm(city), "city_key",
                 {"city_lat": "_c_lat", "city_lon": "_c_lon", "city_tz": "_c_tz"})
    names = ("lang_lat", "lang_lon", "lang_tz", "locale", "accept")
    for tier, key in (("e", lang), ("b", _base_language(lang))):
        out = lookup(out, dims.language_dim(spark), key, "language", {n: f"_{tier}_{n}" for n in names})
    return out.withColumns(
        {
            "lat": F.coalesce("_c_lat", "_e_lang_lat", "_b_lang_lat", F.lit(dims.DEFAULT_LAT)),
            "lon": F.coalesce("_c_lon", "_e_lang_lon", "_b_lang_lon", F.lit(dims.DEFAULT_LON)),
            "tz": F.coalesce("_c_tz", "_e_lang_tz", "_b_lang_tz", F.lit(dims.DEFAULT_TZ)),
            "locale": F.coalesce("_e_locale", "_b_locale", F.lit(dims.DEFAULT_LOCALE)),
            "accept": F.coalesce("_e_accept", "_b_accept", F.lit(dims.DEFAULT_ACCEPT)),
        }
    ).drop("_c_lat", "_c_lon", "_c_tz", *[f"_{t}_{n}" for t in "eb" for n in names])


def phone_country(df: DataFrame, language: str, city: str, explicit: str | None = None,
                  out: str = "phone_country") -> DataFrame:
    """Country phones are read for: given, else by language, base language, city, else default."""
    spark = df.sparkSession
    lang = text_norm(language)
    joined = lookup(df, dims.language_dim(spark), lang, "language", {"phone_country": "_exact"})
    joined = lookup(joined, dims.language_dim(spark), _base_language(lang), "language",
                    {"phone_country": "_base"})
    joined = lookup(joined, dims.city_dim(spark), text_norm(city), "city_key", {"city_country": "_city"})
    given = [blank_to_null(explicit)] if explicit else []
    return joined.withColumn(
        out, F.coalesce(*given, "_exact", "_base", "_city", F.lit(dims.DEFAULT_COUNTRY))
    ).drop("_exact", "_base", "_city")


def campaign_phone_country(df: DataFrame, language: str, out: str = "phone_country") -> DataFrame:
    """Country of a campaign language; a code without entry is taken as the country itself."""
    joined = lookup(df, dims.language_dim(df.sparkSession), F.col(language), "language",
                    {"phone_country": "_iso"})
    return joined.withColumn(out, F.coalesce("_iso", F.upper(language))).drop("_iso")


def language_country(df: DataFrame, language: str, out: str = "country") -> DataFrame:
    lang = text_norm(language)
    dim = dims.language_country_dim(df.sparkSession)
    joined = lookup(df, dim, lang, "language", {"country": "_exact"})
    joined = lookup(joined, dim, _base_language(lang), "language", {"country": "_base"})
    return joined.withColumn(
        out, F.coalesce("_exact", "_base", F.lit(dims.DEFAULT_COUNTRY))
    ).drop("_exact", "_base")


def country_iso(df: DataFrame, name: str, out: str = "iso") -> DataFrame:
    """ISO code of a country name; two letters pass through, unknown names give null."""
    plain = utrim(name)
    key = F.translate(F.lower(plain), "_-", "  ")
    joined = lookup(df, dims.country_dim(df.sparkSession), key, "country_name", {"iso": "_iso"})
    two = (F.length(plain) == 2) & plain.rlike(r"^\p{L}{2}$")
    return joined.withColumn(out, F.when(two, F.upper(plain)).otherwise(F.col("_iso"))).drop("_iso")


def country_folder(iso: Column) -> Column:
    """Output folder of a country."""
    chain = iso
    for code, folder in dims.COUNTRY_FOLDERS.items():
        chain = F.when(iso == code, F.lit(folder)).otherwise(chain)
    return chain
