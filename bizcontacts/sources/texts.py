"""Line-based inputs: domain lists, progress logs, campaign lists, keyword dictionaries; and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizcontacts.functions.text import blank_to_null, utrim
from bizcontacts.operators.campaign import parse_cities, parse_terms, progress_fields
from bizcontacts.operators.pages import domain_lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a domain list: one entry per line, ``#`` lines and blank lines dropped."""
    return domain_lines(_lines(spark, path)).select("url")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return progress_fields(_lines(spark, path))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """Campaign cities of one file, a ``City|ISO|group`` or ``City|group`` per line, in line order.

    The sequence number only has to grow with the lines; plans number their searches themselves.
    """
    return parse_cities(_lines(spark, path).withColumn("seq", F.monotonically_increasing_id()))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return parse_terms(_lines(spark, path))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """business_type, language, keyword from a two-level YAML map, or from JSON ending in ``.json``.

    YAML is cut into sections at each ``type:`` on the left edge; the indented ``lang: "word"``
    lines of a section are its translations.
    """
    whole = spark.read.text(path, wholetext=True)
    if path.endswith(".json"):
        nested = F.from_json("value", "map<string, map<string, string>>")
        types = whole.select(F.explode(nested).alias("business_type", "_words"))
        return types.select("business_type", F.explode("_words").alias("language", "keyword"))
    text = F.concat(F.lit("\n"), F.replace(F.col("value"), F.lit("\r"), F.lit("")))
    sections = whole.select(F.explode(F.split(text, r"\n(?=[A-Za-z0-9_-]+:[ \t]*(?:#|\n|$))")).alias("_s"))
    pairs = sections.select(
        blank_to_null(F.regexp_extract("_s", r"^([A-Za-z0-9_-]+):", 1)).alias("business_type"),
        F.explode(F.regexp_extract_all("_s", F.lit(r"(?m)^[ \t]+([A-Za-z-]+:.*)$"), F.lit(1))).alias("_p"),
    )
    word = utrim(F.regexp_extract("_p", r"^[A-Za-z-]+:(.*)$", 1))
    double, single = (F.regexp_extract(word, f"^{q}([^{q}]*){q}", 1) for q in "\"'")
    bare = F.regexp_replace(word, r"\s+#.*$", "")
    return pairs.where(F.col("business_type").isNotNull()).select(
        "business_type",
        F.regexp_extract("_p", r"^([A-Za-z-]+):", 1).alias("language"),
        F.when(word.startswith('"'), double).when(word.startswith("'"), single).otherwise(bare).alias("keyword"),
    )


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored pages as page_id, url, html. ``fmt``: ``parquet``, or ``files`` for a folder of HTML
    files, whose path then serves as the URL."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html")
    if fmt != "files":
        raise ValueError(f"fmt: {fmt!r}")
    raw = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path)
    return raw.select(
        F.xxhash64("path").alias("page_id"),
        F.col("path").alias("url"),
        F.decode("content", "UTF-8").alias("html"),
    )
