"""Record layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# Export order of the lead columns and the time format in files.
LEAD_TEXT_COLUMNS = (
    "business_name", "phone", "email", "address", "city", "postal_code", "country", "website",
)
LEAD_COLUMNS = LEAD_TEXT_COLUMNS + (
    "rating", "review_count", "category", "hours", "price_range", "google_maps_url",
    "scraped_date", "search_keyword", "search_city",
)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

_TYPES = {
    "rating": T.DoubleType(),
    "review_count": T.LongType(),
    "scraped_date": T.TimestampType(),
}

LEAD_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in LEAD_COLUMNS])

# Words in CSV files that stand for a missing value.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
