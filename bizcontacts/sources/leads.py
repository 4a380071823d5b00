"""Lead files: CSV with differing column sets in, one DataFrame out, and a table of what was left out.

Cells are read by position. A second, narrow scan finds each file's header line; the table of
layouts made from it tells which cell belongs to which column. Nothing is read outside Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fnmatch import fnmatch
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizcontacts.functions.text import sanitize_key, search_key
from bizcontacts.operators.contacts import pin
from bizcontacts.schemas import LEAD_COLUMNS, LEAD_SCHEMA, NA_WORDS, TIME_FORMAT

# Where a row stands: sorting by these three columns gives file order, then line order.
LINE_ORDER = ("_file", "_block", "_line")
# greatest number of columns of a file; a row with more cells is rejected, whatever its header says
CELLS = 64
# numbers of columns a line is parsed into, the least that holds its cells; up to CELLS beyond the last
PARSE_WIDTHS = (4, 8, 16, 32)
REJECT_COLUMNS = ("file", "block", "line", "reason", "record")
_SAFE = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


class Listed(NamedTuple):
    """One file of a listing; the time in seconds."""

    path: str
    size: int
    mtime: float


def _listed(status) -> Listed:
    return Listed(status.getPath().toString(), status.getLen(), status.getModificationTime() / 1000)


def list_files(spark: SparkSession, patterns: Sequence[str]) -> tuple[list[Listed], list[str]]:
    """Files matching the patterns, each once and sorted, and the patterns that match nothing."""
    found: dict[str, Listed] = {}
    missing: list[str] = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        statuses = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        files = [_listed(s) for s in statuses or [] if s.isFile()]
        found.update((f.path, f) for f in files)
        if not files:
            missing.append(pattern)
    return sorted(found.values()), missing


def list_below(spark: SparkSession, root: str, pattern: str) -> list[Listed]:
    """Files at any depth below ``root`` whose names match the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    walk = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while walk.hasNext():
        status = walk.next()
        if fnmatch(status.getPath().getName(), pattern):
            found.append(_listed(status))
    return sorted(found)


def expand_paths(spark: SparkSession, patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Paths of the files matching the patterns, and the patterns that match nothing."""
    files, missing = list_files(spark, patterns)
    return [f.path for f in files], missing


def clean_missing(c: Column) -> Column:
    """Null for every word that stands for a missing value."""
    return F.when(~c.isin(*NA_WORDS), c)


def typed(text: Column, kind: T.DataType) -> Column:
    """Cell text as a value of a lead column; what does not fit is null."""
    text = clean_missing(text)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(text, F.lit(TIME_FORMAT))
    if isinstance(kind, T.LongType):
        return text.try_cast("double").cast("bigint")
    return text.try_cast("double") if isinstance(kind, T.DoubleType) else text


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a costly value that is evaluated a single time, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _parsed(line: Column, width: int) -> Column:
    """The first ``width`` cells of one CSV line, and past ``CELLS`` one more, ``...``, if there are others."""
    names = [f"c{i}" for i in range(width)]
    over = ["over"] if width == CELLS else []
    row = F.from_csv(line, ", ".join(f"{n} string" for n in names + over), {"escape": '"', "mode": "PERMISSIVE"})
    return _once(row, lambda r: F.array(
        *[r[n] for n in names], *[F.when(r[n].isNotNull(), F.lit("...")) for n in over]))


def split_cells(line: Column | str) -> Column:
    """Cells of one CSV line, quoted ones unquoted; trailing empty cells are left off.

    A line with more than ``CELLS`` cells keeps the first of them and one more, ``...``. Each column that a
    line lacks is costly, so a line is parsed into a few more columns than its commas allow at most.
    """
    line = F.col(line) if isinstance(line, str) else line
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    by_width = F
    for width in PARSE_WIDTHS:
        by_width = by_width.when(commas < width, _parsed(line, width))
    return _once(by_width.otherwise(_parsed(line, CELLS)), _trailing_cut)


def _trailing_cut(cells: Column) -> Column:
    """Cells up to the last one that is filled."""
    filled = F.array_max(F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1)))
    return F.slice(cells, 1, F.coalesce(filled, F.lit(0)))


def layouts(headers: DataFrame) -> DataFrame:
    """``_file``, ``_names`` -> ``_file``, ``_width``, the cell of each lead column, and the other columns' names and cells.

    Further columns are carried along.

    Of columns named alike the first counts as the lead column; later ones, and unnamed ones, get the
    name ``_c`` and their place.
    """
    names = F.col("_names")
    place = {c: F.nullif(F.array_position(names, c), F.lit(0)).cast("int").alias(c) for c in LEAD_COLUMNS}
    own = F.transform(names, lambda n, i: F.struct(
        F.when(n.isNull() | (F.array_position(names, n) <= i), F.concat(F.lit("_c"), i.cast("string")))
        .otherwise(n).alias("name"), (i + 1).alias("cell")))
    other = F.filter(own, lambda o: ~o["name"].isin(*LEAD_COLUMNS))
    return headers.select(*[c for c in headers.columns if c != "_names"], F.size(names).alias("_width"),
                          F.struct(*place.values()).alias("_at"), other.alias("_others"))


def first_lines(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """``_file``, ``_names`` and the place of each file's first line that is not blank.

    One line per file and task goes through the shuffle.
    """
    top = Window.partitionBy("_file").orderBy(*order)
    first = lines.where(F.col("_text").rlike(r"\S")).withColumn("_rn", F.row_number().over(top)).where("_rn = 1")
    bare = F.regexp_replace(F.col("_text"), "^\ufeff", "")
    heads = first.select("_file", *[F.col(c).alias(f"_head{c}") for c in order], bare.alias("_text"))
    return pin(heads, "_names", split_cells("_text")).drop("_text")


def place_cells(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows of cells (``_file``, ``_cells``, further columns) as lead columns, ``_other`` and ``_long``.

    Further columns of the layouts follow those of the rows.

    ``_other`` maps the names of all other columns to their cells; null where a file has none. ``_long`` is true
    for a row with more cells than its file has columns.
    """
    def cell(at: Column) -> Column:
        return F.get("_cells", at - 1)

    used = ("_cells", "_file", "_width", "_at", "_others")
    carried = ["_file", *[c for c in (*rows.columns, *layout.columns) if c not in used]]
    leads = [typed(cell(F.col(f"_at.{f.name}")), f.dataType).alias(f.name) for f in LEAD_SCHEMA.fields]
    other = F.when(F.size("_others") > 0, F.map_from_entries(F.transform(
        "_others", lambda o: F.struct(o["name"], clean_missing(cell(o["cell"]))))))
    return rows.join(layout, "_file").select(
        *leads, other.alias("_other"), *carried, (F.size("_cells") > F.col("_width")).alias("_long"), "_cells")


# --- tables of lines ---------------------------------------------------------------------------

def _table_rows(lines: DataFrame) -> DataFrame:
    named = lines.select(F.col("file").alias("_file"), F.col("pos").alias("_line"), F.col("line").alias("_text"))
    rows = pin(named.where(F.col("_text").rlike(r"\S")), "_cells", split_cells("_text"))
    # lines are parsed where they are read: one file may hold most of them
    return place_cells(rows, layouts(first_lines(named, ["_line"]))).where("_line > _head_line")


def lead_rows(lines: DataFrame) -> DataFrame:
    """Leads of a table of CSV lines (file, pos, line): ``file``, ``pos``, the lead columns and ``_other``.

    The first line of a file that is not blank names its columns. Blank lines are no rows; rows with
    more cells than columns are left to ``line_rejects``. Null lines count as blank.
    """
    rows = _table_rows(lines).where(~F.col("_long"))
    return rows.select(F.col("_file").alias("file"), F.col("_line").alias("pos"), *LEAD_COLUMNS, "_other")


def line_rejects(lines: DataFrame, files: DataFrame) -> DataFrame:
    """What ``lead_rows`` leaves out: file, pos, reason, record. ``files`` (file) lists all files.

    A file without any line that is not blank is ``empty``; a row is ``long``.
    """
    long = _table_rows(lines).where("_long").select(
        F.col("_file").alias("file"), F.col("_line").alias("pos"), F.lit("long").alias("reason"), F.col("_text").alias("record"))
    filled = lines.where(F.col("line").rlike(r"\S")).select("file").distinct()
    empty = files.select("file").distinct().join(filled, "file", "left_anti").select(
        "file", F.lit(None).cast("bigint").alias("pos"), F.lit("empty").alias("reason"), F.lit(None).cast("string").alias("record"))
    return long.unionByName(empty)


# --- files -------------------------------------------------------------------------------------

class LeadFiles:
    """Listed lead files, read when asked."""

    def __init__(self, spark: SparkSession, files: Sequence[Listed], multiline: bool = True):
        self.spark, self.files, self.multiline = spark, files, multiline
        self.paths = [_literal(f.path) for f in files]

    def _place(self) -> list[Column]:
        return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_line")]

    def listed(self) -> DataFrame:
        """``_file``, ``_size``, ``_mtime`` of all files, empty ones too."""
        rows = self.spark.createDataFrame([tuple(f) for f in self.files], "_file string, _size long, _at double")
        return rows.select("_file", "_size", F.timestamp_seconds("_at").alias("_mtime"))

    def lines(self) -> DataFrame:
        """First block of each file, line by line."""
        text = self.spark.read.options(**_SAFE).text(self.paths)
        return text.select(F.col("value").alias("_text"), *self._place()).where("_block = 0")

    def rows(self) -> DataFrame:
        """All rows behind the header lines, placed."""
        schema = ", ".join(f"c{i} string" for i in range(CELLS)) + ", over string, _record string"
        raw = (self.spark.read.schema(schema).options(**_SAFE).option("header", True)
               .option("multiLine", self.multiline).option("escape", '"').option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_record").csv(self.paths))
        over = F.when(F.col("over").isNotNull(), F.lit("..."))
        cells = _trailing_cut(F.array(*[F.col(f"c{i}") for i in range(CELLS)], over))
        placed = raw.select(*self._place(), F.col("_metadata.file_modification_time").alias("_mtime"), "_record",
                            cells.alias("_cells"))
        return place_cells(placed, layouts(first_lines(self.lines(), ["_line"])))

    def leads(self) -> DataFrame:
        return self.rows().where(~F.col("_long")).drop("_long", "_record", "_cells")

    def rejects(self) -> DataFrame:
        """Files and rows that ``leads`` lacks: file, block, line, reason, record.

        Reasons: ``empty`` (no byte, or blank lines only), ``unreadable`` (bytes, but no line could be
        read), ``long`` (more cells than columns).
        """
        none = F.lit(None)
        long = self.rows().where("_long").select(
            F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_line").alias("line"),
            F.lit("long").alias("reason"), F.coalesce("_record", F.array_join("_cells", ",")).alias("record"))
        seen = self.lines().groupBy("_file").agg(F.bool_or(F.col("_text").rlike(r"\S")).alias("_filled"))
        bare = self.listed().join(seen, "_file", "left").where(~F.coalesce("_filled", F.lit(False)))
        unread = F.col("_filled").isNull() & (F.col("_size") > 0)
        whole = bare.select(
            F.col("_file").alias("file"), none.cast("bigint").alias("block"), none.cast("bigint").alias("line"),
            F.when(unread, "unreadable").otherwise("empty").alias("reason"), none.cast("string").alias("record"))
        return long.unionByName(whole)


def _literal(path: str) -> str:
    """A path whose glob signs mean themselves."""
    return "".join("\\" + ch if ch in "\\[]{}*?" else ch for ch in path)


def read_leads(spark: SparkSession, patterns: Sequence[str] | str, multiline: bool = True) -> DataFrame:
    """All lead files matching the patterns as one DataFrame: the lead columns, typed, ``_other``, ``LINE_ORDER``
    and the file time ``_mtime``.

    Files may lack columns or order them differently; missing ones are null, and cells of columns that
    are no lead column are in the map ``_other``. Nothing is inferred: a phone keeps its plus sign, a
    postal code its leading zero. A short row is filled with nulls. Empty and unreadable files, and
    rows with more cells than columns, are in ``lead_rejects`` instead. ``multiline`` allows line
    breaks inside quotes but reads each file in one task; switch it off for large files.
    """
    files, _ = list_files(spark, [patterns] if isinstance(patterns, str) else patterns)
    if files:
        return LeadFiles(spark, files, multiline).leads()
    fields = [*LEAD_SCHEMA.fields, T.StructField("_other", T.MapType(T.StringType(), T.StringType()))]
    place = [("_file", T.StringType()), ("_block", T.LongType()), ("_line", T.LongType()), ("_mtime", T.TimestampType())]
    return spark.createDataFrame([], T.StructType([*fields, *(T.StructField(n, t) for n, t in place)]))


def lead_rejects(spark: SparkSession, patterns: Sequence[str] | str, multiline: bool = True) -> DataFrame:
    """What ``read_leads`` leaves out of the same patterns: file, block, line, reason, record.

    Besides the reasons of ``LeadFiles.rejects``, ``unmatched`` names a pattern without any file.
    Every row of every file is either among the leads or here.
    """
    files, missing = list_files(spark, [patterns] if isinstance(patterns, str) else patterns)
    lost = spark.createDataFrame([(m, None, None, "unmatched", None) for m in missing],
                                 "file string, block long, line long, reason string, record string")
    return lost.unionByName(LeadFiles(spark, files, multiline).rejects()) if files else lost


def result_files(spark: SparkSession, root: str, pattern: str = "*.csv", searches: DataFrame | None = None) -> DataFrame:
    """One row per result file and search below ``root``: city_key, keyword_key, file, mtime, rows.

    The search is read from the rows' own columns, not from the file name, so a keyword that starts
    like another one is never mistaken for it. A file without rows (empty, a header alone, unreadable)
    counts with 0 rows for those of ``searches`` (city_key, keyword_key) whose results bear its name;
    it may be the newest one.
    """
    files = list_below(spark, root, pattern)
    if not files:
        return spark.createDataFrame([], "city_key string, keyword_key string, file string, mtime timestamp, rows long")
    source = LeadFiles(spark, files)
    found = source.leads().groupBy(
        search_key("search_city").alias("city_key"), search_key("search_keyword").alias("keyword_key"),
        F.col("_file").alias("file"), F.col("_mtime").alias("mtime"),
    ).agg(F.count(F.lit(1)).alias("rows"))
    if searches is None:
        return found
    named = F.regexp_extract(F.col("_file"), r"([^/]*?)(?:_\d{8})?(?:_\d{6})?\.[^./]*$", 1)
    bare = source.listed().join(found.select(F.col("file").alias("_file")), "_file", "left_anti").select(
        named.alias("_name"), F.col("_file").alias("file"), F.col("_mtime").alias("mtime"),
        F.lit(0).cast("bigint").alias("rows"))
    names = searches.select("city_key", "keyword_key", F.concat_ws(
        "_", sanitize_key("city_key"), sanitize_key("keyword_key")).alias("_name")).distinct()
    return found.unionByName(bare.join(names, "_name").drop("_name"))
