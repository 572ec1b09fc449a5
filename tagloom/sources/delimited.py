"""Delimited exports: tolerant reading, previews, row counts, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import missing_as_empty
from ..session import InputError

DELIMITERS = (";", ",", "\t", "|")  # fixed value: candidates, first wins a tie
SUFFIXES = (".csv", ".csv.gz")


def header_separator(header: Column) -> Column:
    """The most frequent candidate outside quotes; the first one on a tie."""
    plain = F.regexp_replace(header, '"[^"]*"', "")
    counts = [F.length(plain) - F.length(F.replace(plain, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    chain = F.lit(DELIMITERS[-1])
    for delimiter, count in reversed(list(zip(DELIMITERS, counts, strict=True))):
        chain = F.when(count == most, delimiter).otherwise(chain)
    return chain


def _reader(spark: SparkSession, separator: str, encoding: str = "UTF-8"):
    return (spark.read.option("sep", separator).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("encoding", encoding)
            .option("mode", "PERMISSIVE").option("maxCharsPerColumn", -1))


def header_columns(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of an export; no type inference, so only the header is looked at."""
    return _reader(spark, separator, encoding).option("inferSchema", False).csv(path).columns


def read_delimited(spark: SparkSession, path: str, text_columns: Sequence[str], label_column: str | None = None, *,
                   separator: str = ";", verbatim: Sequence[str] = (), encoding: str = "UTF-8",
                   partitions: int | None = None) -> DataFrame:
    """The wanted columns of an export, every cell a string, plus ``_file`` and ``_at`` (see ``with_row_id``).

    Text cells that mean "missing" become empty; label, name and mark cells stay as written.
    Compressed and multi-line files are one task each, so spread them with ``partitions``.
    """
    columns = header_columns(spark, path, separator, encoding)
    raw = [c for c in (label_column, *verbatim) if c]
    missing = [c for c in (*text_columns, *([label_column] if label_column else [])) if c not in columns]
    if missing:
        raise InputError(f"columns {missing} not found; the file has {sorted(columns)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # every file's header is held against these columns: files in another order are refused, never mixed up
    df = _reader(spark, separator, encoding).option("enforceSchema", False).schema(schema).csv(path)
    kept_raw = [c for c in dict.fromkeys(raw) if c in columns and c not in text_columns]
    out = df.select(*[missing_as_empty(F.col(f"`{c}`")).alias(c) for c in text_columns],
                    *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in kept_raw],
                    F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return out.repartition(partitions) if partitions else out


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """File order as one key, from the ``_file`` and ``_at`` columns of ``read_delimited``.

    A multi-line file is read by one task, so the position counter rises along it; files follow
    each other by name.  Store the result: the key is part of the ingested table.
    """
    names = Window.orderBy("_file")  # one row per file
    files = df.select("_file").distinct().withColumn("_no", F.row_number().over(names))
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return df.join(files, "_file").withColumn(out, F.shiftleft(F.col("_no").cast("long"), 33) + low).drop("_no", "_at")


def list_exports(spark: SparkSession, folder: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``(path, length)`` of the data files in a folder, by name, paged; contents are not read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
             .where(F.lower("path").rlike(r"\.csv(\.gz)?$")).orderBy("path").offset(offset))
    return found if limit is None else found.limit(limit)


def _export(path: Column, parts: bool) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "") if parts else path


def row_counts(spark: SparkSession, folder: str, *, separator: str = ";", limit: int | None = None,
               offset: int = 0, parts: bool = False) -> DataFrame:
    """Records per file -- a line break in quotes ends none -- for one page of the folder.

    With ``parts`` an export is a folder of part files, as Spark writes them, and is counted as one; a large export
    is then read by many tasks.

    Without ``limit`` and ``offset`` the whole folder is counted in one job; else the page is narrowed before
    anything is counted, and only its file names reach the driver.
    """
    path = _export(F.col("_metadata.file_path"), parts)
    if limit is None and not offset:
        everything = _reader(spark, separator).option("recursiveFileLookup", True).csv(folder)
        exports = everything.where(F.lower("_metadata.file_path").rlike(r"\.csv(\.gz)?$")).select(path.alias("path"))
        return exports.groupBy("path").agg(F.count("*").alias("rows")).orderBy("path")
    if parts:
        found = list_exports(spark, folder).select(_export(F.col("path"), parts).alias("path")).distinct().orderBy("path").offset(offset)
        found = found if limit is None else found.limit(limit)
    else:
        found = list_exports(spark, folder, limit, offset)
    page = [r["path"] for r in found.collect()]
    if not page:
        return spark.createDataFrame([], "path string, rows long")
    df = _reader(spark, separator).csv(page)
    counted = df.select(path.alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    return counted.orderBy("path")


def preview(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """First ``n`` rows, missing cells as empty text."""
    return df.orderBy(row_id).limit(n).na.fill("")


def write_delimited(df: DataFrame, path: str, *, separator: str = ";", compression: str = "none") -> None:
    """A new export; an existing one is never overwritten."""
    (df.write.mode("errorifexists").option("sep", separator).option("header", True).option("quote", '"')
     .option("escape", '"').option("compression", compression).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
