"""Which encoding a file's bytes call for, over a whole set of files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------------
MULTIBYTE = (
    r"[\xC2-\xDF][\x80-\xBF]"
    r"|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)
CP1252_UNDEFINED = r"[\x81\x8D\x8F\x90\x9D]"
MAX_REPLACED = 10
ACCIDENTAL_SHARE = 0.05
# -----------------------------------------------------------------------------------------


def byte_evidence(line: Column) -> dict[str, Column]:
    """Counts on one line of bytes, each byte seen as one Latin-1 character."""
    latin = F.decode(line.cast("binary"), "ISO-8859-1")
    valid = F.regexp_count(latin, F.lit(MULTIBYTE))
    rest = F.regexp_replace(latin, MULTIBYTE, "")
    return {"valid": valid, "invalid": F.regexp_count(rest, F.lit(r"[\x80-\xFF]")),
            "undefined": F.regexp_count(latin, F.lit(CP1252_UNDEFINED))}


def decide(valid: Column, invalid: Column, undefined: Column) -> Column:
    """utf-8, cp1252, utf-8 with some bytes replaced, or refused with the reason."""
    return (F.when(invalid == 0, "utf-8")
            .when((valid <= ACCIDENTAL_SHARE * (valid + invalid)) & (undefined > 0), "refused: neither UTF-8 nor Windows-1252")
            .when(valid <= ACCIDENTAL_SHARE * (valid + invalid), "cp1252")
            .when((invalid <= MAX_REPLACED) & (valid > invalid), "utf-8 replace")
            .otherwise("refused: mixed encodings"))


def audit(lines: DataFrame, file: str = "file", line: str = "value", at: str | None = None) -> DataFrame:
    """Per file: evidence, the first bad line, and the decision.  Lines never cut a sequence.

    ``at`` names the column of a line's place in its file; without one, the smallest bad line is shown.
    """
    seen = byte_evidence(F.col(line))
    place = F.col(at) if at else F.col(line)
    counted = lines.select(file, line, place.alias("_place"), *[c.alias(k) for k, c in seen.items()])
    sums = counted.groupBy(file).agg(
        F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"), F.sum("undefined").alias("undefined"),
        F.min_by(line, F.when(F.col("invalid") > 0, F.col("_place"))).alias("bad_line"))
    return sums.withColumn("encoding", decide(F.col("valid"), F.col("invalid"), F.col("undefined")))


def audit_files(spark: SparkSession, path: str) -> DataFrame:
    """``audit`` over files (compressed ones by suffix), with the first bad line of each.

    A line's place is where its part of the file starts, then its turn in that part.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("turn"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", place.alias("at"))
    return audit(raw, at="at")
