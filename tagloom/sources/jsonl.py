"""Append-only JSON lines, read so that a torn line costs only itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRECTION = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("predicted", T.ArrayType(T.StringType())), T.StructField("corrected", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()), T.StructField("recorded_at", T.StringType())])


def parse_lines(lines: DataFrame, schema: T.StructType, line: str = "value") -> DataFrame:
    """Records of JSON lines with ``_bad`` set on lines that do not parse; blank lines are gone."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.where(F.trim(line) != "").select(
        *[c for c in lines.columns if c != line], F.from_json(line, with_bad, options).alias("_r"))
    return parsed.select(*[c for c in lines.columns if c != line], "_r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CORRECTION) -> tuple[DataFrame, DataFrame]:
    """``(records, one-row count of dropped lines)``."""
    parsed = parse_lines(spark.read.text(path), schema)
    return (parsed.where("_bad is null").drop("_bad"),
            parsed.agg(F.count_if(F.col("_bad").isNotNull()).alias("dropped")))
