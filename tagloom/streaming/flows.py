"""Append-shaped flows as Structured Streaming; each equals its batch operator on the same rows.

Sinks of ``foreachBatch`` write one folder per batch and replace it on a replay, so a batch that
runs twice after a failure leaves one result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.corrections import identity
from ..operators.decisions import answer_lines
from ..plans.predict import predict
from ..sources.jsonl import CORRECTION, parse_lines
from ..sources.model_tables import Model


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batch_sink(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def score_stream(rows: DataFrame, model: Model, sink: str, checkpoint: str, row_id: str = "row_id", clean: bool = True,
                 **options) -> StreamingQuery:
    """Every arriving row gets its prediction lines; stateless, the model's tables are the static side."""
    names = {x.label: x.name for x in model.labels if x.name}

    def step(batch: DataFrame, number: int) -> None:
        _batch_sink(answer_lines(predict(batch, model, row_id, clean, **options), names, row_id), sink, number)

    return _start(rows.writeStream.foreachBatch(step), checkpoint)


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stamped_corrections(lines: DataFrame, schema: T.StructType = CORRECTION) -> DataFrame:
    """Parsed records, torn lines gone; a record without a time of its own is stamped on arrival."""
    parsed = parse_lines(lines.select("value"), schema).where("_bad is null").drop("_bad")
    return parsed.withColumn("recorded_at", F.coalesce("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def append_log(records: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return _start(records.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def unrepeated(records: DataFrame) -> DataFrame:
    """Each correction once; exact, with state as large as the set of identities."""
    return records.withColumn("_identity", identity()).dropDuplicates(["_identity"]).drop("_identity")


def unrepeated_within(records: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Each correction once among those no further apart than ``delay``: bounded state, and a repeat
    that comes later than the delay is let through."""
    return (records.withColumn("_identity", identity()).withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(["_identity"]).drop("_identity"))


def first_wins_stream(rows: DataFrame, key: str, row_id: str, sink: str, checkpoint: str, carry: Sequence[str] = ()) -> StreamingQuery:
    """First row of every key over arriving blocks: ``row_id, key`` and the columns to ``carry``.

    An earlier block wins, and inside a block the smallest id.  What has been seen is state of the stream, one
    small row per key (with what is carried), so a block costs what its own keys cost, however many came before;
    on a cluster the state belongs into a RocksDB store (``spark.sql.streaming.stateStore.providerClass``).
    """
    # all rows of a block have the block's time, also when it is run again
    arrival = F.struct(F.col("_at").alias("at"), F.col(row_id), *[F.col(c) for c in carry])
    first = rows.withColumn("_at", F.current_timestamp()).groupBy(key).agg(F.min(arrival).alias("first")).where(F.col("first.at") == F.current_timestamp())
    kept = first.select(F.col(f"first.{row_id}").alias(row_id), key, *[F.col(f"first.{c}").alias(c) for c in carry])
    return _start(kept.writeStream.outputMode("update").foreachBatch(lambda batch, number: _batch_sink(batch, sink, number)), checkpoint)


def running_counts(records: DataFrame, column: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Counts so far, replaced with every batch; one row per value is all the state there is."""
    counts = records.groupBy(column).agg(F.count("*").alias("n"))

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return _start(counts.writeStream.outputMode("complete").foreachBatch(step), checkpoint)
