"""Append-only tables whose additions are seen whole or not at all.

An addition is a folder of data files and one manifest.  The data are written first; the manifest then gets its
name by one rename that fails if the name is taken.  Readers take the folders that manifests name, so what a
crash left behind has no manifest and is never read, and two writers cannot both become the same version: the
loser reads the log again and decides anew what it adds.  An addition carries the caller's batch name, and a
batch that is in the log already is not added again, so a job may be repeated after any failure.

Every KEEP versions a manifest lists all folders and batches so far; a reader needs that one and those after it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import InputError

KEEP = 64


@dataclass(frozen=True)
class Manifest:
    """One version of a table: the folder it added, its rows and positions, and what the writer noted."""

    version: int
    batch: str
    folder: str
    rows: int
    total: int
    schema: str
    facts: dict = field(default_factory=dict)
    #: version by batch, and folders in order, of all versions before; only every KEEP versions
    before: dict | None = None

    @property
    def folders(self) -> list[str]:
        return [*(self.before or {}).get("folders", []), self.folder]

    @property
    def batches(self) -> dict[str, int]:
        return {**(self.before or {}).get("batches", {}), self.batch: self.version}


class AppendTable:
    """A table below ``path``; rows get a dense position ``pos`` in the order they were added (from 0)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _name(self, version: int) -> str:
        return f"_log/{version:012d}.json"

    def versions(self) -> list[int]:
        """Committed versions, rising."""
        if not self._files.exists(self._path("_log")):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._path("_log"))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def manifest(self, version: int) -> Manifest:
        source = self._files.open(self._path(self._name(version)))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return Manifest(**json.loads(raw))

    def history(self) -> list[Manifest]:
        """The manifests that a reader needs: the last with all folders, and those after it."""
        out = []
        for version in reversed(self.versions()):
            out.append(self.manifest(version))
            if out[-1].before is not None:
                break
        return out[::-1]

    def committed(self, batch: str) -> Manifest | None:
        """The version that added this batch, if one did."""
        version = next((m.batches[batch] for m in self.history() if batch in m.batches), None)
        return None if version is None else self.manifest(version)

    def read(self, schema: StructType | None = None) -> DataFrame:
        """All committed rows; an empty table of ``schema`` before the first commit."""
        known = self.history()
        if not known:
            if schema is None:
                raise InputError(f"nothing has been added to {self.path}")
            return self.spark.createDataFrame([], schema)
        stored = StructType.fromJson(json.loads(known[-1].schema))
        folders = [f for m in known for f in m.folders]
        return self.spark.read.schema(stored).parquet(*[f"{self.path}/{f}" for f in folders])

    def append(self, make: Callable[[DataFrame | None], tuple[DataFrame, dict]], batch: str, order: str = "pos", tries: int = 20) -> Manifest:
        """Add the rows that ``make`` gives for the rows committed so far (None: none yet), with facts to note.

        The rows' ``order`` column decides their positions.  ``make`` is called again if another writer was faster.
        """
        for _ in range(tries):
            if (done := self.committed(batch)) is not None:
                return done
            known = self.history()
            rows, facts = make(self.read() if known else None)
            start = known[-1].total if known else 0
            folder = f"data/{uuid.uuid4().hex}"
            placed = with_positions(rows, order, start)
            if known and placed.schema.jsonValue() != json.loads(known[-1].schema):
                raise InputError(f"columns {placed.columns} are not those of the table at {self.path}")
            placed.write.parquet(f"{self.path}/{folder}")
            n = self.spark.read.schema(placed.schema).parquet(f"{self.path}/{folder}").count()
            version = known[-1].version + 1 if known else 0
            before = None
            if version % KEEP == 0:
                before = {"folders": [f for m in known for f in m.folders], "batches": {b: v for m in known for b, v in m.batches.items()}}
            new = Manifest(version, batch, folder, n, start + n, json.dumps(placed.schema.jsonValue()), facts, before)
            if self._put(new):
                return new
            self._files.delete(self._path(folder), True)
        raise InputError(f"{tries} other additions to {self.path} were faster")

    def _put(self, manifest: Manifest) -> bool:
        """Give the manifest its name; False if the version is taken."""
        context = self._hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        draft = self._path(f"_log/.{uuid.uuid4().hex}.tmp")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        never_over = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        never_over[0] = self._hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, self._path(self._name(manifest.version)), never_over)
        except Exception as exc:  # the gateway's errors carry the class of the cause in their text
            if "AlreadyExists" not in str(exc):
                raise
            self._files.delete(draft, False)
            return False
        return True

    def leftovers(self) -> list[str]:
        """Data folders that no manifest names: of writers at work, or of a crash."""
        if not self._files.exists(self._path("data")):
            return []
        named = {f for m in self.history() for f in m.folders}
        there = [f"data/{s.getPath().getName()}" for s in self._files.listStatus(self._path("data"))]
        return sorted(set(there) - named)

    def clean(self, older_than_seconds: float) -> list[str]:
        """Remove leftovers that nothing has written to for so long; returns them."""
        now, gone = self.spark._jvm.System.currentTimeMillis(), []
        for folder in self.leftovers():
            if now - self._files.getFileStatus(self._path(folder)).getModificationTime() >= 1000 * older_than_seconds:
                self._files.delete(self._path(folder), True)
                gone.append(folder)
        return gone


def with_positions(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Rows with ``pos``: dense, from ``start``, in the order of the unique integer column ``order``.

    Rows are counted per range of ``order``; running sums over the ranges place each range, and only inside one
    range are rows numbered by a sort.
    """
    bounds = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    width = max(1, ((bounds["high"] or 0) - (bounds["low"] or 0)) // 4096 + 1)
    keyed = rows.withColumn("_range", F.floor((F.col(order) - F.lit(bounds["low"] or 0)) / width))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n"))  # 4 096 at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    placed = keyed.withColumn("_at", inside).join(F.broadcast(starts), "_range")
    return placed.withColumn(order, (F.col("_start") + F.col("_at") - 1 + start).cast("long")).drop("_range", "_at", "_start") \
        .withColumnRenamed(order, "pos")

