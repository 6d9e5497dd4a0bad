"""An additive roll-up that counts every row once, whatever is killed and run again.

A batch adds an increment: its sums by key are written first, then one ledger row (batch, last id, rows) commits them; readers
sum the increments that the ledger names. A batch killed before its ledger row is written again to the same place. One that
was committed is not added again: by its number if the stream's checkpoint lived on, and by the high-water mark of its ids if
it did not. Compaction sums committed increments into one and moves a pointer, so the ledger stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch long, last_id long, rows long"
BASES = "version long, through long, last_id long, rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Ledger:
    """The roll-up of a stream of rows with ascending ids (of a log: later rows have larger ones) in a folder."""

    def __init__(self, spark: SparkSession, folder: str, row_id: str, keys: dict[str, Column], sums: dict[str, Column]):
        self.spark, self.folder, self.row_id, self.keys, self.sums = spark, folder, row_id, keys, sums

    def _rows(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).json(f"{path}/*") if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _base(self):
        """The newest compaction, if there is one."""
        rows = self._rows("bases", BASES).orderBy(F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def committed(self) -> DataFrame:
        """The ledger rows that no compaction holds."""
        base = self._base()
        return self._rows("ledger", LEDGER).where(F.col("batch") > (base.through if base else -1))

    def mark(self) -> int | None:
        """The largest id that is counted; null before the first batch."""
        base, own = self._base(), self.committed().agg(F.max("last_id")).first()[0]
        return max((x for x in (own, base and base.last_id) if x is not None), default=None)

    def _increment(self, batch: DataFrame) -> DataFrame:
        return batch.groupBy(*[c.alias(k) for k, c in self.keys.items()]).agg(*[F.sum(c).alias(k) for k, c in self.sums.items()])

    def add(self, batch: DataFrame, number: int, commit: bool = True) -> bool:
        """Count the rows of a batch that are not counted yet; whether there was anything to do. commit is off in a test that
        kills a batch half-way."""
        base = self._base()
        if (base and number <= base.through) or not self._rows("ledger", LEDGER).where(F.col("batch") == number).isEmpty():
            return False
        mark = self.mark()
        own = batch if mark is None else batch.where(F.col(self.row_id) > mark)
        last, rows = own.agg(F.max(self.row_id), F.count(F.lit(1))).first()
        if rows:
            self._increment(own).write.mode("overwrite").parquet(f"{self.folder}/increments/batch={number}")
        if commit:
            row = self.spark.range(1).select(F.lit(number).alias("batch"), F.lit(last).cast("long").alias("last_id"), F.lit(rows).alias("rows"))
            row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/{number}")
        return bool(rows)

    def total(self) -> DataFrame:
        """The sums by key of all committed increments."""
        base = self._base()
        parts = [f"{self.folder}/bases-data/{base.version}"] if base else []
        parts += [f"{self.folder}/increments/batch={r.batch}" for r in self.committed().where("rows > 0").collect()]  # a row per batch since the last compaction
        if not parts:
            raise ValueError("nothing is committed yet")
        rows = self.spark.read.parquet(*parts)
        return rows.groupBy(*self.keys).agg(*[F.sum(k).alias(k) for k in self.sums])

    def compact(self) -> None:
        """Sum what is committed into one table; the pointer row that readers follow is written last."""
        base = self._base()
        through, rows = self.committed().agg(F.max("batch"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if through is None:
            return
        version, mark = (base.version + 1 if base else 0), self.mark()
        self.total().write.mode("overwrite").parquet(f"{self.folder}/bases-data/{version}")
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(through).alias("through"), F.lit(mark).cast("long").alias("last_id"), F.lit(rows + (base.rows if base else 0)).alias("rows"))
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/bases/{version}")


def run_batches(source: DataFrame, checkpoint: str, ledger: Ledger, interval: str | None = None):
    """Feed a stream to a ledger. Batches are limited by the source's size options (maxFilesPerTrigger, maxBytesPerTrigger) and
    begin every interval at the latest; without one the stream ends when all there is now is counted."""
    writer = source.writeStream.foreachBatch(ledger.add).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()
