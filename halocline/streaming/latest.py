"""Latest state per entity with a merge of identities, kept as deltas of micro-batches over a compacted base.

A state row has a struct per group of columns: the newest values by the group's own stamps. Taking the newest is commutative and
idempotent, so batches may be replayed, come out of order or be merged twice. A batch writes as many rows as it has entities;
the whole table is rewritten by a compaction only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.streaming.vessels import MESSAGE


def messages(frames: DataFrame) -> DataFrame:
    """mmsi, ts, lon, lat, sog (of position reports on the globe), name (of static reports, not blank) of JSON frames in column
    value, decoded once. What a message does not say is null; other kinds of messages go."""
    m = frames.select(F.from_json("value", MESSAGE).alias("m")).select("m.*")
    is_at, is_who = F.col("MessageType") == "PositionReport", F.col("MessageType") == "ShipStaticData"
    valid = is_at & F.col("Message.Longitude").between(-180, 180) & F.col("Message.Latitude").between(-90, 90)
    at = [F.when(valid, F.col(f"Message.{c}")).alias(n) for c, n in (("Longitude", "lon"), ("Latitude", "lat"), ("Sog", "sog"))]
    name = F.when(is_who, F.nullif(F.trim("MetaData.ShipName"), F.lit("")))
    return m.where(is_at | is_who).select(F.col("MetaData.MMSI").alias("mmsi"), F.try_to_timestamp(F.col("MetaData.time_utc")).alias("ts"), *at, name.alias("name"))


class Latest:
    """The table of latest states in a folder. groups: for each group its stamps (compared in order) and its values; a row speaks
    for a group if its first stamp and one of the values are not null. Ties of stamps go to the greater values."""

    def __init__(self, spark: SparkSession, folder: str, key: str, groups: dict[str, tuple[list[str], list[str]]]):
        self.spark, self.folder, self.key, self.groups = spark, folder, key, groups

    def _says(self, stamps: list[str], values: list[str]) -> Column:
        some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
        return F.when(F.col(stamps[0]).isNotNull() & some, F.struct(*stamps, *values))

    def states(self, rows: DataFrame) -> DataFrame:
        """The state that rows alone give. Rows without a key go."""
        return rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[F.max(self._says(*g)).alias(name) for name, g in self.groups.items()])

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.key).agg(*[F.max(name).alias(name) for name in self.groups])

    def add(self, batch: DataFrame, number: int) -> None:
        """Write a micro-batch's delta; the same batch again writes the same files."""
        self.states(batch).write.mode("overwrite").parquet(f"{self.folder}/delta/batch={number}")

    def compact(self, upto: int, schema: DataFrame) -> None:
        """Merge what there is up to a batch into a new base. The marker that readers follow is written last; a batch that is
        replayed later is in the base already and is not read."""
        self.read(schema, upto).write.mode("overwrite").parquet(f"{self.folder}/base-{upto}")
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").json(f"{self.folder}/bases")

    def read(self, schema: DataFrame, upto: int | None = None) -> DataFrame:
        """The states as of now (or as of a batch): key and a struct per group. schema is a frame with the columns of the batches."""
        shape = self.states(schema).schema
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/bases")
        base = None
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            base = self.spark.read.schema("upto long").json(f"{self.folder}/bases").agg(F.max("upto")).first()[0]
        deltas = self.spark.read.schema(shape.add("batch", "long")).parquet(f"{self.folder}/delta")
        if base is not None:
            deltas = deltas.where(F.col("batch") > base)
        if upto is not None:
            deltas = deltas.where(F.col("batch") <= upto)
        deltas = deltas.drop("batch")
        if base is None:
            return self.merged(deltas)
        return self.merged(deltas.unionByName(self.spark.read.parquet(f"{self.folder}/base-{base}")))

    def run(self, source: DataFrame, checkpoint: str, every: int = 16) -> None:
        """Take in a stream over what there is now, compacting after every so many batches; several runs go on where the last
        one ended."""
        none = self.spark.createDataFrame([], source.schema)

        def each(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            if number % every == every - 1:
                self.compact(number, none)

        source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
