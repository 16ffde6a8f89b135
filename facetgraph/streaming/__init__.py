"""A changeset feed: files of changesets become merges into a change log, each origin's revision once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import closure
from ..sources.tables import stored

CHANGE = "origin string, revision long, baserevision long, op string, subject string, predicate string, object string, objecttype string"


class Feed:
    """``folder``/log holds applied changes, ``folder``/pending those whose base revision isn't there yet; a pending
    changeset is tried again with every batch. Applying one twice changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(CHANGE + ", batch long").parquet(f"{self.folder}/{name}")
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], CHANGE + ", batch long")

    def log(self) -> DataFrame:
        return self._read("log").drop("batch").dropDuplicates()

    def pending(self) -> DataFrame:
        """Changes seen and not applied."""
        return self._read("seen").drop("batch").dropDuplicates().join(self.log().select("origin", "revision").distinct(), ["origin", "revision"], "left_anti")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Applies the batch's changesets, and those pending, that a chain of revisions leads to from what is applied."""
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{self.folder}/seen")
        name = lambda revision: F.concat_ws("@", F.col(revision).cast("string"), "origin")
        pending = stored(self.pending())
        edges = pending.select(name("baserevision").alias("src"), name("revision").alias("dst"), F.col("baserevision").alias("base")).distinct()
        done = self.log().select(name("revision").alias("start"))
        seeds = edges.where("base = 0").select(F.col("src").alias("start")).union(edges.select(F.col("src").alias("start")).join(done, "start", "left_semi"))
        found = closure(edges, seeds.distinct(), exclude_initial=True).select(F.col("node").alias("name")).distinct()
        ready = pending.withColumn("name", name("revision")).join(found, "name", "left_semi").drop("name")
        ready.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{self.folder}/log")

    def start(self, source: str, checkpoint: str):
        """A streaming query over JSON changeset files in source."""
        stream = self.spark.readStream.schema(CHANGE).json(source)
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
