"""First arrivals of a feed in which ids repeat and rows come late.

A stream keeps the ids it has seen in the state store until the watermark, the latest event
time less ``late``, has passed them by another ``late``. The first row of an id goes on; a repeat is held back. A
row that comes behind the watermark cannot be told from a repeat any more, so the stream leaves it
out: ``outcomes`` finds these rows by what was landed, and calls a row a repeat if its id went on, else
late. Nothing is lost, and late rows can be taken in by a refresh that accepts them.

State and watermark are in the checkpoint, so a restart goes on where the last run ended. State is bounded by the
ids of the time that the watermark covers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.streaming.windows import deduplicated

KEPT, REPEAT, LATE = "KEPT", "REPEAT", "LATE"


class Arrivals:
    """Files landed under ``in`` go through the stream to ``kept``; each ``run`` is a restart."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, ts: str, late: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.ts, self.late = key, ts, late

    def land(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/in")

    def run(self, max_files: int | None = None) -> None:
        """Take in what has landed, at most ``max_files`` files a batch (default: all in one batch)."""
        stream = self.spark.readStream.schema(self.schema)
        stream = (stream.option("maxFilesPerTrigger", max_files) if max_files else stream).parquet(f"{self.root}/in")

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/kept/batch_id={batch_id}")  # a repeated batch replaces itself

        query = (
            deduplicated(stream, self.key, self.ts, self.late)
            .writeStream.option("checkpointLocation", f"{self.root}/_checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()

    def kept(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.root}/kept/*")
        except AnalysisException:  # nothing taken in yet
            return self.spark.createDataFrame([], self.schema)

    def outcomes(self, arrival: list[str]) -> DataFrame:
        """Landed rows with ``outcome``; the columns ``arrival`` tell the rows of one id apart."""
        kept = self.kept()
        landed = self.spark.read.schema(self.schema).parquet(f"{self.root}/in")
        here = kept.select(self.key, *arrival).distinct().withColumn("_kept", F.lit(True))
        seen = kept.select(self.key).distinct().withColumn("_seen", F.lit(True))
        marked = landed.join(here, [self.key, *arrival], "left").join(seen, self.key, "left")
        outcome = F.when(F.col("_kept"), F.lit(KEPT)).when(F.col("_seen"), F.lit(REPEAT)).otherwise(F.lit(LATE))
        return marked.withColumn("outcome", outcome).drop("_kept", "_seen")
