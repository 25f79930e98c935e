"""Recruitment over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import kmers
from ..operators.recruitment import reference_index


def streamed_counts(reads: DataFrame, loci: DataFrame, k: int) -> DataFrame:
    """J1 and A1 over a stream of reads (read_id, seq): k-mer hits by locus, against an index that does not change."""
    index = reference_index(loci, k).select("kmer", "locus")
    return kmers(reads.select("read_id", "seq"), k).join(index, "kmer").groupBy("locus").agg(F.count("*").alias("hits"))


def run_available(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now, writes the table of its results to a path, and gives it."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def windowed_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Counts and sums by type in five-minute windows of event time, ten minutes of lateness: an addition to the batch operators."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
