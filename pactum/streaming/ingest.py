"""Structured Streaming: windowed event counts, and licence files that land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactum.plans.stage import dropped, stage_folder, staged
from pactum.sources.store import GraphStore
from pactum.sources.turtle import parsed_files, split_parsed


def windows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly counts by type with a watermark; the same code serves a stream and a table."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))


def hourly(events: DataFrame) -> DataFrame:
    """hour (hours since the epoch), event_type, n."""
    return windows(events).select((F.unix_timestamp(F.col("w.start")) / 3600).cast("long").alias("hour"), "event_type", "n")


def ingest_licences(spark: SparkSession, landing: str, table: str, checkpoint: str, graph: str, bad: str | None = None) -> StreamingQuery:
    """Adds the triples of Turtle files as they land to a GraphStore's table; ends when all that is there has been read.

    Files that can't be parsed are listed, with their error, in the table `bad` (by default beside the other): a folder for each
    batch, so a batch that is done again replaces its list. Triples that are there already are not added again.
    """
    store, bad = GraphStore(spark, table), bad or f"{table.rstrip('/')}-bad"

    def add(batch: DataFrame, number: int) -> None:
        path = stage_folder(spark)
        good, wrong = split_parsed(staged(parsed_files(batch), path))
        store.append(good)
        wrong.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        dropped(spark, path)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ttl").load(landing)
    named = files.select("path", "content", F.lit(graph).alias("graph"))
    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
