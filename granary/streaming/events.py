"""The event stream: parsing, event-time windows, and sinks that write each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.sources.versioned import VersionedTable

EVENT = "event_id string, event_type string, customer_id int, product_id int, store_id int, amount double, event_time string"
ENVELOPE = "partition int, offset long, value string"
DELAY, WINDOW = "10 minutes", "5 minutes"


def consumer_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}


def producer_options(servers: str, topic: str) -> dict[str, str]:
    """All replicas have a row before it counts as sent."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic from its beginning; needs Kafka's connector among the session's packages."""
    return spark.readStream.format("kafka").options(**consumer_options(servers, topic)).load()


def keyed(envelopes: DataFrame) -> DataFrame:
    """Events as rows of a topic: the customer is the key, so one customer's events stay in one partition, in order."""
    return envelopes.select(F.get_json_object("value", "$.customer_id").alias("key"), "value")


def produce(envelopes: DataFrame, servers: str, topic: str) -> None:
    """Sends events to a topic; needs Kafka's connector."""
    keyed(envelopes).write.format("kafka").options(**producer_options(servers, topic)).save()


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of JSON lines with partition, offset and value, one or more files a batch: a topic without a broker."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(path)


def parsed(envelopes: DataFrame) -> DataFrame:
    """partition, offset and the event's fields; a malformed value has null fields, event_time is a timestamp."""
    e = envelopes.select("partition", "offset", F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("partition", "offset", "e.*")
    return e.withColumn("event_time", F.try_to_timestamp("event_time"))


def windows(events: DataFrame, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """Per tumbling window and type: n_events, amount (decimal sum, rounded; null without amounts) and, approximately, customers."""
    return (
        events.withWatermark("event_time", delay).groupBy(F.window("event_time", window).alias("w"), "event_type")
        .agg(
            F.count("*").alias("n_events"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"),
            F.approx_count_distinct("customer_id").alias("customers")
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events", "amount", "customers")
    )


def _triggered(writer, every: str | None):
    """Batches at an interval, or, without one, what is there now."""
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_table(stream: DataFrame, table: VersionedTable, checkpoint: str, name: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Each batch becomes a version of the table, once: a batch that is run again after a failure is known by its number."""

    def sink(batch: DataFrame, number: int) -> None:
        table.append(batch, once=f"{name}:{number}")

    return _triggered(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name).foreachBatch(sink), every)


def to_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _triggered(stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint), every)


def to_console(stream: DataFrame, every: str | None = "20 seconds", rows: int = 20) -> StreamingQuery:
    """Changed windows on the driver's standard output."""
    return _triggered(stream.writeStream.format("console").outputMode("update").option("truncate", False).option("numRows", rows), every)


def run_all(queries: list[StreamingQuery], seconds: float | None = None) -> None:
    """Waits for queries that run side by side, each with a checkpoint of its own; after `seconds` they are stopped.  One that failed raises its error."""
    import time

    end = None if seconds is None else time.monotonic() + seconds
    for q in queries:
        q.awaitTermination(None if end is None else max(end - time.monotonic(), 0.001))
    for q in queries:
        q.stop()
        if (error := q.exception()) is not None:
            raise error


def audit(events: DataFrame) -> DataFrame:
    """Per partition of the topic: events, least and largest offset."""
    return events.groupBy("partition").agg(F.count("*").alias("n_events"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"))


def made_events(spark: SparkSession, n: int, start: str = "2024-01-01 00:00:00", per_second: int = 40, parts: int = 3) -> DataFrame:
    """n deterministic events in the envelope: types 3 : 2 : 1, amounts for orders only, one in twenty 1 to 15 minutes late."""
    k = F.col("id")
    mix = lambda salt, m: F.pmod(F.xxhash64(k, F.lit(salt)), F.lit(m))
    kind = F.element_at(F.array(*map(F.lit, ["page_view"] * 3 + ["add_to_cart"] * 2 + ["order_placed"])), (mix(1, 6) + 1).cast("int"))
    late = F.when(mix(2, 20) == 0, (mix(3, 15) + 1) * 60).otherwise(0)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.floor(k / per_second) - late)
    body = F.to_json(
        F.struct(
            F.concat(F.lit("e"), F.lower(F.hex(k))).alias("event_id"), kind.alias("event_type"), (mix(4, 2000) + 1).cast("int").alias("customer_id"),
            (mix(5, 200) + 1).cast("int").alias("product_id"), (mix(6, 20) + 1).cast("int").alias("store_id"),
            F.when(kind == "order_placed", F.round((mix(7, 1980000) + 20000) / 100, 2)).alias("amount"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time")
        )
    )
    return spark.range(n).select(F.pmod(k, F.lit(parts)).cast("int").alias("partition"), F.floor(k / parts).alias("offset"), body.alias("value"))
