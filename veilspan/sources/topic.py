"""The topic between publishing and persisting: key and JSON value per envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.values import ColumnLike, col, text


def encode_envelope(envelope: ColumnLike) -> Column:
    """The message value; an empty signal and parent id are left out."""
    e = col(envelope)
    event = (e["event"].withField("signal", F.nullif(e["event"]["signal"], F.lit("")))
             .withField("parentSpanId", F.nullif(e["event"]["parentSpanId"], F.lit(""))))
    return F.to_json(e.withField("event", event))


def to_messages(envelopes: DataFrame) -> DataFrame:
    return envelopes.select(F.col("event_key").alias("key"),
                            encode_envelope("envelope").alias("value"))


def decode_messages(messages: DataFrame, on_malformed: str = "fail") -> DataFrame:
    """``tenant_id, event_key, envelope`` of each message.

    A message without key, tenant or valid JSON is never skipped: ``fail`` makes the job fail
    where it is read, ``flag`` keeps the row with ``malformed`` set and no content.
    """
    parsed = messages.select("key", F.octet_length("value").alias("value_bytes"),
                             F.from_json("value", schemas.ENVELOPE).alias("e"))
    bad = (F.col("e").isNull() | (text("e.eventKey") == "") | (text("e.tenantId") == ""))
    if on_malformed == "fail":
        checked = F.when(bad, F.raise_error(F.lit("sanitized topic envelope invalid"))
                         .cast(schemas.ENVELOPE)).otherwise(F.col("e"))
        return (parsed.select(checked.alias("envelope"))
                .select(F.col("envelope.tenantId").alias("tenant_id"),
                        F.col("envelope.eventKey").alias("event_key"), "envelope"))
    return parsed.select(
        F.when(~bad, F.col("e.tenantId")).alias("tenant_id"),
        F.when(~bad, F.col("e.eventKey")).alias("event_key"),
        F.when(~bad, F.col("e")).alias("envelope"), bad.alias("malformed"),
        F.sha2("key", 256).alias("key_digest"), "value_bytes")


def quarantine(flagged: DataFrame) -> DataFrame:
    """Evidence of malformed messages: digest and size, never content."""
    return flagged.filter("malformed").select("key_digest", "value_bytes")


def write_topic(envelopes: DataFrame, path: str, **kafka_options: str) -> None:
    """Append messages.  With Kafka options they go to a Kafka topic, which places them by key
    itself; otherwise to a folder, where no placement, and so no shuffle, is needed."""
    messages = to_messages(envelopes)
    if kafka_options:
        (messages.write.format("kafka").options(**{"kafka.acks": "all", **kafka_options})
         .option("topic", path).save())
    else:
        messages.write.mode("append").parquet(path)


def read_topic(spark: SparkSession, path: str, stream: bool = False,
               max_files: int | None = None, **kafka_options: str) -> DataFrame:
    """Raw messages of a topic, to be decoded with :func:`decode_messages`."""
    if kafka_options:
        reader = (spark.readStream if stream else spark.read).format("kafka")
        return (reader.options(**kafka_options).option("subscribe", path).load()
                .select(F.col("key").cast("string"), F.col("value").cast("string")))
    if not stream:
        return spark.read.schema(schemas.TOPIC).parquet(path)
    reader = spark.readStream.schema(schemas.TOPIC)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
