"""Events as bus messages: topic, key, value; batch and streaming, Kafka or files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylog.functions.payloads import is_json, topic_name
from ferrylog.functions.schemas import TEXT, struct
from ferrylog.plans.event_model import known_type

MESSAGE_SCHEMA = struct(
    topic=TEXT, key=TEXT, value=TEXT,
)
ENVELOPE_SCHEMA = (
    "event_id string, event_type string, aggregate_id string, aggregate_type string, event_version int, "
    "timestamp timestamp, correlation_id string, causation_id string, metadata string, data string"
)
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def encode_messages(events: DataFrame, prefix: str, topic: str | None = None) -> DataFrame:
    """Events as messages: topic from the type (or a fixed one), key = event id, value = JSON."""
    value = F.to_json(
        F.struct(
            "event_id",
            "event_type",
            "aggregate_id",
            "aggregate_type",
            "event_version",
            "timestamp",
            "correlation_id",
            "causation_id",
            F.try_parse_json("event_metadata").alias("metadata"),
            F.try_parse_json("event_data").alias("data"),
        ),
        {"timestampFormat": MICROS, "ignoreNullFields": "false"},
    )
    where = F.lit(topic) if topic else topic_name(F.col("event_type"), prefix)
    return events.select(where.alias("topic"), F.col("event_id").alias("key"), value.alias("value"))


def decode_messages(messages: DataFrame) -> DataFrame:
    """Messages as events; ``error`` says why a message is no event."""
    body = F.col("value").cast("string")
    parsed = F.from_json(body, ENVELOPE_SCHEMA, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "mode": "PERMISSIVE"})
    # generated, so that the text is parsed once and not again for every field taken from it
    once = F.struct(parsed.alias("_e"), is_json(body).alias("_json"), body.alias("raw"))
    rows = messages.select("*", F.inline(F.array(once)))
    error = (
        F.when(~F.col("_json"), "not JSON")
        .when(F.col("_e.event_id").isNull(), "no event id")
        .when(~F.coalesce(known_type(F.col("_e.event_type")), F.lit(False)), "unknown event type")
        .when(F.col("_e.timestamp").isNull(), "no timestamp")
    )
    names = ["event_id", "event_type", "aggregate_id", "aggregate_type", "event_version", "timestamp", "correlation_id", "causation_id"]
    return rows.select(
        *[F.col(f"_e.{n}").alias(n) for n in names],
        F.coalesce(F.col("_e.metadata"), F.lit("{}")).alias("event_metadata"),
        F.coalesce(F.col("_e.data"), F.lit("{}")).alias("event_data"),
        "raw",
        error.alias("error"),
    )


def split_dead_letters(judged: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(good events, dead letters); dead letters carry the error and the time in their metadata."""
    good = judged.filter(F.col("error").isNull()).drop("error", "raw")
    failed_at = F.date_format(as_of, MICROS)
    known = F.coalesce(F.from_json("event_metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    added = F.create_map(F.lit("error"), F.col("error"), F.lit("failed_at"), failed_at)
    kept = F.map_filter(known, lambda k, _: ~k.isin("error", "failed_at"))
    dead = judged.filter(F.col("error").isNotNull()).withColumn("event_metadata", F.to_json(F.map_concat(kept, added)))
    return good, dead


def dead_letter_messages(dead: DataFrame, topic: str = "dead-letter") -> DataFrame:
    """Dead letters as messages; what could not be decoded travels as its raw text."""
    body = F.to_json(F.struct("event_id", "event_type", "aggregate_id", F.col("event_metadata").alias("metadata"), F.col("event_data").alias("data"), "raw"))
    return dead.select(F.lit(topic).alias("topic"), F.col("event_id").alias("key"), body.alias("value"))


def publish_files(messages: DataFrame, path: str) -> None:
    """Messages to files, one folder per topic: the sink where there is no broker.

    Rebalancing gathers a topic's rows into few files and splits a topic that is hot.
    """
    messages.hint("rebalance", F.col("topic")).write.mode("append").partitionBy("topic").json(path)


def publish_kafka(messages: DataFrame, servers: str) -> None:
    """Messages to Kafka (needs the connector on the class path; not exercised here)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of messages landed as files."""
    return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_kafka(spark: SparkSession, servers: str, event_types: Iterable[str], prefix: str) -> DataFrame:
    """A stream of messages from the topics of the given types (not exercised here)."""
    topics = ",".join(f"{prefix}.{t.replace('.', '_')}" for t in event_types)
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return reader.load().select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def subscribe(messages: DataFrame, event_types: Iterable[str]) -> DataFrame:
    """Decoded events of the wanted types; undecodable messages stay in, marked by ``error``."""
    decoded = decode_messages(messages)
    return decoded.filter(F.col("error").isNotNull() | F.col("event_type").isin(*event_types))
