"""Event envelopes: building typed events, audit entries and notifications from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.identifiers import dashed
from ferrylog.functions.payloads import encode_payload, json_kind, payload_text

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("aggregate_id", T.StringType()),
        T.StructField("aggregate_type", T.StringType()),
        T.StructField("event_version", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("causation_id", T.StringType()),
        T.StructField("event_metadata", T.StringType()),
        T.StructField("event_data", T.StringType()),
    ]
)
EVENT_ORDER = ("timestamp", "event_id")


@dataclass(frozen=True)
class EventSpec:
    aggregate_type: str
    fields: tuple[str, ...]
    moment: str


# names of event types, an aggregate type, payload fields and the topics' prefix; see :func:`with_our_names` for events stored under others
RUN_STARTED, RUN_COMPLETED, RUN_FAILED = "run.started", "run.completed", "run.failed"
USER_MOVED, ADMIN_MOVED = "user.moved", "admin.moved"
RUN, RUN_ID, MOVED_AT = "run", "run_id", "moved_at"
TOPIC_PREFIX = "run-events"

# fixed values: the event types, their aggregate type, payload fields and payload time field
EVENT_SPECS: dict[str, EventSpec] = {
    RUN_STARTED: EventSpec(RUN, ("source_config", "target_config"), "started_at"),
    RUN_COMPLETED: EventSpec(RUN, ("statistics", "duration_seconds"), "completed_at"),
    RUN_FAILED: EventSpec(RUN, ("error_message", "error_details"), "failed_at"),
    "data.extracted": EventSpec("extraction", ("source_type", "record_count", "extraction_stats"), "extracted_at"),
    "data.transformed": EventSpec(
        "transformation", ("input_count", "output_count", "transformation_stats"), "transformed_at"
    ),
    "data.validated": EventSpec(
        "validation", ("total_records", "valid_records", "invalid_records", "validation_errors"), "validated_at"
    ),
    "data.imported": EventSpec("import", ("target_type", "imported_count", "import_stats"), "imported_at"),
    USER_MOVED: EventSpec("user", ("username", "source_data", "target_data"), MOVED_AT),
    ADMIN_MOVED: EventSpec("admin", ("username", "source_data", "target_data"), MOVED_AT),
    "rollback.initiated": EventSpec("rollback", (RUN_ID, "reason", "rollback_scope"), "initiated_at"),
    "rollback.completed": EventSpec("rollback", (RUN_ID, "rollback_stats", "success"), "completed_at"),
    "schema.compatibility.checked": EventSpec(
        "schema", ("source_schema", "target_schema", "compatibility_result"), "checked_at"
    ),
    "uuid.transformed": EventSpec(
        "uuid_transformation", ("source_format", "target_format", "transformation_count"), "transformed_at"
    ),
    "datetime.converted": EventSpec(
        "datetime_conversion", ("source_format", "target_format", "conversion_count"), "converted_at"
    ),
}


def stable_event_id(*parts: Column) -> Column:
    """A UUID-shaped id that depends only on its parts, so rebuilding an event gives the same id."""
    return dashed(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def make_events(
    df: DataFrame,
    event_type: str,
    aggregate_id: Column,
    timestamp: Column,
    payload: dict[str, Column],
    event_id: Column | None = None,
    event_version: Column | None = None,
    correlation_id: Column | None = None,
    causation_id: Column | None = None,
    metadata: Column | None = None,
) -> DataFrame:
    """Rows to events of one type; the payload must name the type's fields, the time field is added."""
    spec = EVENT_SPECS[event_type]
    if set(payload) != set(spec.fields):
        raise ValueError(f"{event_type} carries {spec.fields}, got {tuple(payload)}")
    body = encode_payload(*[payload[f].alias(f) for f in spec.fields], timestamp.alias(spec.moment))
    none = F.lit(None).cast("string")
    own_id = stable_event_id(F.lit(event_type), aggregate_id, F.unix_micros(timestamp))
    columns = {
        "event_id": event_id if event_id is not None else own_id,
        "event_type": F.lit(event_type),
        "aggregate_id": aggregate_id,
        "aggregate_type": F.lit(spec.aggregate_type),
        "event_version": event_version if event_version is not None else F.lit(1),
        "timestamp": timestamp,
        "correlation_id": correlation_id if correlation_id is not None else none,
        "causation_id": causation_id if causation_id is not None else none,
        "event_metadata": metadata if metadata is not None else F.lit("{}"),
        "event_data": body,
    }
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def backfill_user_events(legacy: DataFrame, user_id: Column, username: Column, moved_at: Column) -> DataFrame:
    """Legacy rows as events of moved users, dated when the user was moved."""
    whole = F.struct(*legacy.columns)
    payload = {"username": username, "source_data": whole, "target_data": whole}
    return make_events(legacy, USER_MOVED, user_id, moved_at, payload)


def with_our_names(events: DataFrame, types: dict[str, str], aggregates: dict[str, str] | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """Events stored under other names, by theirs to ours: event types, aggregate types and top-level payload fields.

    Names that are not listed stay; a payload without any listed field, or that is no JSON object, stays as it is, and so does a field whose
    new name the payload has already.
    """

    def renamed(name: str, names: dict[str, str] | None) -> Column:
        if not names:
            return F.col(name)
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return F.coalesce(F.element_at(known, F.col(name)), F.col(name))

    out = events.withColumns({"event_type": renamed("event_type", types), "aggregate_type": renamed("aggregate_type", aggregates)})
    if not fields:
        return out
    body = F.when(json_kind(F.col("event_data")).startswith("OBJECT"), F.col("event_data"))
    values, known = F.from_json(body, "map<string,variant>"), F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    has = lambda k: F.map_contains_key(values, k)
    changed = F.transform_keys(values, lambda k, _: F.when(~F.coalesce(has(F.element_at(known, k)), F.lit(False)), F.coalesce(F.element_at(known, k), k)).otherwise(k))
    some = F.exists(F.map_keys(values), lambda k: F.map_contains_key(known, k))
    return out.withColumn("event_data", F.when(F.coalesce(some, F.lit(False)), F.to_json(changed)).otherwise(F.col("event_data")))


def known_type(event_type: Column) -> Column:
    return event_type.isin(*EVENT_SPECS)


# fixed values: how large payload values are described, and how much text is kept
DICT_TEXT, LIST_TEXT, STRING_TEXT, KEPT_CHARS = "<dict with %d keys>", "<list with %d items>", "<string: %s...>", 100


def _value_summary(value: Column) -> Column:
    # a parsed value decides what to print: sizes for containers, a cut for long text
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    body = F.to_json(value)
    return (
        F.when(kind.startswith("OBJECT"), F.format_string(DICT_TEXT, F.size(F.json_object_keys(body))))
        .when(kind.startswith("ARRAY"), F.format_string(LIST_TEXT, F.json_array_length(body)))
        .when(
            (kind == "STRING") & (F.length(text) > KEPT_CHARS),
            F.format_string(STRING_TEXT, F.substring(text, 1, KEPT_CHARS)),
        )
        .otherwise(text)
    )


def audit_entries(events: DataFrame) -> DataFrame:
    """One audit row per event; large payload values are replaced by what they are."""
    body = F.when(json_kind(F.col("event_data")).startswith("OBJECT"), F.col("event_data"))
    values = F.from_json(body, "map<string,variant>")
    return events.select(
        "event_id",
        "event_type",
        "aggregate_id",
        "aggregate_type",
        "timestamp",
        "correlation_id",
        "causation_id",
        F.col("event_metadata").alias("metadata"),
        F.transform_values(values, lambda _, v: _value_summary(v)).alias("data_summary"),
    )


# titles, texts and priorities of notifications, and where their details come from
TITLES = {
    RUN_COMPLETED: "Run Completed",
    RUN_FAILED: "Run Failed",
    "rollback.initiated": "Rollback Initiated",
    "rollback.completed": "Rollback Completed",
}
COMPLETED_TEXT = "Run %s completed successfully in %.2f seconds"
FAILED_TEXT = "Run %s failed: %s"
INITIATED_TEXT = "Rollback %s initiated for run %s: %s"
UNDONE_TEXT = "Rollback %s for run %s completed %s"
WELL, BADLY, NO_REASON_KNOWN = "successfully", "with errors", "Unknown error"
NORMAL, MEDIUM, HIGH = "normal", "medium", "high"
DETAILS = {
    RUN_COMPLETED: "statistics",
    RUN_FAILED: "error_details",
    "rollback.initiated": "rollback_scope",
    "rollback.completed": "rollback_stats",
}


def notifications(events: DataFrame) -> DataFrame:
    """Title, message, details and priority for finished, failed and rolled-back runs."""
    data, kind, subject = F.col("event_data"), F.col("event_type"), F.col("aggregate_id")
    target = F.coalesce(payload_text(data, RUN_ID), F.lit(""))
    reason = F.coalesce(payload_text(data, "reason"), F.lit(""))
    seconds = F.coalesce(payload_text(data, "duration_seconds").try_cast("double"), F.lit(0.0))
    problem = F.coalesce(payload_text(data, "error_message"), F.lit(NO_REASON_KNOWN))
    success = F.coalesce(payload_text(data, "success").try_cast("boolean"), F.lit(False))
    per_type = {
        RUN_COMPLETED: (F.format_string(COMPLETED_TEXT, subject, seconds), F.lit(NORMAL)),
        RUN_FAILED: (F.format_string(FAILED_TEXT, subject, problem), F.lit(HIGH)),
        "rollback.initiated": (F.format_string(INITIATED_TEXT, subject, target, reason), F.lit(HIGH)),
        "rollback.completed": (
            F.format_string(UNDONE_TEXT, subject, target, F.when(success, WELL).otherwise(BADLY)),
            F.when(success, MEDIUM).otherwise(HIGH),
        ),
    }
    notice = F.coalesce(
        *[
            F.when(
                kind == t,
                F.struct(
                    F.lit(TITLES[t]).alias("title"),
                    message.alias("message"),
                    F.coalesce(payload_text(data, DETAILS[t]), F.lit("{}")).alias("details"),
                    priority.alias("priority"),
                ),
            )
            for t, (message, priority) in per_type.items()
        ]
    )
    chosen = events.filter(kind.isin(*TITLES))
    return chosen.select("event_id", "event_type", "aggregate_id", "timestamp", notice.alias("_n")).select(
        "event_id", "event_type", "aggregate_id", "timestamp", "_n.*"
    )
