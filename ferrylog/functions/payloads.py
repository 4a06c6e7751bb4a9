"""JSON payload text: safe parsing, encoding, topic names and type detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrylog.functions.datetimes import is_iso_datetime

# fixed values: field type names, the largest 32-bit integer, the lower-cased UUID shape
STRING, INTEGER, BIGINT, FLOAT, BOOLEAN = "string", "integer", "bigint", "float", "boolean"
DATETIME_ISO, DATETIME_UNIX, UUID, JSON = "datetime_iso", "datetime_unix", "uuid", "json"
LARGEST_INT = 2147483647
LOWER_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMPTY_OBJECT = "{}"


def json_value(text: Column) -> Column:
    """The text as a parsed value; NULL unless all of it is one JSON value.

    The parser stops after the first value and forgives what follows, so the text is also read
    as the one element of an array, after which only ``]`` or ``,`` could go unnoticed, and as the
    one field of an object, after which only ``}`` or ``,`` could; a ``,`` would show in the counts.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    single = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1
    return F.when(alone & single, F.try_parse_json(text))


def is_json(text: Column) -> Column:
    """Whether all of a text is one JSON value, as :func:`json_value` takes it, in two passes over it; never NULL.

    What only ends an array early is wrong in an object and the other way round, so no third pass has to count the fields.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def json_kind(text: Column) -> Column:
    """Spark's type name of a JSON value (OBJECT..., ARRAY..., BIGINT, ...); NULL where it does not parse."""
    return F.schema_of_variant(json_value(text))


def object_or_empty(text: Column) -> Column:
    """The text itself when it holds a JSON object, else ``{}``."""
    return F.when(json_kind(text).startswith("OBJECT"), text).otherwise(F.lit(EMPTY_OBJECT))


def encode_payload(*columns: Column) -> Column:
    """Columns as one JSON object; absent values are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def payload_text(data: Column, field: str) -> Column:
    return F.get_json_object(data, f"$.{field}")


def payload_long(data: Column, field: str) -> Column:
    """A counter in a payload; absent or not a number counts as 0."""
    return F.coalesce(payload_text(data, field).try_cast("long"), F.lit(0).cast("long"))


def payload_fields(data: Column) -> Column:
    """Top-level fields of a JSON object as name -> JSON text of the value; NULL when not an object."""
    return F.from_json(F.when(json_kind(data).startswith("OBJECT"), data), "map<string,string>")


def topic_name(event_type: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}."), F.replace(event_type, F.lit("."), F.lit("_")))


def is_uuid_text(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(LOWER_UUID), F.lit(False))


def text_type(text: Column) -> Column:
    """Field type of a string value; NULL counts as a string."""
    return F.when(is_iso_datetime(text), DATETIME_ISO).when(is_uuid_text(text), UUID).otherwise(STRING)


def json_value_type(text: Column) -> Column:
    """Field type of a value given as JSON text (``"abc"``, ``12``, ``true``, ``{...}``)."""
    value = json_value(text)
    kind = F.schema_of_variant(value)
    body = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    whole = F.trim(text).rlike(r"^-?\d+$")
    return (
        F.when(kind.isNull() | (kind == "VOID"), STRING)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), JSON)
        .when(kind == "STRING", text_type(body))
        .when(whole & (number > LARGEST_INT), BIGINT)
        .when(whole, INTEGER)
        .otherwise(FLOAT)
    )
