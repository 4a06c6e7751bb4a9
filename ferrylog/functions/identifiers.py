"""UUID text: detection, conversion between dashed and bare hex, and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: text shapes (bare; bare or dashed), format names, message, what counts as space
HEX_32 = r"^[0-9a-fA-F]{32}\z"
EITHER = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\z"
FORMAT_HEX, FORMAT_DASHED, FORMAT_COMPACT, FORMAT_INVALID = "hex_32", "uuid_standard", "uuid_compact", "invalid"
INVALID_MESSAGE = "Invalid UUID format detected"
SPACE = " \t\n\r\f\x0b"


def dashed(hex_text: Column) -> Column:
    """Put the dashes of a UUID into 32 characters, keeping case."""
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex_text, start, length) for start, length in parts])


def key_to_uuid(key: Column) -> Column:
    """A 32-digit hex key as a dashed UUID, anything else NULL."""
    return F.when(key.rlike(HEX_32), dashed(key))


def _body(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _matches(body: Column) -> Column:
    return F.coalesce(body.rlike(EITHER), F.lit(False))


def uuid_format(text: Column) -> Column:
    """``uuid_standard``, ``hex_32`` or ``invalid``; white space around the text does not count."""
    body = _body(text)
    named = F.when(F.length(body) == 32, FORMAT_HEX).otherwise(FORMAT_DASHED)
    return F.when(_matches(body), named).otherwise(FORMAT_INVALID)


def convert_uuid(text: Column, target: str = FORMAT_DASHED) -> Column:
    """The UUID in the target format; NULL where the text is no UUID."""
    body = _body(text)
    if target == FORMAT_DASHED:
        made = F.when(F.length(body) == 32, dashed(body)).otherwise(body)
    elif target in (FORMAT_HEX, FORMAT_COMPACT):
        made = F.replace(body, F.lit("-"), F.lit(""))
    else:
        raise ValueError(f"unknown UUID format {target}")
    return F.when(_matches(body), made)


def is_valid_uuid(text: Column, expected: str = FORMAT_DASHED) -> Column:
    """Whether a text parses as a UUID of the expected format; a dashed one may leave out dashes."""
    bare = F.replace(text, F.lit("-"), F.lit("")) if expected == FORMAT_DASHED else text
    return F.coalesce(bare.rlike(HEX_32), F.lit(False))


def transform_uuid(text: Column, target: str = FORMAT_DASHED) -> Column:
    """Struct of original, transformed, format, is_valid, error.

    What was recognised always converts to a valid UUID, so nothing is parsed a second time.
    """
    valid = _matches(_body(text))
    return F.struct(
        text.alias("original"),
        convert_uuid(text, target).alias("transformed"),
        uuid_format(text).alias("format"),
        valid.alias("is_valid"),
        F.when(~valid, INVALID_MESSAGE).alias("error"),
    )
