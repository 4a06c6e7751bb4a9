"""Schemas spelled as keyword arguments, usable before any session exists."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT, BOOL, MOMENT = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampType()
DOUBLE = T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
