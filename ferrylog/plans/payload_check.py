"""The fields of JSON payloads at every depth, as one mergeable aggregate, and whether they fit what is expected.

Types form a lattice: two whole numbers are a whole number, with a decimal they are a decimal, anything and nothing is itself, objects are merged
field by field and lists element by element, and what does not fit together is a conflict. Spark merges these types
before and after the shuffle, so payloads cost one pass and no row per value, however skewed their groups are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of a path. A conflict holds values that have no common type; nothing was seen but nulls where a path is void.
OBJECT, LIST, CONFLICT, VOID = "object", "list", "conflict", "void"
_NAMES = {"OBJECT": OBJECT, "ARRAY": LIST, "VARIANT": CONFLICT, "VOID": VOID}
_TOKEN = re.compile(r"`(?:[^`]|``)*`|[^\s<>,:()]+|[<>,:]|\([^)]*\)")


def payload_schemas(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key ``schema`` (as text), ``payloads`` with a text and ``broken`` ones, whose text is no JSON and counts for nothing else."""
    parsed = F.try_parse_json(F.col(text))
    return df.groupBy(*keys).agg(
        F.schema_of_variant_agg(parsed).alias("schema"), F.count(text).alias("payloads"), F.count_if(F.col(text).isNotNull() & parsed.isNull()).alias("broken")
    )


def _paths(schema: str) -> list[tuple[str, str]]:
    """(path, type) of every field in a schema text, outer ones first; ``[*]`` stands for all elements of a list."""
    tokens, found = _TOKEN.findall(schema), []
    waiting, place, path = ["$"], 0, ""
    opened: list[tuple[str, str]] = []  # the objects and lists around, by path and kind
    while place < len(tokens):
        token = tokens[place]
        place += 1
        if token == ">":
            opened.pop()
        elif token == "," or token.startswith("("):
            continue
        elif waiting:
            path = waiting.pop()
            found.append((path, _NAMES.get(token, token.lower())))
            if token in ("OBJECT", "ARRAY"):
                place += 1  # its "<"
                opened.append((path, token))
                if token == "ARRAY":
                    waiting.append(f"{path}[*]")
        else:  # a field's name and the ":" after it
            name = token[1:-1].replace("``", "`") if token.startswith("`") else token
            waiting.append(f"{opened[-1][0]}.{name}" if re.fullmatch(r"\w+", name) else f'{opened[-1][0]}."{name}"')
            place += 1
    return found


def payload_paths(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """``path, type`` of every field of the payloads, per key; conflicts included. Keys without any JSON have no rows."""
    schemas = payload_schemas(df, text, keys)
    fields = {f.name: f.dataType.simpleString() for f in schemas.schema}
    out = ", ".join([*[f"`{k}` {fields[k]}" for k in keys], "path string, type string"])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # a row per key
            rows = [(*row[:-1], path, kind) for row in batch.itertuples(index=False, name=None) for path, kind in _paths(row[-1])]
            yield pd.DataFrame(rows, columns=[*keys, "path", "type"])

    return schemas.filter("schema <> 'VOID'").select(*keys, "schema").mapInPandas(told, out)


def compare_paths(paths: DataFrame, expected: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """``path, finding, source_type, target_type`` per key: compatible, incompatible, conflict, missing or extra.

    A field seen with nulls only fits any type, and a whole number fits where a decimal is expected.
    """
    groups = paths.select(*keys).distinct() if keys else paths.sparkSession.range(1).select()
    asked = groups.select(*keys, F.inline(_listed(expected)))
    on = [*keys, "path"]
    pair = paths.withColumnRenamed("type", "source_type").join(asked, on, "full")
    source, target = F.col("source_type"), F.col("target_type")
    fits = (source == target) | (source == VOID) | ((source == "bigint") & target.isin("decimal", "double")) | ((source == "decimal") & (target == "double"))
    finding = F.when(source.isNull(), "missing").when(target.isNull(), "extra").when(source == CONFLICT, "conflict").when(fits, "compatible").otherwise("incompatible")
    return pair.select(*keys, "path", finding.alias("finding"), "source_type", "target_type")


def _listed(expected: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("target_type")) for p, t in expected.items()])
