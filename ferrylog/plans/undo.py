"""Transaction logs: status, checkpoint marks, undo plans and their effect on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.datetimes import iso_to_timestamp

# fixed values: how each logged operation is undone, and the limits of a transaction
INVERSES = {
    "insert_user": "delete",
    "update_user": "restore",
    "delete_user": "reinsert",
    "insert_admin": "delete",
    "update_admin": "restore",
    "delete_admin": "reinsert",
    "insert_proxy": "delete",
    "update_proxy": "restore",
    "delete_proxy": "reinsert",
}
CHECKPOINT_INTERVAL = 100
MAX_OPERATIONS = 10_000


def transaction_status(log: DataFrame) -> DataFrame:
    return log.select(
        "transaction_id",
        "status",
        F.coalesce(F.size("operations"), F.lit(0)).alias("operation_count"),
        F.coalesce(F.size("checkpoints"), F.lit(0)).alias("checkpoint_count"),
        "start_time",
        "metadata",
    )


def logged_operations(log: DataFrame) -> DataFrame:
    """One row per logged operation with its position, from 0."""
    return log.select("transaction_id", F.posexplode("operations").alias("pos", "_o")).select("transaction_id", "pos", "_o.*")


def checkpoint_marks(operations: DataFrame, interval: int = CHECKPOINT_INTERVAL, limit: int = MAX_OPERATIONS) -> DataFrame:
    """Flags for operations that set an automatic checkpoint and for those past the limit."""
    count = F.col("pos") + 1
    return operations.withColumns({"is_checkpoint": (count % interval == 0) & (count <= limit), "over_limit": count > limit})


def undo_plan(
    log: DataFrame,
    checkpoints: DataFrame | None = None,
    inverses: dict[str, str] | None = None,
    key: str = "username",
) -> DataFrame:
    """Operations to undo, newest first (``undo_order`` from 1), with the inverse action.

    ``checkpoints`` (transaction_id, checkpoint_id) limits each named transaction to what came
    after its checkpoint; transactions and checkpoints it does not name are left alone.
    ``inverses`` adds or replaces rules. An operation lacking the data it needs is not undoable.
    """
    if checkpoints is not None:
        chosen = log.join(checkpoints.withColumnRenamed("checkpoint_id", "_cp"), "transaction_id")
        match = F.filter("checkpoints", lambda c: c["checkpoint_id"] == F.col("_cp"))
        chosen = chosen.withColumn("_from", F.get(match, F.lit(0))["operation_count"]).filter(F.col("_from").isNotNull())
    else:
        chosen = log.withColumn("_from", F.lit(0).cast("long"))
    total = F.size("operations")
    operations = chosen.select("transaction_id", "_from", total.alias("_n"), F.posexplode("operations").alias("pos", "_o"))
    operations = operations.filter(F.col("pos") >= F.col("_from")).select("transaction_id", "pos", "_n", "_o.*")
    rules = {**INVERSES, **(inverses or {})}
    table = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    action = F.try_element_at(table, F.col("operation_type"))
    subject = F.get_json_object("operation_data", f"$.{key}")
    restored = F.get_json_object("rollback_data", f"$.{key}")
    has_data = F.coalesce(F.size(F.json_object_keys("rollback_data")) > 0, F.lit(False))
    possible = (
        F.when(action == "delete", F.coalesce(subject != "", F.lit(False)))
        .when(action == "restore", has_data & F.coalesce(restored != "", F.lit(False)))
        .when(action == "reinsert", has_data)
        .otherwise(F.lit(False))
    )
    return operations.select(
        "transaction_id",
        "pos",
        "operation_id",
        "operation_type",
        "target_table",
        "operation_data",
        "rollback_data",
        "timestamp",
        F.coalesce(action, F.lit("none")).alias("action"),
        possible.alias("undoable"),
        (F.col("_n") - F.col("pos")).cast("long").alias("undo_order"),
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    return iso_to_timestamp(text) if isinstance(kind, T.TimestampType) else text.try_cast(kind)


def apply_undo(
    table: DataFrame,
    plan: DataFrame,
    name: str,
    key: str = "username",
    order: Sequence[str] = ("timestamp", "transaction_id", "pos"),
) -> DataFrame:
    """The table as it was before the earliest undone operation of every key.

    A key whose earliest undone operation is an insert disappears. Otherwise each field takes
    the value logged by the earliest undone update or delete that mentions it, over the current
    row, or over nothing when the row was deleted in between.
    """
    fields = [f for f in table.schema.fields if f.name != key]
    text = F.when(F.col("action") == "delete", F.get_json_object("operation_data", f"$.{key}")).otherwise(
        F.get_json_object("rollback_data", f"$.{key}")
    )
    undone = plan.filter((F.col("target_table") == name) & F.col("undoable")).select(
        _typed(text, table.schema[key].dataType).alias(key),
        "action",
        F.struct(*order).alias("_at"),
        F.from_json("rollback_data", "map<string,string>").alias("_old"),
    )

    def earliest(field: str) -> Column:
        # wrapped in a struct so that a logged NULL differs from "not logged"
        mentioned = (F.col("action") != "delete") & F.map_contains_key("_old", field)
        return F.min_by(F.struct(F.col("_old")[field].alias("v")), F.when(mentioned, F.col("_at")))

    net = undone.groupBy(key).agg(
        F.min_by("action", "_at").alias("_first"),
        F.bool_or(F.col("action") != "restore").alias("_structural"),
        *[earliest(f.name).alias(f"_old_{f.name}") for f in fields],
    )

    def old(f: T.StructField) -> Column:
        return _typed(F.col(f"_old_{f.name}")["v"], f.dataType)

    # one join tells kept, changed, deleted and re-inserted rows apart
    met = table.withColumn("_here", F.lit(True)).join(net, key, "full_outer")
    structural = F.coalesce("_structural", F.lit(False))
    kept = F.when(structural, F.col("_first") != "delete").otherwise(F.col("_here").isNotNull())
    columns = [
        F.col(f.name) if f.name == key else F.when(structural | F.col(f"_old_{f.name}").isNotNull(), old(f)).otherwise(F.col(f.name)).alias(f.name)
        for f in table.schema.fields
    ]
    return met.filter(kept).select(*columns)


def compensating_delete(target: dict[str, DataFrame], inserted: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows a failed run inserted (``entity_type``, ``entity_id``).

    Proxies go with their user, as the foreign key cascades.
    """

    def ids(entity: str, column: str) -> DataFrame:
        return inserted.filter(F.col("entity_type") == entity).select(F.col("entity_id").alias(column)).distinct()

    users = target["users"].join(ids("user", "id"), "id", "left_anti")
    gone = target["users"].join(ids("user", "id"), "id", "left_semi").select(F.col("id").alias("user_id"))
    return {
        "admins": target["admins"].join(ids("admin", "id"), "id", "left_anti"),
        "users": users,
        "proxies": target["proxies"].join(gone, "user_id", "left_anti").join(ids("proxy", "id"), "id", "left_anti"),
    }
