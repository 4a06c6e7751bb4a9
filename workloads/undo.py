"""Undo over a transaction log made from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylog.plans import undo
from ferrylog.session import load_table
from workloads.adapters import SQL_ACCOUNTS, SQL_OPERATIONS, account_rows, target_tables, transaction_log
from workloads.registry import query

WITH = f"WITH {SQL_OPERATIONS} "


@query(
    "a12_transaction_status",
    WITH + "SELECT transaction_id, CASE WHEN CAST(transaction_id AS BIGINT) % 4 = 3 THEN 'rolled_back' ELSE 'committed' END AS status, CAST(count(*) AS INTEGER) AS operation_count, "
    "CAST(CASE WHEN CAST(transaction_id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS checkpoint_count, strftime(min(made_at), '%Y-%m-%dT%H:%M:%SZ') AS start_time FROM operations GROUP BY transaction_id",
)
def a12(spark, folder):
    return undo.transaction_status(transaction_log(spark, folder)).drop("metadata")


@query(
    "w16_checkpoint_marks",
    WITH + "SELECT transaction_id, CAST(pos AS INTEGER) AS pos, (pos + 1) % 10 = 0 AND pos < 40 AS is_checkpoint, pos >= 40 AS over_limit FROM operations",
)
def w16(spark, folder):
    marks = undo.checkpoint_marks(undo.logged_operations(transaction_log(spark, folder)), 10, 40)
    return marks.select("transaction_id", "pos", "is_checkpoint", "over_limit")


@query(
    "b1_undo_plan",
    WITH + "SELECT transaction_id, CAST(pos AS INTEGER) AS pos, action, undoable, row_number() OVER (PARTITION BY transaction_id ORDER BY pos DESC) AS undo_order FROM operations",
)
def b1(spark, folder):
    return undo.undo_plan(transaction_log(spark, folder)).select("transaction_id", "pos", "action", "undoable", "undo_order")


@query(
    "b1_undo_to_checkpoint",
    WITH + "SELECT transaction_id, CAST(pos AS INTEGER) AS pos, action, undo_order FROM (SELECT *, count(*) OVER (PARTITION BY transaction_id) AS n, "
    "row_number() OVER (PARTITION BY transaction_id ORDER BY pos DESC) AS undo_order FROM operations) WHERE CAST(transaction_id AS BIGINT) % 2 = 0 AND pos >= floor(n / 2)",
)
def b1_checkpoint(spark, folder):
    log = transaction_log(spark, folder)
    wanted = log.select("transaction_id", F.concat(F.lit("cp-"), F.col("transaction_id")).alias("checkpoint_id"))
    return undo.undo_plan(log, wanted).select("transaction_id", "pos", "action", "undo_order")


@query(
    "u4_inverse_rules",
    WITH + "SELECT transaction_id, CAST(pos AS INTEGER) AS pos, CASE operation_type WHEN 'update_user' THEN 'delete' WHEN 'delete_user' THEN 'reinsert' ELSE 'restore' END AS action FROM operations",
)
def u4(spark, folder):
    """A caller's own inverse rules stand before the built-in ones."""
    plan = undo.undo_plan(transaction_log(spark, folder), inverses={"update_user": "delete", "insert_user": "restore"})
    return plan.select("transaction_id", "pos", "action")


@query(
    "b2_apply_undo",
    WITH + """, undone AS (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY made_at, transaction_id, pos) AS i,
    bool_or(action <> 'restore') OVER (PARTITION BY username) AS structural FROM operations WHERE undoable
), first_status AS (
  SELECT username, old_status FROM undone WHERE action <> 'delete' QUALIFY row_number() OVER (PARTITION BY username ORDER BY i) = 1
), first_limit AS (
  SELECT username, old_limit FROM undone WHERE has_limit AND action <> 'delete' QUALIFY row_number() OVER (PARTITION BY username ORDER BY i) = 1
), net AS (
  SELECT u.username, u.action AS first_action, u.structural, s.old_status, l.username IS NOT NULL AS knows_limit, l.old_limit
  FROM undone u LEFT JOIN first_status s USING (username) LEFT JOIN first_limit l USING (username) WHERE u.i = 1
)
SELECT a.username, coalesce(n.old_status, a.status) AS status, CASE WHEN n.knows_limit THEN n.old_limit ELSE a.data_limit END AS data_limit
FROM account_rows a LEFT JOIN net n USING (username) WHERE n.username IS NULL OR NOT n.structural
UNION ALL SELECT username, old_status, old_limit FROM net WHERE structural AND first_action <> 'delete'
""",
)
def b2(spark, folder):
    plan = undo.undo_plan(transaction_log(spark, folder))
    return undo.apply_undo(account_rows(spark, folder), plan, "users")


@query(
    "b3_compensating_delete",
    f"WITH {SQL_ACCOUNTS} SELECT 'users' AS entity, id FROM target_users WHERE (id - 1) % 5 <> 0 UNION ALL SELECT 'admins', id FROM target_admins WHERE id % 7 <> 0 "
    "UNION ALL SELECT 'proxies', id FROM target_proxies WHERE user_id NOT IN (SELECT id FROM target_users WHERE (id - 1) % 5 = 0)",
)
def b3(spark, folder):
    target = target_tables(spark, folder)
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    users = load_table(spark, folder, "customer").filter(c % 5 == 0).select(F.lit("user").alias("entity_type"), (c + 1).alias("entity_id"))
    admins = load_table(spark, folder, "supplier").filter(s % 7 == 0).select(F.lit("admin").alias("entity_type"), s.alias("entity_id"))
    left = undo.compensating_delete(target, users.unionByName(admins))
    parts = [left[n].select(F.lit(n).alias("entity"), "id") for n in ("users", "admins", "proxies")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
