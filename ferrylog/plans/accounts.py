"""Account transfer: source users and admins to target users, proxies and admins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.datetimes import iso_to_timestamp, timestamp_to_unix, unix_to_timestamp
from ferrylog.functions.identifiers import key_to_uuid
from ferrylog.functions.payloads import object_or_empty
from ferrylog.functions.schemas import BOOL, INT, LONG, MOMENT, TEXT, struct
from ferrylog.operators.rows import keep_first

# fixed values: protocols of the source, and columns of the target tables
PROTOCOLS = ("vless", "vmess", "trojan", "shadowsocks")
USERS_SCHEMA = struct(
    id=INT, username=TEXT, status=TEXT, used_traffic=LONG, data_limit=LONG, expire=LONG, created_at=MOMENT,
    admin_id=INT, data_limit_reset_strategy=TEXT, note=TEXT, sub_revoked_at=MOMENT, sub_updated_at=MOMENT,
    sub_last_user_agent=TEXT, online_at=MOMENT, edit_at=MOMENT, on_hold_timeout=MOMENT, on_hold_expire_duration=INT,
    auto_delete_in_days=INT, last_status_change=MOMENT,
)
PROXIES_SCHEMA = struct(
    id=INT, user_id=INT, type=TEXT, settings=TEXT,
)
ADMINS_SCHEMA = struct(
    id=INT, username=TEXT, hashed_password=TEXT, is_sudo=BOOL, created_at=MOMENT, password_reset_at=MOMENT,
    telegram_id=LONG, discord_webhook=TEXT, users_usage=LONG,
)
PLACEHOLDER_PREFIX = "NEEDS_RESET__"


def has_text(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def user_status(as_of: Column) -> Column:
    """disabled, expired, on_hold, limited or active; the first that holds. Unset flags decide nothing."""
    expires, deadline = iso_to_timestamp(F.col("expire_date")), iso_to_timestamp(F.col("activation_deadline"))
    limit = F.coalesce("data_limit", F.lit(0))
    used = F.coalesce("used_traffic", F.lit(0))
    return (
        F.when(F.col("enabled").eqNullSafe(False), "disabled")
        .when(F.col("expired").eqNullSafe(True) | F.coalesce(expires < as_of, F.lit(False)), "expired")
        .when(
            F.col("expire_strategy").eqNullSafe("start_on_first_use")
            & F.col("activated").eqNullSafe(False)
            & F.coalesce(deadline > as_of, F.lit(False)),
            "on_hold",
        )
        .when((limit > 0) & (used >= limit) & F.col("data_limit_reached").eqNullSafe(True), "limited")
        .otherwise("active")
    )


def transform_users(users: DataFrame, as_of: datetime) -> DataFrame:
    """Source users to target user rows (18 columns), all in one projection."""
    now = F.lit(as_of).cast("timestamp")
    held = F.col("_status") == "on_hold"

    def moment(name: str) -> Column:
        return iso_to_timestamp(F.col(name))

    created = F.coalesce(moment("created_at"), now)
    none_int = F.lit(None).cast("int")
    return (
        users.filter(has_text(F.col("username")))
        .withColumn("_status", user_status(now))
        .select(
            "username",
            F.col("_status").alias("status"),
            F.coalesce("data_limit", F.lit(0)).alias("data_limit"),
            F.coalesce("used_traffic", F.lit(0)).alias("used_traffic"),
            F.when(~held, timestamp_to_unix(moment("expire_date"))).alias("expire"),
            created.alias("created_at"),
            F.greatest(F.coalesce(moment("updated_at"), now), created).alias("edit_at"),
            "note",
            moment("sub_revoked_at").alias("sub_revoked_at"),
            moment("sub_updated_at").alias("sub_updated_at"),
            "sub_last_user_agent",
            moment("online_at").alias("online_at"),
            F.when(has_text(F.col("data_limit_reset_strategy")), F.col("data_limit_reset_strategy"))
            .otherwise("no_reset")
            .alias("data_limit_reset_strategy"),
            none_int.alias("admin_id"),
            F.when(held, moment("activation_deadline")).alias("on_hold_timeout"),
            F.when(held, F.col("usage_duration")).alias("on_hold_expire_duration"),
            none_int.alias("auto_delete_in_days"),
            now.alias("last_status_change"),
        )
    )


def explicit_proxies() -> Column:
    """The user's own proxy ids as an array of (type, uuid)."""
    each = F.array(
        *[F.struct(F.lit(p.upper()).alias("type"), F.col("proxies")[p]["id"].alias("uuid")) for p in PROTOCOLS]
    )
    return F.filter(each, lambda p: has_text(p["uuid"]))


def user_proxies() -> Column:
    """Explicit proxies; without any, the account key as one VLESS proxy; without a usable key, none."""
    explicit = explicit_proxies()
    from_key = key_to_uuid(F.col("key"))
    fallback = F.array(F.struct(F.lit("VLESS").alias("type"), from_key.alias("uuid")))
    return F.when(F.size(explicit) > 0, explicit).when(from_key.isNotNull(), fallback).otherwise(F.array().cast("array<struct<type:string,uuid:string>>"))


def transform_proxies(users: DataFrame) -> DataFrame:
    """One row per proxy: the owner's name, type and settings JSON."""
    rows = users.filter(has_text(F.col("username"))).select("username", F.explode(user_proxies()).alias("_p"))
    return rows.select("username", F.col("_p.type").alias("type"), F.to_json(F.struct(F.col("_p.uuid").alias("id"))).alias("settings"))


def transform_admins(admins: DataFrame, as_of: datetime) -> DataFrame:
    """Source admins to target admin rows with a placeholder password that repeats per name."""
    now = F.lit(as_of).cast("timestamp")
    return admins.filter(has_text(F.col("username"))).select(
        "username",
        F.concat(F.lit(PLACEHOLDER_PREFIX), F.md5(F.col("username").cast("binary"))).alias("hashed_password"),
        F.coalesce("is_sudo", F.lit(False)).alias("is_sudo"),
        F.coalesce(iso_to_timestamp(F.col("created_at")), now).alias("created_at"),
        iso_to_timestamp(F.col("password_reset_at")).alias("password_reset_at"),
        "discord_webhook",
        F.coalesce("users_usage", F.lit(0)).alias("users_usage"),
        "telegram_id",
    )


def transform_accounts(users: DataFrame, admins: DataFrame, as_of: datetime, dedupe: bool = True) -> dict[str, DataFrame]:
    """The whole set: rows without a name skipped, the first row per name kept, then transformed."""
    if dedupe:
        users = keep_first(users.filter(has_text(F.col("username"))), ["username"], ["seq"])
        admins = keep_first(admins.filter(has_text(F.col("username"))), ["username"], ["seq"])
    return {
        "admins": transform_admins(admins, as_of),
        "users": transform_users(users, as_of),
        "proxies": transform_proxies(users),
    }


def split_transformable(users: DataFrame, error: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to transform, rows set aside with ``error``) for the tolerant run; no dedupe."""
    unnamed = F.when(~has_text(F.col("username")), F.lit("missing username"))
    problem = F.coalesce(unnamed, error) if error is not None else unnamed
    judged = users.withColumn("error", problem)
    return judged.filter(F.col("error").isNull()).drop("error"), judged.filter(F.col("error").isNotNull())


def transform_summary(users: DataFrame, admins: DataFrame) -> DataFrame:
    """Counts of the transformation in one row, from rows deduplicated already."""
    named = users.filter(has_text(F.col("username")))
    made = F.size(user_proxies())
    by_key = (F.size(explicit_proxies()) == 0) & (made > 0)
    counted = named.agg(
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum(made), F.lit(0)).cast("long").alias("proxies"),
        F.count_if(by_key).alias("users_by_key"),
        F.count_if(made == 0).alias("users_without_proxy"),
    )
    tally = admins.filter(has_text(F.col("username"))).agg(F.count(F.lit(1)).alias("admins"))
    entities = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("entity"), F.col(c).alias("rows")) for c in counted.columns])))
    return entities.unionByName(tally.select(F.lit("admins").alias("entity"), F.col("admins").alias("rows")))


def prune_to_target(df: DataFrame, target: T.StructType) -> DataFrame:
    """Only the columns the target table has."""
    return df.select(*[f.name for f in target if f.name in df.columns])


def coerce_to_target(df: DataFrame, target: T.StructType) -> DataFrame:
    """Bring columns to the target's types; what cannot be brought there becomes NULL.

    Timestamps come from ISO text or unix seconds; ``expire`` (unix seconds) from a timestamp,
    a number or digits; integers and text by safe casts.
    """
    out = []
    for field in target:
        if field.name not in df.columns:
            continue
        col, have = F.col(field.name), df.schema[field.name].dataType
        if isinstance(field.dataType, T.TimestampType):
            if isinstance(have, T.NumericType):
                new = unix_to_timestamp(col)
            elif isinstance(have, T.StringType):
                new = iso_to_timestamp(col)
            elif isinstance(have, (T.TimestampType, T.TimestampNTZType)):
                new = col.cast("timestamp")
            else:
                new = F.lit(None).cast("timestamp")
        elif field.name == "expire":
            if isinstance(have, T.TimestampType):
                new = timestamp_to_unix(col)
            elif isinstance(have, T.StringType):
                new = F.when(col.rlike(r"^\d+$"), col).try_cast("long")
            elif isinstance(have, T.NumericType):
                new = col.try_cast("long")
            else:
                new = F.lit(None).cast("long")
        else:
            new = col.try_cast(field.dataType)
        out.append(new.alias(field.name))
    return df.select(*out)


def insert_if_absent(rows: DataFrame, target: DataFrame, order: list[str], key: str = "username") -> DataFrame:
    """Rows to add: named, first of their name, and not in the target yet."""
    first = keep_first(rows.filter(has_text(F.col(key))), [key], order)
    return first.join(target.select(key), key, "left_anti")


def resolve_proxies(proxies: DataFrame, users: DataFrame) -> DataFrame:
    """Proxies with their owner's id and parsed settings; adaptive skew joins split an owner with very many proxies."""
    found = proxies.join(users.select("username", F.col("id").alias("user_id")), "username")
    return found.select("user_id", "username", "type", object_or_empty(F.col("settings")).alias("settings"))


def orphan_proxies(proxies: DataFrame, users: DataFrame) -> DataFrame:
    """Proxies whose owner is not a known user."""
    return proxies.join(users.select("username"), "username", "left_anti")


def transfer(users: DataFrame, admins: DataFrame, target: dict[str, DataFrame], as_of: datetime) -> dict[str, DataFrame]:
    """Rows to append to ``admins``, ``users`` and (by owner's name) ``proxies`` of the target."""
    made = transform_accounts(users, admins, as_of)
    rows = {"admins": coerce_to_target(made["admins"], ADMINS_SCHEMA), "users": coerce_to_target(made["users"], USERS_SCHEMA)}
    fresh = {name: df.join(target[name].select("username"), "username", "left_anti") for name, df in rows.items()}
    return {**fresh, "proxies": made["proxies"]}
