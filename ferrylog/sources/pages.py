"""Landed API pages: ``{"items": [...], "total": n}`` files per entity, read with declared schemas.

Nothing is lost on the way in: a page that cannot be read is set aside with its file and text, an item that does not fit the
schema alone with its own text. The envelope is parsed once, with items as texts; each item is then typed by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylog.functions.payloads import object_or_empty
from ferrylog.functions.schemas import BOOL, LONG, TEXT, struct
from ferrylog.operators.ordering import running

# fixed values: the entities and their fields
IDS = T.ArrayType(LONG)
PROXY = struct(id=TEXT)
ITEM_SCHEMAS = {
    "admins": struct(
        id=LONG, username=TEXT, enabled=BOOL, is_sudo=BOOL, service_ids=IDS, created_at=TEXT, telegram_id=LONG,
        discord_webhook=TEXT, password_reset_at=TEXT, users_usage=LONG,
    ),
    "users": struct(
        id=LONG, username=TEXT, key=TEXT, proxies=struct(vless=PROXY, vmess=PROXY, trojan=PROXY, shadowsocks=PROXY),
        enabled=BOOL, activated=BOOL, is_active=BOOL, expired=BOOL, data_limit_reached=BOOL, data_limit=LONG,
        used_traffic=LONG, lifetime_used_traffic=LONG, expire_date=TEXT, expire_strategy=TEXT, usage_duration=LONG,
        activation_deadline=TEXT, data_limit_reset_strategy=TEXT, traffic_reset_at=TEXT, note=TEXT, service_ids=IDS,
        subscription_url=TEXT, owner_username=TEXT, created_at=TEXT, sub_revoked_at=TEXT, updated_at=TEXT,
        sub_updated_at=TEXT, sub_last_user_agent=TEXT, online_at=TEXT,
    ),
    "services": struct(id=LONG, name=TEXT, inbound_ids=IDS),
    "inbounds": struct(id=LONG, tag=TEXT, protocol=TEXT, config=TEXT, node_id=LONG, service_ids=IDS),
}
REQUIRED = {
    "admins": ("id", "username"),
    "users": ("username",),
    "services": ("id", "name"),
    "inbounds": ("id", "tag", "protocol", "config"),
}
DEFAULTS = {
    "admins": {"enabled": True, "is_sudo": False},
    "users": {"enabled": True, "data_limit": 0, "used_traffic": 0, "lifetime_used_traffic": 0},
    "services": {},
    "inbounds": {},
}
PAGE_SIZE = 100


def item_type(entity: str) -> T.StructType:
    return ITEM_SCHEMAS[entity]


def read_pages(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Pages, one per line: ``entity``, their place (``file``, ``block``, ``line``), ``offset``, ``total``, ``items`` as JSON texts.

    ``page_error`` says why a page has no items to read; its text is then in ``page_text``. ``offset`` is where the page starts in the
    listing, if whoever landed the page wrote it.
    """
    envelope = "offset string, total string, items array<string>, _corrupt_record string"
    parsed = F.from_json("value", envelope, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # within a block of a file, lines have rising numbers; blocks start at their place in the file
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.lit(entity).alias("entity"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        parsed.alias("_page"),
    )
    error = F.when(F.col("_page._corrupt_record").isNotNull(), F.lit("not a page")).when(F.col("_page.items").isNull(), F.lit("no items"))
    return lines.select(
        "entity",
        "file",
        "block",
        "line",
        F.col("_page.offset").try_cast("long").alias("offset"),
        F.col("_page.total").try_cast("long").alias("total"),
        F.when(error.isNull(), F.col("_page.items")).alias("items"),
        error.alias("page_error"),
        F.when(error.isNotNull(), F.col("value")).alias("page_text"),
    )


def unreadable_pages(pages: DataFrame) -> DataFrame:
    """Pages without items to read, with their file, text and error."""
    return pages.filter(F.col("page_error").isNotNull()).select("entity", "file", "page_error", "page_text")


def file_order(name: Column) -> Column:
    """Sorts file names by the numbers in them: ``page_2`` before ``page_10``, padded or not."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+", ""), 20, "0")).otherwise(x)), "")


def _placed(pages: DataFrame) -> DataFrame:
    """Readable pages with ``_start``: their offset, or where they start if listed in the order of files and lines."""
    readable = pages.filter(F.col("page_error").isNull())
    if readable.filter(F.col("offset").isNull()).isEmpty():
        return readable.withColumn("_start", F.col("offset"))
    size = F.size("items").cast("long")
    counted = running(readable.withColumn("_by", file_order(F.col("file"))), {"_upto": ("sum", size)}, ["_by", "file", "block", "line"])
    return counted.withColumn("_start", F.coalesce("offset", F.col("_upto") - size)).drop("_upto", "_by")


def page_items(pages: DataFrame, entity: str) -> DataFrame:
    """Items of all readable pages: ``seq``, their place in the listing, ``item_text``, ``ill_typed`` and the entity's fields.

    Fields that fit are there also where others do not.
    """
    schema = T.StructType([*item_type(entity).fields, T.StructField("_corrupt_record", T.StringType())])
    rows = _placed(pages).select((F.col("_start")).alias("_start"), F.posexplode("items").alias("_pos", "item_text"))
    typed = F.from_json("item_text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.select((F.col("_start") + F.col("_pos")).alias("seq"), "item_text", typed.alias("_item"))
    ill = F.col("_item").isNull() | F.col("_item._corrupt_record").isNotNull()
    return rows.select("seq", "item_text", ill.alias("ill_typed"), *[F.col(f"_item.{f.name}").alias(f.name) for f in item_type(entity)])


def accept_items(items: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with defaults filled, quarantined rows with ``error`` and ``item_text``).

    An item that does not fit the schema, or lacks a required field, is set aside; it does not end the entity.
    """
    absent = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED[entity]])
    missing = F.when(absent != "", F.concat(F.lit("missing: "), absent))
    judged = items.withColumn("error", F.when(F.col("ill_typed"), F.lit("ill-typed")).otherwise(missing)).drop("ill_typed")
    filled: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS[entity].items()}
    for field in item_type(entity):
        if isinstance(field.dataType, T.ArrayType):
            filled[field.name] = F.coalesce(F.col(field.name), F.array().cast(field.dataType))
    if entity == "inbounds":
        filled["config"] = object_or_empty(F.col("config"))
    good = judged.filter(F.col("error").isNull()).drop("error", "item_text").withColumns(filled)
    return good, judged.filter(F.col("error").isNotNull())


def page_completeness(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Per entity: items gathered against the total its first page reported, how the listing ended, and pages lost."""
    size = F.coalesce(F.size("items"), F.lit(0))
    readable = F.col("page_error").isNull()
    place = F.when(readable, F.struct(F.col("offset").isNull(), "offset", "file", "block", "line"))
    found = pages.groupBy("entity").agg(
        F.count_if(readable).alias("pages"),
        F.count_if(~readable).alias("unreadable"),
        F.sum(F.when(readable, size).otherwise(0)).cast("long").alias("gathered"),
        F.min_by("total", place).alias("reported_total"),
        F.max_by(size, place).alias("_last"),
    )
    return found.select(
        "entity",
        "pages",
        "unreadable",
        "gathered",
        "reported_total",
        (F.col("gathered") == F.col("reported_total")).alias("complete"),
        (F.col("_last") < page_size).alias("short_last_page"),
    )


@dataclass(frozen=True)
class Extract:
    entities: dict[str, DataFrame]
    quarantine: dict[str, DataFrame]
    unreadable: dict[str, DataFrame]
    failed: frozenset[str]


def extract_all(spark: SparkSession, paths: dict[str, str]) -> Extract:
    """All four entities; one whose path cannot be read becomes an empty, typed set and is marked failed."""
    good, bad, lost, failed = {}, {}, {}, set()
    for entity in ITEM_SCHEMAS:
        try:
            read = read_pages(spark, paths[entity], entity)
            items = page_items(read, entity)
        except (AnalysisException, KeyError):
            failed.add(entity)
            fields = [T.StructField("seq", T.LongType()), T.StructField("item_text", T.StringType()), T.StructField("ill_typed", T.BooleanType())]
            items = spark.createDataFrame([], T.StructType([*fields, *item_type(entity).fields]))
            read = spark.createDataFrame([], "entity string, file string, page_error string, page_text string")
        good[entity], bad[entity] = accept_items(items, entity)
        lost[entity] = unreadable_pages(read)
    return Extract(good, bad, lost, frozenset(failed))


def extraction_summary(extract: Extract) -> DataFrame:
    """Per entity the rows taken, items set aside and pages lost; a failed entity has zeros. ``failed`` also tells of lost pages."""
    parts = [
        df.select(F.lit(entity).alias("entity"), *[F.lit(int(kind == k)).cast("long").alias(k) for k in ("rows", "quarantined", "unreadable_pages")])
        for kind, sets in (("rows", extract.entities), ("quarantined", extract.quarantine), ("unreadable_pages", extract.unreadable))
        for entity, df in sets.items()
    ]
    zeros = [F.lit(0).cast("long").alias(k) for k in ("rows", "quarantined", "unreadable_pages")]
    spark = parts[0].sparkSession
    every = spark.createDataFrame([(e,) for e in extract.entities], "entity string").select("entity", *zeros)
    for part in parts:
        every = every.unionByName(part)
    summed = every.groupBy("entity").agg(*[F.sum(k).alias(k) for k in ("rows", "quarantined", "unreadable_pages")])
    gone = F.col("entity").isin(sorted(extract.failed)) if extract.failed else F.lit(False)
    return summed.withColumn("failed", gone | (F.col("unreadable_pages") > 0))


def land_pages(items: DataFrame, path: str, entity: str, page_size: int = PAGE_SIZE, offsets: bool = True, item_text: Column | None = None) -> None:
    """Write numbered items (``seq`` from 0) as page files, one page per line, in the order of file names and lines.

    ``offsets`` writes each page's start into it; ``item_text`` replaces the JSON of the items where it is not null.
    """
    fields = [F.col(f.name) for f in item_type(entity) if f.name in items.columns]
    start = (F.floor(F.col("seq") / page_size) * page_size).cast("long")
    text = F.to_json(F.struct(*fields))
    row = F.struct(F.col("seq"), (text if item_text is None else F.coalesce(item_text, text)).alias("item"))
    paged = items.groupBy(start.alias("_start")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    listed = F.array_join(F.transform("_rows", lambda r: r["item"]), ",")
    head = F.concat(F.lit('"offset":'), F.col("_start").cast("string"), F.lit(",")) if offsets else F.lit("")
    page = F.concat(F.lit("{"), head, F.lit(f'"total":{items.count()},"items":['), listed, F.lit("]}"))
    paged.repartitionByRange("_start").sortWithinPartitions("_start").select(page.alias("value")).write.text(path)
