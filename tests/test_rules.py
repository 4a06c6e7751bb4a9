"""Literal cases: stream items, identifiers, datetimes, schema findings, accounts, undo."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrylog.functions.datetimes import is_iso_datetime, is_unix_timestamp, iso_to_timestamp, timestamp_to_iso, timestamp_to_unix, unix_to_timestamp
from ferrylog.functions.identifiers import is_valid_uuid, key_to_uuid, transform_uuid
from ferrylog.functions.payloads import json_value_type, object_or_empty
from ferrylog.operators import rows, sequences
from ferrylog.operators.health import congestion_flags
from ferrylog.plans import accounts, identifier_report, schema_check, undo, validation
from ferrylog.sources import pages

AS_OF = datetime(2024, 6, 1)


def items(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at long, item long")


def listed(df, column="item", order="at"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_map_filter_take_skip(spark):
    five, ten = items(spark, range(5)), items(spark, range(10))
    assert listed(rows.map_rows(five, {"at": F.col("at"), "item": F.col("item") * 2})) == [0, 2, 4, 6, 8]
    assert listed(rows.filter_rows(ten, F.col("item") % 2 == 0)) == [0, 2, 4, 6, 8]
    assert listed(rows.take(items(spark, range(100)), 5, ["at"])) == [0, 1, 2, 3, 4]
    assert listed(sequences.skip(ten, 3, ["at"])) == list(range(3, 10))


def test_map_drops_failing_items(spark):
    out = rows.map_rows(items(spark, range(4)), {"at": F.col("at"), "item": F.col("item")}, F.when(F.col("item") == 2, "no"))
    assert listed(out) == [0, 1, 3]


def test_batch_and_windows(spark):
    ten = items(spark, range(10))
    batches = sequences.batch_arrays(sequences.batch(ten, 3, ["at"]), F.col("item"))
    assert [r["items"] for r in batches.orderBy("batch_id").collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    for n, size, step in ((10, 3, 1), (10, 3, 2), (7, 4, 5), (2, 3, 1)):
        want = [list(range(i, i + size)) for i in range(0, n - size + 1, step)]
        made = sequences.sliding_window(items(spark, range(n)), size, ["at"], step, target_rows=4)
        found = made.groupBy("window_id").agg(F.sort_array(F.collect_list("item")).alias("items")).orderBy("window_id")
        assert [r["items"] for r in found.collect()] == want


def test_distinct_scan_reduce(spark):
    assert sorted(listed(rows.keep_first(items(spark, [1, 2, 2, 3, 1, 4, 3, 5]), ["item"], ["at"]))) == [1, 2, 3, 4, 5]
    five = items(spark, [1, 2, 3, 4, 5])
    assert listed(sequences.scan(five, {"item": ("sum", F.col("item"), 0)}, ["at"]), order="seq") == [0, 1, 3, 6, 10, 15]
    assert rows.reduce_rows(five, {"total": F.sum("item")}).first()["total"] == 15


def test_distinct_until_changed_keeps_a_first_null(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, 5), (3, 5), (4, None)], "at long, item long")
    assert listed(sequences.distinct_until_changed(df, F.col("item"), ["at"])) == [None, 5, None]


def test_chain(spark):
    made = rows.filter_rows(rows.map_rows(items(spark, range(50)), {"at": F.col("at"), "item": F.col("item") * 2}), F.col("item") % 4 == 0)
    first = sequences.batch(made, 5, ["at"]).filter("batch_id < 3")
    assert listed(first) == [4 * i for i in range(15)]


def test_validation_and_batch_function(spark):
    good, bad = rows.split_valid(items(spark, range(10)).withColumn("item", F.col("item") * 2), F.col("item") < 10)
    assert (good.count(), bad.count()) == (5, 5)
    added = rows.map_batches(items(spark, range(15)), lambda b: b.assign(item=b["item"] * 3 + 100), "at long, item long")
    assert listed(added) == [100 + 3 * i for i in range(15)]


def test_debounce_and_throttle(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.01), (2, 0.02), (3, 1.0), (4, 1.01)], "at long, t double").withColumn("ts", F.timestamp_seconds("t"))
    assert listed(sequences.debounce(df, "ts", 0.5, ["ts", "at"]), "at") == [2, 4]
    emits = listed(sequences.throttle(df, "ts", 0.05, ["ts", "at"]), "emit_us")
    assert len(emits) == 5 and all(b - a >= 50_000 for a, b in zip(emits, emits[1:]))


def test_zip_stops_at_the_shortest(spark):
    a = items(spark, range(3)).withColumnsRenamed({"at": "a", "item": "x"})
    b = items(spark, range(10, 15)).withColumnsRenamed({"at": "b", "item": "y"})
    assert [(r.x, r.y) for r in sequences.zip_rows([(a, ["a"]), (b, ["b"])]).orderBy("seq").collect()] == [(0, 10), (1, 11), (2, 12)]


def test_uuid_cases(spark):
    cases = [
        ("550e8400e29b41d4a716446655440000", "hex_32", "550e8400-e29b-41d4-a716-446655440000"),
        ("550e8400-e29b-41d4-a716-446655440000", "uuid_standard", "550e8400-e29b-41d4-a716-446655440000"),
        ("invalid-uuid-string", "invalid", None),
        ("550e8400", "invalid", None),
        ("", "invalid", None),
        ("550e8400e29b-41d4-a716-446655440000", "invalid", None),
        ("\n550E8400E29B41D4A716446655440000\t", "hex_32", "550E8400-E29B-41D4-A716-446655440000"),
        ("\x01550e8400-e29b-41d4-a716-446655440000", "invalid", None),
        (None, "invalid", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, value string")
    found = df.select("i", transform_uuid(F.col("value")).alias("u")).orderBy("i").collect()
    assert [(r.u.original, r.u.format, r.u.transformed) for r in found] == cases
    mixed = df.filter("i IN (0, 1, 2)").unionByName(spark.createDataFrame([(9, "A" * 32)], "i long, value string"))
    stats = identifier_report.batch_statistics(identifier_report.transform_batch(mixed, "value", "i")).first()
    assert (stats.total, stats.successful, stats.failed) == (4, 3, 1)
    none = identifier_report.recommendations(df.limit(0), "value").first()
    assert none.total == 0 and none.estimated_ms == 0


def test_uuid_to_hex_and_validity(spark):
    df = spark.createDataFrame([("550e8400-e29b-41d4-a716-446655440000",), ("a" * 32,), ("x",), (None,)], "value string")
    made = df.select(transform_uuid(F.col("value"), "hex_32").alias("u")).select("u.*").collect()
    assert [r.transformed for r in made] == ["550e8400e29b41d4a716446655440000", "a" * 32, None, None]
    checks = df.select(is_valid_uuid(F.col("value")).alias("a"), is_valid_uuid(F.col("value"), "hex_32").alias("b")).collect()
    assert [(r.a, r.b) for r in checks] == [(True, False), (True, True), (False, False), (False, False)]
    stamps = spark.createDataFrame([(-1,), (0,), (4102444800,), (4102444801,), (None,)], "s long")
    assert [r[0] for r in stamps.select(is_unix_timestamp(F.col("s"))).collect()] == [False, True, True, False, False]


def test_key_keeps_case_and_refuses_signs(spark):
    df = spark.createDataFrame([("A" * 32,), ("+" + "1" * 31,), ("0x" + "1" * 30,), ("1" * 31,), ("1" * 32 + "\n",)], "k string")
    assert [r[0] for r in df.select(key_to_uuid(F.col("k"))).collect()] == ["AAAAAAAA-AAAA-AAAA-AAAA-AAAAAAAAAAAA", None, None, None, None]


def test_datetime_cases(spark):
    cases = [
        ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", True),
        ("2024-01-01", "2024-01-01T00:00:00Z", False),
        ("2024-01-01T10:00:00.1234567+02:00", "2024-01-01T08:00:00.123456Z", True),
        ("2024-13-01T00:00:00", None, False),
        ("not a date", None, False),
        (None, None, False),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, t string")
    t = iso_to_timestamp(F.col("t"))
    found = df.select("i", "t", timestamp_to_iso(t).alias("iso"), is_iso_datetime(F.col("t")).alias("is_iso")).orderBy("i").collect()
    assert [(r.t, r.iso, r.is_iso) for r in found] == cases
    numbers = spark.createDataFrame([(0, 0), (1, -1), (2, 10**15), (3, 1700000000)], "i long, s long")
    assert [r[1] for r in numbers.select("i", timestamp_to_unix(unix_to_timestamp(F.col("s")))).orderBy("i").collect()] == [0, None, None, 1700000000]
    early = spark.sql("SELECT timestamp_micros(-1500000) AS t")
    assert early.select(timestamp_to_unix(F.col("t"))).first()[0] == -1


def test_type_cases(spark):
    cases = [('"test"', "string"), ("123", "integer"), ("true", "boolean"), ("2147483648", "bigint"), ("-9999999999", "integer"), ("1.5", "float")]
    cases += [('"2024-01-01T00:00:00Z"', "datetime_iso"), ('"2024-01-01"', "string"), ('{"a": 1}', "json"), ("[1]", "json"), ("null", "string")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(json_value_type(F.col("t"))).collect()] == [c[1] for c in cases]


def test_only_whole_objects_count(spark):
    texts = ['{"a":1}', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1}]', "[1]", "x", None, '{"a":1} x']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(object_or_empty(F.col("t"))).collect()] == ['{"a":1}'] + ["{}"] * 7


def source_users(spark, *overrides):
    base = dict(
        id=1, username="user", key="1234567890abcdef1234567890abcdef", proxies=dict(vless=dict(id=None)), enabled=True, activated=True,
        expired=False, data_limit_reached=False, data_limit=1073741824, used_traffic=536870912, expire_date="2024-12-31T23:59:59Z",
        expire_strategy="fixed_date", usage_duration=None, activation_deadline=None, data_limit_reset_strategy=None, note=None,
        created_at="2024-01-01T00:00:00Z", updated_at=None, sub_revoked_at=None, sub_updated_at=None, sub_last_user_agent=None, online_at=None,
    )
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("seq", T.LongType()), *pages.item_type("users").fields])
    filled = [{**dict.fromkeys(schema.fieldNames()), **base, "seq": i, **o} for i, o in enumerate(overrides)]
    for row in filled:
        p = row["proxies"] or {}
        row["proxies"] = {k: p.get(k) for k in accounts.PROTOCOLS}
    return spark.createDataFrame(filled, schema)


@pytest.mark.parametrize(
    "change, status",
    [
        ({}, "active"),
        ({"enabled": None}, "active"),
        ({"enabled": False, "expired": True}, "disabled"),
        ({"expired": True}, "expired"),
        ({"expire_date": "2024-01-01T00:00:00Z"}, "expired"),
        ({"expire_strategy": "start_on_first_use", "activated": False, "activation_deadline": "2024-07-01T00:00:00Z"}, "on_hold"),
        ({"expire_strategy": "start_on_first_use", "activated": None, "activation_deadline": "2024-07-01T00:00:00Z"}, "active"),
        ({"used_traffic": 2 * 1073741824, "data_limit_reached": True}, "limited"),
        ({"used_traffic": 2 * 1073741824}, "active"),
        ({"data_limit": None, "used_traffic": 5, "data_limit_reached": True}, "active"),
    ],
)
def test_status(spark, change, status):
    assert accounts.transform_users(source_users(spark, change), AS_OF).first()["status"] == status


def test_on_hold_moves_the_deadline(spark):
    held = {"expire_strategy": "start_on_first_use", "activated": False, "activation_deadline": "2024-07-01T00:00:00Z", "usage_duration": 3600}
    row = accounts.transform_users(source_users(spark, held), AS_OF).first()
    assert (row.expire, row.on_hold_timeout, row.on_hold_expire_duration) == (None, datetime(2024, 7, 1), 3600)
    plain = accounts.transform_users(source_users(spark, {"updated_at": "2023-01-01T00:00:00Z"}), AS_OF).first()
    assert plain.expire == 1735689599 and plain.edit_at == plain.created_at and plain.data_limit_reset_strategy == "no_reset"
    assert len(plain.asDict()) == 18


def test_proxies(spark):
    uid = "12345678-1234-1234-1234-123456789abc"
    users = source_users(
        spark,
        {"username": "a", "proxies": {"vless": {"id": uid}, "trojan": {"id": "t"}}},
        {"username": "b"},
        {"username": "c", "key": "invalid_key_format", "expire_date": "invalid_date_format"},
        {"username": "", "proxies": {"vless": {"id": uid}}},
    )
    made = sorted((r.username, r.type, r.settings) for r in accounts.transform_proxies(users).collect())
    key = "12345678-90ab-cdef-1234-567890abcdef"
    assert made == [("a", "TROJAN", '{"id":"t"}'), ("a", "VLESS", f'{{"id":"{uid}"}}'), ("b", "VLESS", f'{{"id":"{key}"}}')]
    assert accounts.transform_users(users.filter("username = 'c'"), AS_OF).first()["expire"] is None


def test_owners_of_proxies(spark):
    proxies = spark.createDataFrame([("u", f"T{i}", "{}") for i in range(300)] + [("v", "A", "bad")], "username string, type string, settings string")
    users = spark.createDataFrame([(1, "u")], "id int, username string")
    assert accounts.resolve_proxies(proxies, users).count() == 300
    assert [r.username for r in accounts.orphan_proxies(proxies, users).collect()] == ["v"]


def test_schema_findings(spark):
    row = [("1234567890abcdef1234567890abcdef", "user", 1, "2024-12-31T23:59:59Z", True, False, 1073741824, 536870912)]
    df = spark.createDataFrame(row, "key string, username string, id long, expire_date string, enabled boolean, expired boolean, data_limit long, used_traffic long")
    found = {r.field: r for r in schema_check.compare_fields(df, schema_check.USER_FIELDS).collect()}
    assert (found["expire"].source_type, found["expire"].target_type, found["expire"].severity) == ("datetime_iso", "datetime_unix", "high")
    assert {f for f, r in found.items() if r.finding == "missing"} >= {"status", "admin_id"}
    assert {f for f, r in found.items() if r.finding == "extra"} == {"id", "enabled", "expired", "key"}
    advice = {r.field: r.advice for r in schema_check.conversion_advice(schema_check.compare_fields(df, schema_check.USER_FIELDS)).collect()}
    assert advice["expire"] == "Convert expire from ISO datetime to Unix timestamp using datetime_to_unix_timestamp"
    empty = schema_check.compare_fields(df.limit(0), schema_check.USER_FIELDS)
    scored = schema_check.compatibility_score(empty, schema_check.USER_FIELDS).first()
    assert (scored.score, scored.missing) == (1.0, 0)


def test_pages_quarantine_and_order(spark, tmp_path):
    lines = [
        '{"offset": 0, "total": 3, "items": [{"id": 1, "username": "a"}, {"id": 2}]}',
        '{"offset": 2, "total": 9, "items": [{"id": 3, "username": "c", "extra": 1}, {"id": "x", "username": "d"}, null]}',
        '{"offset": 5, "items": [',
        '{"offset": 5, "total": 3}',
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    read = pages.read_pages(spark, str(tmp_path), "admins")
    good, bad = pages.accept_items(pages.page_items(read, "admins"), "admins")
    assert [(r.seq, r.username, r.enabled, r.service_ids) for r in good.orderBy("seq").collect()] == [(0, "a", True, []), (2, "c", True, [])]
    assert [(r.seq, r.error, r.item_text) for r in bad.orderBy("seq").collect()] == [
        (1, "missing: username", '{"id":2}'),
        (3, "ill-typed", '{"id":"x","username":"d"}'),
        (4, "ill-typed", None),
    ]
    assert sorted((r.page_error, r.page_text) for r in pages.unreadable_pages(read).collect()) == [("no items", lines[3]), ("not a page", lines[2])]
    done = pages.page_completeness(read).first()
    assert (done.gathered, done.reported_total, done.complete, done.short_last_page, done.unreadable) == (5, 3, False, True, 2)


def test_pages_without_offsets_keep_file_order(spark, tmp_path):
    for f in range(3):
        lines = [json.dumps({"total": 24, "items": [{"id": f * 8 + p * 2 + i, "username": "u"} for i in range(2)]}) for p in range(4)]
        (tmp_path / f"page-{f}.json").write_text("\n".join([*lines, "{broken"]))
    read = pages.read_pages(spark, str(tmp_path), "admins")
    assert [(r.seq, r.id) for r in pages.page_items(read, "admins").orderBy("seq").collect()] == [(i, i) for i in range(24)]
    extract = pages.extract_all(spark, {"admins": str(tmp_path)})
    told = {r.entity: tuple(r)[1:] for r in pages.extraction_summary(extract).collect()}
    assert told["admins"] == (24, 0, 3, True) and told["users"] == (0, 0, 0, True)


def test_congestion_needs_two_indicators(spark):
    df = spark.createDataFrame([("s", i, 500, 0.5, 20.0, 100.0) for i in range(1, 16)], "source string, seq long, queue_length long, latency double, throughput double, rate double")
    flags = [r.congested for r in congestion_flags(df).orderBy("seq").collect()]
    assert flags == [False] * 9 + [True] * 6


# ---- undo ---------------------------------------------------------------------------------

LOG = (
    "transaction_id string, status string, start_time string, end_time string, metadata map<string,string>, "
    "operations array<struct<operation_id:string,operation_type:string,target_table:string,operation_data:string,rollback_data:string,timestamp:string>>, "
    "checkpoints array<struct<checkpoint_id:string,transaction_id:string,operation_count:bigint,checkpoint_data:string,timestamp:string>>"
)


def text(**values):
    import json

    return json.dumps(values)


def test_undo_to_checkpoint(spark):
    ops = [(f"o{i}", "insert_user", "users", text(username=f"u{i}"), None, f"2024-01-01T00:00:0{i}Z") for i in range(6)]
    log = spark.createDataFrame([("t", "committed", None, None, {}, ops, [("cp", "t", 3, "{}", None)])], LOG)
    table = spark.createDataFrame([(f"u{i}", i) for i in range(6)], "username string, data_limit long")
    plan = undo.undo_plan(log, spark.createDataFrame([("t", "cp")], "transaction_id string, checkpoint_id string"))
    assert [r.pos for r in plan.orderBy("undo_order").collect()] == [5, 4, 3]
    assert sorted(r.username for r in undo.apply_undo(table, plan, "users").collect()) == ["u0", "u1", "u2"]
    unknown = undo.undo_plan(log, spark.createDataFrame([("t", "nope")], "transaction_id string, checkpoint_id string"))
    assert unknown.count() == 0


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_undo_of_apply_is_the_start(spark, seed):
    """Random inserts, updates and deletes with honest rollback data, then all undone."""
    rng = random.Random(seed)
    start = {f"u{i}": {"status": rng.choice(["a", "b", None]), "data_limit": rng.choice([None, 1, 2])} for i in range(4)}
    state, ops = {k: dict(v) for k, v in start.items()}, []
    for i in range(rng.randint(1, 25)):
        name = f"u{rng.randint(0, 7)}"
        at = f"2024-01-01T00:00:{i:02d}Z"
        if name not in state:
            state[name] = {"status": "new", "data_limit": i}
            ops.append((f"o{i}", "insert_user", "users", text(username=name), None, at))
        elif rng.random() < 0.3:
            ops.append((f"o{i}", "delete_user", "users", text(username=name), text(username=name, **state.pop(name)), at))
        else:
            field = rng.choice(["status", "data_limit"])
            ops.append((f"o{i}", "update_user", "users", text(username=name), text(username=name, **{field: state[name][field]}), at))
            state[name][field] = rng.choice([None, "z"]) if field == "status" else rng.choice([None, 7])
    schema = "username string, status string, data_limit long"
    table = spark.createDataFrame([(k, v["status"], v["data_limit"]) for k, v in state.items()], schema)
    log = spark.createDataFrame([("t", "committed", None, None, {}, ops, [])], LOG)
    back = undo.apply_undo(table, undo.undo_plan(log), "users").collect()
    assert {r.username: {"status": r.status, "data_limit": r.data_limit} for r in back} == start
    assert len(back) == len(start)


def test_added_rule_and_unknown_type(spark):
    ops = [("o0", "insert_team", "teams", text(username="x"), None, "a"), ("o1", "merge", "users", "{}", None, "b")]
    log = spark.createDataFrame([("t", "committed", None, None, {}, ops, [])], LOG)
    plan = undo.undo_plan(log, inverses={"insert_team": "delete"}).orderBy("pos").collect()
    assert [(r.action, r.undoable) for r in plan] == [("delete", True), ("none", False)]


def test_uuid_validation_last_source_row_speaks(spark):
    users = source_users(spark, {"username": "a", "proxies": {"vless": {"id": "one"}}}, {"username": "a", "proxies": {"vless": {"id": "two"}}}, {"username": "b"})
    target = spark.createDataFrame([(5, "a")], "id int, username string")
    proxies = spark.createDataFrame([(1, 5, "vless", '{"id":"one"}'), (2, 5, "vless", '{"id":"two"}'), (3, 5, "vless", "broken")], "id int, user_id int, type string, settings string")
    judged = validation.uuid_validation(users, target, proxies)
    assert sorted((r.username, r.status) for r in judged.collect()) == [("a", "ok"), ("b", "user_missing")]
