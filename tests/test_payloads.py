"""Types of payload fields at every depth."""

from __future__ import annotations

from ferrylog.plans.payload_check import _paths, compare_paths, payload_paths, payload_schemas

TEXTS = ['{"a b": 1, "d": {"x": "s", "f": true}, "l": [{"x": 1}, {"x": "t"}], "m": null, "e": [], "o": {}}', '{"a b": 1.5, "d": {"x": "s", "f": null}, "n": 1e3, "q`t": 2}', "bad {", None]


def test_schema_text():
    found = _paths("OBJECT<`a b`: DECIMAL(21,1), d: OBJECT<f: BOOLEAN, x: ARRAY<ARRAY<VARIANT>>>, e: ARRAY<VOID>, o: OBJECT<>, `q``t`: BIGINT>")
    assert found == [
        ("$", "object"), ('$."a b"', "decimal"), ("$.d", "object"), ("$.d.f", "boolean"), ("$.d.x", "list"), ("$.d.x[*]", "list"), ("$.d.x[*][*]", "conflict"),
        ("$.e", "list"), ("$.e[*]", "void"), ("$.o", "object"), ('$."q`t"', "bigint"),
    ]
    assert _paths("BIGINT") == [("$", "bigint")]


def test_paths(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "payload string")
    have = {r.path: r.type for r in payload_paths(df, "payload").collect()}
    assert have == {
        "$": "object", '$."a b"': "decimal", "$.d": "object", "$.d.x": "string", "$.d.f": "boolean", "$.l": "list", "$.l[*]": "object", "$.l[*].x": "conflict",
        "$.m": "void", "$.e": "list", "$.e[*]": "void", "$.o": "object", "$.n": "double", '$."q`t"': "bigint",
    }
    counts = payload_schemas(df, "payload").first()
    assert (counts.payloads, counts.broken) == (3, 1)
    findings = {r.path: r.finding for r in compare_paths(payload_paths(df, "payload"), {"$": "list", "$.n": "double", "$.m": "string", "$.z": "string", "$.l[*].x": "bigint"}).collect()}
    assert (findings["$"], findings["$.n"], findings["$.m"], findings["$.z"], findings["$.l[*].x"], findings["$.d"]) == ("incompatible", "compatible", "compatible", "missing", "conflict", "extra")


def test_parts_merge_to_the_whole(spark):
    """However rows are dealt out, and whatever group is hot, the merged types are those of one pass."""
    df = spark.createDataFrame([(i % 3, TEXTS[i % 4]) for i in range(400)], "g int, payload string")
    one = sorted(map(tuple, payload_paths(df.coalesce(1), "payload", ["g"]).collect()))
    assert one == sorted(map(tuple, payload_paths(df.repartition(23), "payload", ["g"]).collect()))
    assert payload_paths(df.limit(0), "payload").collect() == [] and payload_paths(df.filter("payload LIKE 'bad%'"), "payload", ["g"]).collect() == []
    plan = payload_schemas(df, "payload", ["g"])._jdf.queryExecution().toString()
    assert "Generate" not in plan and "partial_schema_of_variant_agg" in plan
