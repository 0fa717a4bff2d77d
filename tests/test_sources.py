"""Spec readers."""

import json

from coordlytics.functions.columns import parse_durations
from coordlytics.operators.validate import validate_specs
from coordlytics.operators.relations import list_kind
from coordlytics.sources.specs import EVENT_SCHEMA, SPEC_SCHEMAS, read_clustered, read_events, read_specs, write_clustered
from helpers import got


def test_json_specs_report_unknown_fields(spark, tmp_path):
    specs = [
        {"ns": "default", "name": "stage", "created_at": "2024-01-01T12:00:00Z", "labels": {"app": "etl"}, "expected": 10, "quorum": 8,
         "timeout": "30m", "onTimeout": "fail", "maxRetries": 3},
        {"ns": "default", "name": "plain", "expected": 2}, {"ns": "default", "name": "wrong", "expected": 2, "quorum": 3, "timeout": "soon"}]
    path = tmp_path / "barriers.json"
    path.write_text("\n".join(json.dumps(s) for s in specs))
    df = read_specs(spark, str(path), "barrier")
    assert got(validate_specs(df, "barrier"), "name", "message") == [
        ("stage", "unknown field maxRetries"), ("stage", "unknown field onTimeout"),
        ("wrong", "quorum must not exceed expected"), ("wrong", "timeout is not a duration")]
    assert got(parse_durations(df, "timeout").filter("timeout_valid"), "name") == [("plain",), ("stage",)]
    assert got(df.filter("labels['app'] = 'etl'"), "name", "expected", "quorum") == [("stage", 10, 8)]


def test_parquet_specs_of_every_kind(spark, tmp_path):
    for kind, schema in SPEC_SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / kind))
        assert read_specs(spark, str(tmp_path / kind), kind).columns == [c for c in spark.createDataFrame([], schema).columns]


def test_only_mapped_columns_are_scanned(spark):
    df = read_specs(spark, "/root/testdata/sf0.001/orders.parquet", "barrier", {"name": "o_orderkey", "expected": "3"})
    plan = df.filter("name = '7'")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_a_time_range_reads_only_its_days(spark, tmp_path):
    rows = [("default", f"u{i}", f"2024-01-{1 + i // 4:02d} {6 * (i % 4):02d}:00:00", i) for i in range(20)]
    log = spark.createDataFrame(rows, "ns string, name string, at string, seq long").selectExpr(
        "ns", "name", "cast(at as timestamp) as ts", "seq", "cast(at as date) as date")
    log.write.partitionBy("date").parquet(str(tmp_path / "log"))
    df = read_events(spark, str(tmp_path / "log"), source_schema=EVENT_SCHEMA + ", date date",
                     since="2024-01-02 12:00:00", until="2024-01-04 06:00:00")
    assert got(df, "seq") == sorted([(i,) for i in range(6, 13)], key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_labels_of_a_clustered_log_reach_the_files(spark, tmp_path):
    rows = [("default" if i % 5 else "other", f"l{i % 7}", f"h{i}", f"2024-01-{1 + i // 40:02d} 01:00:00", i, {"lease": f"l{i % 7}", "app": "etl" if i % 2 else "web"})
            for i in range(200)]
    log = spark.createDataFrame(rows, "ns string, lease string, holder string, at string, seq long, labels map<string,string>").selectExpr(
        "ns", "lease", "holder", "cast(at as timestamp) as ts", "seq", "labels")
    path = str(tmp_path / "log")
    write_clustered(log, path, ["lease", "app"])
    schema = "ns string, lease string, holder string, ts timestamp, seq long, labels map<string,string>"
    back = read_clustered(spark, path, schema, ["lease", "app"], since="2024-01-02 00:00:00", until="2024-01-04 00:00:00")
    found = list_kind(back, "default", {"lease": "l3", "app": "etl"})
    assert got(found, "seq") == sorted([(i,) for i in range(40, 120) if i % 5 and i % 7 == 3 and i % 2], key=repr)
    assert got(list_kind(log, "default", {"lease": "l3"}), "seq") == sorted([(i,) for i in range(200) if i % 5 and i % 7 == 3], key=repr)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found.select("seq")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(label_lease,l3)" in plan and "EqualTo(label_app,etl)" in plan and "PartitionFilters: [isnotnull(date" in plan
    assert "labels:map" not in plan
    assert read_clustered(spark, path, schema, ["lease", "app"]).count() == 200
