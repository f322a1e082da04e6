"""Physical-plan properties the design relies on."""

from usagelens.operators import usage, windows
from usagelens.params import Filters


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_scans_each_table_once(spark, tables):
    p = plan(usage.summary(spark, tables, Filters()))
    assert p.count("FileScan parquet") == 3
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_session_windows_shuffles_pre_aggregated_buckets(spark, tables):
    df = windows.usage_windows(tables.api_requests, windows.SESSION_GAP_SECONDS)
    p = plan(df)
    # partial aggregate before the first exchange; window only over bucket summaries
    assert p.count("Exchange hashpartitioning") == 2
    first_exchange = p.rfind("Exchange hashpartitioning")
    assert "HashAggregate" in p[first_exchange:]
    assert p.find("Window") < first_exchange


def test_per_user_rollup_reuses_partitioning(spark, tables):
    df = windows.session_windows(spark, tables, Filters())
    p = plan(df)
    assert p.count("Exchange hashpartitioning") == 2  # (user, bucket) then user; rollups reuse it


def test_mask_is_broadcast(spark, tables):
    df = usage.by_user(spark, tables, Filters(masked=True), nested=False)
    assert "BroadcastHashJoin" in plan(df)


def test_filters_reach_the_scan(spark, tables):
    df = usage.by_model(spark, tables, Filters(source="bedrock"))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type, [purchase,view])" in p


def test_by_user_is_one_scan(spark, tables):
    p = plan(usage.by_user(spark, tables, Filters(), nested=False))
    assert p.count("FileScan parquet") == 1 and "Join" not in p and p.count("Exchange hashpartitioning") == 2


def test_window_summary_does_not_sort(spark, tables):
    p = plan(windows.window_summary(windows.session_windows(spark, tables, Filters(), ordered=False)))
    assert "rangepartitioning" not in p


def test_timeline_has_no_global_sort(spark, tables):
    from usagelens.operators import sessions

    assert "rangepartitioning" not in plan(sessions.session_timeline(tables, nested=False))


def test_joins_start_no_job_while_planning(spark, tables):
    from usagelens.operators import billing

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        billing.join_roster(tables.api_requests, tables.org_members)
        usage.by_user(spark, tables, Filters(masked=True), nested=False)
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_attribute_maps_are_built_once(spark):
    import datetime as dt

    from usagelens.sources import otlp

    df = spark.createDataFrame([("f", "{}")], "file string, value string")
    p = plan(otlp.missing_usage_report(otlp.flatten_otlp(df, dt.datetime(2024, 1, 1))))
    # one parser each for the payload (cut into texts), a resource and a record; none is inlined a second time
    assert p.count("map_from_arrays") <= 2 and p.count("from_json") == 3


def test_otlp_ingest_is_narrow(spark):
    import datetime as dt
    import json

    from usagelens.sources import otlp

    rec = {"timeUnixNano": "1", "body": {"stringValue": "api_request"},
           "attributes": [{"key": "model", "value": {"stringValue": "m"}}]}
    df = spark.createDataFrame([("f", json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [rec]}]}]}))],
                               "file string, value string")
    routed = otlp.route(otlp.flatten_otlp(df, dt.datetime(2024, 1, 1)))
    for out in routed.values():
        assert "Exchange" not in plan(out)


def test_request_dedup_limits_each_id_before_the_shuffle(spark):
    import json

    from usagelens.sources import invocations

    msg = json.dumps({"schemaType": "ModelInvocationLog", "operation": "InvokeModel", "requestId": "r"})
    ev = spark.createDataFrame([(1, msg, "f", 0), (2, msg, "f", 1)],
                               "timestamp bigint, message string, file string, pos bigint")
    d = invocations.dedup_by_request_id(invocations.keep_invocations(invocations.parse_invocation_events(ev)), None)
    p = plan(d)
    assert "WindowGroupLimit" in p and p.rfind("WindowGroupLimit") > p.find("Exchange")
    assert d.count() == 1


def test_places_are_numbered_by_ranges(spark):
    from pyspark.sql import functions as F
    from usagelens.plans import registry

    df = spark.range(0, 5000, 1, 7).select(F.format_string("u%05d", (F.col("id") * 7919) % 5000).alias("name"))
    placed = registry._placed(df.repartitionByRange(5, "name").sortWithinPartitions("name"))
    assert "row_number" not in plan(placed)
    assert sorted(map(tuple, placed.collect())) == [(i + 1, f"u{i:05d}") for i in range(5000)]
    assert placed.dtypes == [("place", "int"), ("name", "string")]
    assert registry._placed(df.limit(0).orderBy("name")).collect() == []


def test_payload_texts_are_not_shuffled(tables):
    # they were, twice, and sorted twice: at size that spilled several times the text
    from usagelens.plans import derived

    plan = derived.otlp_payloads(tables, 4)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "rangepartitioning(payload" in exchanges[0]
    assert "rl#" not in plan[plan.index("Exchange"):]  # the text is made above it
