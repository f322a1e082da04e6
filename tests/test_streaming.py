"""Structured Streaming ingest: restart and replay leave no duplicates."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from usagelens import schemas
from usagelens.operators import usage
from usagelens.params import Filters
from usagelens.sources import facts, otlp
from usagelens.streaming import ingest

AS_OF = dt.datetime(2024, 5, 1)


def _payload(i: int) -> str:
    rec = {"timeUnixNano": str(1704067200000000000 + i * 1_000_000_000), "body": {"stringValue": "user_prompt"},
           "attributes": [{"key": "prompt.length", "value": {"intValue": str(i)}},
                          {"key": "user.email", "value": {"stringValue": f"u{i % 3}@x"}}]}
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [rec]}]}]})


def test_restart_and_replay_are_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for f in range(3):
        (src / f"p{f}.json").write_text("\n".join(_payload(f * 10 + j) for j in range(4)) + "\n")
    sink, ck, al = str(tmp_path / "facts"), str(tmp_path / "ck"), str(tmp_path / "aliases")

    def run():
        q = ingest.stream_ingest_otlp(spark, str(src), sink, ck, as_of=AS_OF, alias_path=al, max_files_per_trigger=1)
        q.awaitTermination()

    run()
    first = sorted(r["prompt_length"] for r in facts.read_fact(spark, sink, "user_prompts").collect())
    aliases_1 = {r["email"]: r["alias"] for r in ingest.read_aliases(spark, al).collect()}
    assert first == sorted(f * 10 + j for f in range(3) for j in range(4))
    assert sorted(aliases_1.values()) == ["USER-1", "USER-2", "USER-3"]

    counts = spark.read.json(os.path.join(sink, "_ingest_counts")).collect()
    assert sorted(r["user_prompts"] for r in counts) == [4, 4, 4] and all(r["unknown"] == 0 for r in counts)

    run()  # restart: nothing new
    for name in ("2", ".2.crc"):  # as if the driver died before committing batch 2
        path = os.path.join(ck, "commits", name)
        if os.path.exists(path):
            os.remove(path)
    run()  # replay of batch 2 overwrites its own output
    again = sorted(r["prompt_length"] for r in facts.read_fact(spark, sink, "user_prompts").collect())
    assert again == first
    assert {r["email"]: r["alias"] for r in ingest.read_aliases(spark, al).collect()} == aliases_1


def _start(spark, src, tmp_path, name, **kw):
    ingest.stream_ingest_otlp(spark, str(src), str(tmp_path / "facts"), str(tmp_path / name), as_of=AS_OF,
                              alias_path=str(tmp_path / "aliases"), **kw).awaitTermination()


def test_rejected_payloads_are_kept_with_their_text(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    broken = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"attributes": [{"key": "x"}]}]}]}]})
    (src / "a.json").write_text("\n".join([_payload(1), "not json {", _payload(2), '{"resourceLogs":[{', broken]) + "\n")
    _start(spark, src, tmp_path, "ck")
    got = sorted((r["reason"], r["payload"]) for r in ingest.read_quarantine(spark, str(tmp_path / "facts")).collect())
    assert got == [("attribute without value", broken), ("invalid JSON", "not json {"), ("invalid JSON", '{"resourceLogs":[{')]
    counts = spark.read.json(str(tmp_path / "facts" / "_ingest_counts")).first()
    assert (counts["user_prompts"], counts["bad_payloads"], counts["quarantined"], counts["records"]) == (2, 2, 3, 3)


def test_fresh_checkpoint_and_batch_writes_share_a_root(spark, tmp_path):
    src, more, root = tmp_path / "in", tmp_path / "more", str(tmp_path / "facts")
    src.mkdir(), more.mkdir()
    (src / "a.json").write_text(_payload(1) + "\n" + _payload(2) + "\n")
    (more / "b.json").write_text(_payload(3) + "\n" + _payload(4) + "\n")
    _start(spark, src, tmp_path, "ck1")
    _start(spark, more, tmp_path, "ck2")
    recs = otlp.flatten_otlp(spark.createDataFrame([("f", _payload(5))], "file string, value string"), AS_OF)
    otlp.ingest_otlp(recs, root)
    assert sorted(r["prompt_length"] for r in facts.read_fact(spark, root, "user_prompts").collect()) == [1, 2, 3, 4, 5]
    al = ingest.read_aliases(spark, str(tmp_path / "aliases")).collect()
    assert sorted(r["alias"] for r in al) == ["USER-1", "USER-2", "USER-3"] and len({r["email"] for r in al}) == 3
    t = facts.load_stored_tables(spark, root)  # four of the five tables hold nothing
    assert t.api_requests.count() == 0 and usage.summary(spark, t, Filters()).first()["total_prompts"] == 5
    ingest_name = "again"
    for _ in range(2):  # the same name replaces its own rows
        otlp.ingest_otlp(recs, root, ingest_name)
    assert facts.read_fact(spark, root, "user_prompts").count() == 6
    assert facts.read_fact(spark, str(tmp_path / "nowhere"), "tool_uses").count() == 0


def test_a_day_is_written_to_few_files(spark, tmp_path, tables):
    root = str(tmp_path / "facts")
    facts.write_facts({"api_requests": tables.api_requests.repartition(16)}, root)
    days = tables.api_requests.select(F.to_date("timestamp")).distinct().count()
    assert len(glob.glob(f"{root}/api_requests/event_date=*/ingest=*/part-*")) <= days + 2
    assert facts.read_fact(spark, root, "api_requests").schema.fieldNames() == schemas.API_REQUESTS.fieldNames()


def test_failing_id_read_fails_the_batch(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "facts")
    src.mkdir()
    msg = json.dumps({"schemaType": "ModelInvocationLog", "operation": "InvokeModel", "requestId": "R1", "modelId": "m"})
    (src / "a.json").write_text(json.dumps({"timestamp": 1704067200000, "message": msg}) + "\n")

    def run(name):
        ingest.stream_ingest_invocations(spark, str(src), root, str(tmp_path / name)).awaitTermination()

    run("ck1")
    run("ck2")  # R1 is stored already
    assert [r["aws_request_id"] for r in facts.read_fact(spark, root, "api_requests").collect()] == ["R1"]
    for part in glob.glob(f"{root}/_request_ids/run=0-*/part-*"):
        with open(part, "wb") as f:
            f.write(b"no parquet")
        for crc in glob.glob(os.path.join(os.path.dirname(part), ".*.crc")):
            os.truncate(crc, 0)
    with pytest.raises(Exception):
        run("ck3")
    assert facts.read_fact(spark, root, "api_requests").count() == 1


def test_late_rows_count_and_a_sink_has_one_stream(spark, tmp_path):
    from usagelens.streaming import live

    src = tmp_path / "in"
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 3)]
    for i, d in enumerate(days):
        spark.createDataFrame([(d, None if i == 3 else "u@x", 1.0, 1, 1)], "timestamp timestamp, user_email string, cost_usd double, input_tokens bigint, "
                              "output_tokens bigint").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out, out2 = str(tmp_path / "daily"), str(tmp_path / "windows")
    live.stream_daily_cost(stream, out, str(tmp_path / "c1")).awaitTermination()
    assert {r["day"].month: r["requests"] for r in live.read_daily_cost(spark, out).collect()} == {1: 3, 3: 1}
    live.stream_usage_windows(stream, out2, str(tmp_path / "c2")).awaitTermination()
    got = sorted((str(r["user_email"]), r["window_id"], r["request_count"]) for r in live.read_usage_windows(spark, out2).collect())
    assert got == [("None", 1, 1), ("u@x", 1, 2), ("u@x", 2, 1)]
    with pytest.raises(Exception, match="another stream"):
        live.stream_daily_cost(stream, out, str(tmp_path / "c3")).awaitTermination()


def test_stored_tables_prune_partitions(spark, tmp_path):
    from usagelens.sources import fixtures

    t = fixtures.load_tables(spark, "/root/testdata/sf0.001")
    root = str(tmp_path / "facts")
    facts.write_facts({"api_requests": t.api_requests, "tool_uses": t.tool_uses, "user_prompts": t.user_prompts,
                       "api_errors": t.api_errors, "tool_decisions": t.tool_decisions}, root)
    stored = facts.load_stored_tables(spark, root)
    f = Filters(from_="2024-01-05", to="2024-01-06T12:00:00")
    got = usage.by_model(spark, stored, f).collect()
    want = usage.by_model(spark, t, f).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = usage.by_model(spark, stored, f)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_invocation_stream_stats_equal_batch(spark):
    from tests.conftest import SF_SMALL
    from usagelens.plans import streams
    from usagelens.plans.registry import REGISTRY

    sink = streams._synced(spark, SF_SMALL)
    s = spark.read.json(f"{sink}/_sync_stats").agg(F.sum("inserted"), F.sum("skipped")).first()
    b = REGISTRY["invocation_sync_stats"](spark, SF_SMALL).first()
    assert (s[0], s[1]) == (b["inserted"], b["skipped"])


def _emails(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "email string")


def test_aliases_are_appended_by_what_a_batch_names(spark, tmp_path):
    path = str(tmp_path / "aliases")
    stored = lambda: {r["email"]: r["alias"] for r in ingest.read_aliases(spark, path).collect()}
    assert ingest.append_aliases(_emails(spark, "b", "a", "b", None), path, "s-0", AS_OF) == 2
    assert ingest.append_aliases(_emails(spark, "c", "a"), path, "s-1", AS_OF) == 1
    assert ingest.append_aliases(_emails(spark, "a", "c"), path, "s-2", AS_OF) == 0
    assert not os.path.exists(f"{path}/ingest=s-2")  # a batch without new users stores nothing
    want = {"a": "USER-1", "b": "USER-2", "c": "USER-3"}
    assert stored() == want and ingest.highest_alias(spark, path) == 3
    # a replay gives the same numbers, and the next batch goes on without a gap
    assert ingest.append_aliases(_emails(spark, "c", "a"), path, "s-1", AS_OF) == 1 and stored() == want
    assert ingest.append_aliases(_emails(spark, "d"), path, "s-3", AS_OF) == 1 and stored()["d"] == "USER-4"
    # a table written without notes is read for its numbers
    other = _emails(spark, "z").selectExpr("email", "'USER-9' as alias", "timestamp'2024-01-01' as created_at")
    other.write.parquet(f"{path}/ingest=elsewhere")
    assert ingest.append_aliases(_emails(spark, "e", "z"), path, "s-4", AS_OF) == 1
    assert stored()["e"] == "USER-10" and ingest.highest_alias(spark, path, without="s-4") == 9


def test_a_crash_before_the_aliases_gives_no_number_twice(spark, tmp_path):
    path = str(tmp_path / "aliases")
    ingest.append_aliases(_emails(spark, "a"), path, "s-0", AS_OF)
    ingest._counts_row(spark, {"highest": 2}, f"{path}/{ingest.NUMBERS}", "s-1")  # noted, then died
    assert ingest.append_aliases(_emails(spark, "b"), path, "t-0", AS_OF) == 1  # a fresh checkpoint takes over
    assert {r["alias"] for r in ingest.read_aliases(spark, path).collect()} == {"USER-1", "USER-3"}


def test_alias_lookup_reads_only_matching_row_groups(spark, tmp_path):
    path = str(tmp_path / "aliases")
    for b in range(12):
        ingest.append_aliases(_emails(spark, *(f"u{i:04d}-{b}@x" for i in range(200))), path, f"s-{b}", AS_OF)
    probe = ingest.read_aliases(spark, path, emails=["u0007-3@x", "new@x"])
    assert [r["email"] for r in probe.collect()] == ["u0007-3@x"]
    scan = spark.read.schema(ingest.ALIASES).parquet(path).where(F.col("email").isin(["u0007-3@x", "new@x"]))
    assert "PushedFilters: [In(email" in scan._jdf.queryExecution().executedPlan().toString()
    assert ingest.highest_alias(spark, path) == 12 * 200


def test_thousands_of_names_reach_the_scan_as_one_in(spark, tmp_path):
    # as nested ORs they overflowed the stack of the reading task
    root, n = str(tmp_path / "facts"), 5000
    ids = spark.range(2 * n).selectExpr("concat('req-', lpad(id, 6, '0')) as aws_request_id")
    facts.write_request_ids(ids, root, "before")
    assert facts.read_request_ids(spark, root, [f"req-{i:06d}" for i in range(n + 1000, 2 * n + 1000)]).count() == n - 1000
