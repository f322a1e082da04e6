"""OTLP ingest edge cases on hand-written payloads."""

import datetime as dt
import json
import os
import re

import pytest

from usagelens.sources import otlp

AS_OF = dt.datetime(2024, 5, 1, 12, 0, 0)


def sv(x):
    return {"stringValue": x}


def attrs(**kv):
    return [{"key": k.replace("__", "."), "value": v} for k, v in kv.items()]


def payload(records, resource=None, snake=False):
    rl = {"resource": {"attributes": resource or []}, "scopeLogs": [{"logRecords": records}]}
    p = {"resourceLogs": [rl]}
    text = json.dumps(p)
    if snake:
        for a, b in otlp_snake():
            text = text.replace(f'"{a}":', f'"{b}":')
    return text


def otlp_snake():
    from usagelens.plans.derived import SNAKE_KEYS

    return SNAKE_KEYS


def ingest(spark, payloads):
    df = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(payloads)], "file string, value string")
    recs = otlp.flatten_otlp(df, AS_OF)
    return recs, otlp.route(recs)


NS = "1704067200123456789"   # 2024-01-01T00:00:00.123456789Z


def test_api_request_fallbacks_and_coercion(spark):
    recs = [
        {"timeUnixNano": NS, "body": sv("claude_code.api_request"),
         "attributes": attrs(model=sv(""), modelID=sv("m1"), cost=sv(" 1.5 "), input=sv("12abc"),
                             tokens__output={"intValue": "7"}, cache_read_tokens={"doubleValue": 3.0},
                             duration=sv("1e3"), user__email=sv("a@x"), session__id=sv("s1"))},
        {"timeUnixNano": NS, "body": sv("api_request"),
         "attributes": attrs(gen_ai__request__model=sv("m2"), cost_usd=sv("1.5d"), input_tokens=sv(""),
                             output_tokens={"boolValue": True})},
        {"attributes": attrs(event__name=sv("claude_code.api_request"), session__id=sv(""))},
    ]
    _, t = ingest(spark, [payload(recs, resource=attrs(service__name=sv("open-code")))])
    rows = sorted(t["api_requests"].collect(), key=lambda r: r["model"] or "")
    assert len(rows) == 3
    r0, r1, r2 = rows
    assert r0["model"] is None and r0["timestamp"] == AS_OF          # no timestamp -> as_of
    assert r0["session_id"] is None                                   # '' is not truthy
    assert (r1["model"], r1["cost_usd"], r1["input_tokens"], r1["output_tokens"], r1["cache_read_tokens"],
            r1["duration_ms"]) == ("m1", 1.5, 12, 7, 3, 1)
    assert r1["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)  # truncated to ms
    assert r1["source"] == "open_code"
    assert (r2["model"], r2["cost_usd"], r2["input_tokens"], r2["output_tokens"]) == ("m2", None, None, None)


def test_record_overrides_resource_and_duplicates(spark):
    recs = [{"timeUnixNano": NS, "body": sv("claude_code.user_prompt"),
             "attributes": attrs(user__email=sv("rec@x"), prompt=sv("first")) + attrs(prompt=sv("second"))}]
    res = attrs(user__email=sv("res@x"), session__id=sv("s-res"))
    _, t = ingest(spark, [payload(recs, resource=res)])
    r = t["user_prompts"].first()
    assert (r["user_email"], r["session_id"], r["prompt_content"]) == ("rec@x", "s-res", "second")


def test_event_name_only_from_record(spark):
    recs = [{"timeUnixNano": NS, "attributes": attrs(tool__name=sv("Bash"))}]
    recs_ok = [{"timeUnixNano": NS, "attributes": attrs(event__name=sv("tool_result"), tool__name=sv("Bash"))}]
    res = attrs(event__name=sv("claude_code.tool_result"))
    _, t = ingest(spark, [payload(recs, resource=res), payload(recs_ok)])
    assert t["tool_uses"].count() == 1


@pytest.mark.parametrize("value,want", [({"boolValue": True}, 1), (sv("true"), 1), (sv("false"), 0),
                                        ({"boolValue": False}, 0), (None, 0), ({"intValue": "1"}, 0)])
def test_tool_success(spark, value, want):
    a = attrs(tool_name=sv("Read"))
    if value is not None:
        a += [{"key": "tool.success", "value": value}]
    _, t = ingest(spark, [payload([{"timeUnixNano": NS, "body": sv("claude_code.tool_result"), "attributes": a}])])
    assert t["tool_uses"].first()["success"] == want


def test_falsy_double_zero_in_or_chain(spark):
    a = attrs(tool__duration_ms={"doubleValue": 0}, duration_ms=sv("25"), tool__name=sv("X"))
    _, t = ingest(spark, [payload([{"timeUnixNano": NS, "body": sv("tool_result"), "attributes": a}])])
    assert t["tool_uses"].first()["duration_ms"] == 25


def test_snake_case_payload(spark):
    recs = [{"timeUnixNano": NS, "body": sv("claude_code.api_error"),
             "attributes": attrs(error__message=sv("boom"), http__status_code={"intValue": "529"},
                                 retry__count={"intValue": "0"})}]
    _, t = ingest(spark, [payload(recs, snake=True)])
    r = t["api_errors"].first()
    assert (r["error_message"], r["status_code"], r["retries"]) == ("boom", 529, 0)
    assert r["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)


def test_quarantine_unknown_and_bad_json(spark):
    good = {"timeUnixNano": NS, "body": sv("claude_code.tool_decision"),
            "attributes": attrs(tool__name=sv("Edit"), tool__decision=sv("accept"))}
    broken = {"timeUnixNano": NS, "body": sv("claude_code.tool_decision"),
              "attributes": [{"key": "tool.name"}]}
    unknown = {"timeUnixNano": NS, "body": sv("claude_code.session_start"), "attributes": []}
    texts = [payload([good, broken, unknown]), "not json {", json.dumps({"other": 1})]
    recs, t = ingest(spark, texts)
    assert t["tool_decisions"].count() == 1
    counts = {r["target"]: r["records"] for r in otlp.ingest_counts(recs).collect()}
    assert counts == {"tool_decisions": 1, "(unknown)": 1}
    df = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(texts)], "file string, value string")
    reasons = sorted(r["reason"] for r in otlp.quarantine(df, AS_OF).collect())
    assert reasons == ["attribute without value", "invalid JSON"]


def test_structured_value_kept_as_json(spark):
    a = [{"key": "prompt", "value": {"arrayValue": {"values": [sv("x")]}}}]
    _, t = ingest(spark, [payload([{"timeUnixNano": NS, "body": sv("user_prompt"), "attributes": a}])])
    assert t["user_prompts"].first()["prompt_content"] == '{"arrayValue":{"values":[{"stringValue":"x"}]}}'


def test_missing_usage_report(spark):
    recs = [{"timeUnixNano": NS, "body": sv("api_request"), "attributes": attrs(model=sv("m"))},
            {"timeUnixNano": NS, "body": sv("api_request"), "attributes": attrs(cost_usd=sv("0"))}]
    r, _ = ingest(spark, [payload(recs)])
    rows = otlp.missing_usage_report(r).collect()
    assert [(x["source"], x["attribute_keys"], x["records"]) for x in rows] == [("claude_code", "model", 1)]


def test_read_otlp_from_files(spark, tmp_path):
    recs = [{"timeUnixNano": NS, "body": sv("user_prompt"), "attributes": attrs(prompt__length=sv("12.7"))}]
    (tmp_path / "a.json").write_text(payload(recs) + "\n" + payload(recs) + "\n")
    df = otlp.read_otlp(spark, str(tmp_path), AS_OF)
    t = otlp.route(df)
    rows = t["user_prompts"].collect()
    assert [r["prompt_length"] for r in rows] == [12, 12]
    assert len({r["id"] for r in rows}) == 1  # equal payload lines have equal ids, and both count


def test_keys_and_order_do_not_depend_on_the_split(spark, tmp_path):
    from usagelens.operators import usage
    from usagelens.plans.registry import usage_tables

    text = [payload([{"timeUnixNano": NS, "body": sv("api_request"), "attributes": attrs(model=sv(f"m{i}"))}]) for i in range(300)]
    (tmp_path / "a.json").write_text("\n".join(text) + "\n")
    seen, size = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("4k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            req = otlp.route(otlp.read_otlp(spark, str(tmp_path), AS_OF))["api_requests"]
            n = req.rdd.getNumPartitions()
            ids = {r["id"] for r in req.collect()}
            last = [r["model"] for r in usage.sample_rows(spark, usage_tables(api_requests=req), 5).collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append((n, ids, last))
    assert seen[0][0] > seen[1][0] and seen[0][1] == seen[1][1] and len(seen[0][1]) == 300
    assert seen[0][2] == seen[1][2] == ["m299", "m298", "m297", "m296", "m295"]


def test_poison_values_do_not_stop_the_batch(spark):
    recs = [{"timeUnixNano": "9" * 40, "body": sv("api_error"), "attributes": attrs(http__status_code={"intValue": "99999999999"},
                                                                                retry__count=sv("9" * 30))},
            {"timeUnixNano": "-1", "body": sv("api_error"), "attributes": attrs(http__status_code=sv("x"))}]
    _, t = ingest(spark, [payload(recs)])
    rows = sorted(t["api_errors"].collect(), key=lambda r: str(r["status_code"]))
    assert (rows[0]["status_code"], rows[0]["retries"], rows[0]["timestamp"]) == (99999999999, None, AS_OF)
    assert rows[1]["status_code"] is None


@pytest.mark.parametrize("value,want", [({"futureValue": {"a": 1}}, '{"futureValue":{"a":1}}'), ("bare", '"bare"'), (12, "12"),
                                        (True, "true"), ([1, 2], "[1,2]"), ({}, "{}")])
@pytest.mark.parametrize("snake", [False, True])
def test_unknown_kinds_and_bare_values_are_kept_as_json(spark, value, want, snake):
    a = [{"key": "other", "value": sv("x")}, {"key": "prompt", "value": value}]
    recs, t = ingest(spark, [payload([{"timeUnixNano": NS, "body": sv("user_prompt"), "attributes": a}], snake=snake)])
    assert recs.filter("quarantined").count() == 0
    assert t["user_prompts"].first()["prompt_content"] == want


def test_a_null_value_is_quarantined_once_with_its_payload(spark):
    text = payload([{"timeUnixNano": NS, "body": sv("user_prompt"), "attributes": [{"key": "prompt", "value": None}]}])
    recs, t = ingest(spark, [text])
    assert t["user_prompts"].count() == 0
    assert [(r["reason"], r["payload"]) for r in otlp.quarantined(recs).collect()] == [("attribute without value", text)]


BIG = """
import datetime as dt, json, sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", 4).getOrCreate())
from usagelens.session import configure, ensure_checkpoint_dir
from usagelens.sources import facts, otlp
from usagelens.streaming import ingest
configure(spark), ensure_checkpoint_dir(spark)
src, out = sys.argv[1:]
as_of = dt.datetime(2024, 5, 1)
recs = otlp.read_otlp(spark, src, as_of)
got = recs.groupBy("quarantined").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max(F.length("payload")).alias("longest")).collect()
odd = recs.where(~F.col("quarantined")).select(F.col("attrs")["odd"]["v"].alias("v")).where("v is not null")
ingest.stream_ingest_otlp(spark, src, out + "/facts", out + "/ck", as_of=as_of).awaitTermination()
print("GOT", json.dumps({"batch": {str(r.quarantined): [r.n, r.ids, r.longest] for r in got}, "odd": odd.distinct().count(),
      "stream": facts.read_fact(spark, out + "/facts", "api_requests").count(), "rejected": ingest.read_quarantine(spark, out + "/facts").count()}))
"""


def test_large_payloads_fit_into_a_small_heap(tmp_path):
    """One payload of 10 MB with 20,000 records, every third with a value kept as JSON, every tenth rejected: 1 GB of heap."""
    import subprocess
    import sys

    def record(i):
        attrs = [{"key": k, "value": {"stringValue": f"{k}-{i}-{'x' * 30}"}} for k in ("session.id", "prompt.id", "user.email", "model")]
        attrs += [{"key": "input_tokens", "value": {"intValue": str(i)}}, {"key": "cost_usd", "value": {"doubleValue": 0.25}}]
        attrs += [{"key": "odd", "value": {"otherValue": {"a": [1, i]}}}] if i % 3 == 0 else []
        attrs += [{"key": "lost"}] if i % 10 == 0 else []
        return {"timeUnixNano": str(1704067200000000000 + i * 10 ** 9), "body": {"stringValue": "claude_code.api_request"}, "attributes": attrs}

    text = json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "claude-code"}}]},
                                         "scopeLogs": [{"logRecords": [record(i) for i in range(20000)]}]}]})
    assert len(text) > 10_000_000
    src = tmp_path / "in"
    src.mkdir()
    (src / "p.json").write_text(text + "\n")
    done = subprocess.run([sys.executable, "-c", BIG, str(src), str(tmp_path / "out")], capture_output=True, text=True, timeout=600,
                          cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = json.loads(next(line for line in done.stdout.splitlines() if "GOT" in line).split("GOT ")[1])
    assert got["batch"]["False"][:2] == [18000, 18000]
    assert got["batch"]["True"][:2] == [2000, 2000] and got["batch"]["True"][2] < 2000
    assert (got["stream"], got["rejected"], got["odd"]) == (18000, 2000, 6000)


def test_a_rejected_record_can_be_sent_again_alone(spark):
    recs = [{"timeUnixNano": "1704067200000000000", "body": {"stringValue": "user_prompt"},
             "attributes": [{"key": "prompt.length", "value": {"intValue": str(i)}}] + ([{"key": "lost"}] if i == 1 else [])} for i in range(3)]
    text = json.dumps({"resource_logs": [{"resource": {"attributes": [{"key": "session.id", "value": {"stringValue": "s"}}]},
                                          "scope_logs": [{"log_records": recs}]}]})
    df = spark.createDataFrame([("f", text)], "file string, value string")
    (row,) = otlp.quarantined(otlp.flatten_otlp(df, AS_OF)).collect()
    mended = re.sub(r'\{"key": ?"lost"\}', '{"key":"found","value":{"boolValue":true}}', row.payload)
    again = otlp.route(otlp.flatten_otlp(spark.createDataFrame([("f", mended)], "file string, value string"), AS_OF))["user_prompts"].collect()
    assert [(r.session_id, r.prompt_length) for r in again] == [("s", 1)]
