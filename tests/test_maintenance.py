"""Stored state stays small and right: compaction of facts, runs of request ids, snapshots of live sinks."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from usagelens.sources import facts, folders
from usagelens.streaming import live

DAY = dt.datetime(2024, 1, 1)


def prompts(spark, batch, days=3):
    rows = [(batch * 100 + d, DAY + dt.timedelta(days=d, minutes=batch), batch) for d in range(days)] + [(batch * 100 + 99, None, batch)]
    return {"user_prompts": spark.createDataFrame(rows, "id bigint, timestamp timestamp, prompt_length bigint").coalesce(1)}


def content(spark, root):
    return sorted((r.id, str(r.timestamp), r.prompt_length) for r in facts.read_fact(spark, root, "user_prompts").collect())


def files(root, name="user_prompts"):
    return glob.glob(f"{root}/{name}/event_date=*/ingest=*/part-*")


def test_fifty_batches_leave_few_files(spark, tmp_path):
    root, plain = str(tmp_path / "a"), []
    for b in range(50):
        facts.write_facts(prompts(spark, b), root, f"s-{b}")
        plain += [(b * 100 + d, str(DAY + dt.timedelta(days=d, minutes=b)), b) for d in range(3)] + [(b * 100 + 99, "None", b)]
        if b % 16 == 15:
            assert facts.compact_facts(spark, root)["user_prompts"] == 4
    assert content(spark, root) == sorted(plain)
    assert len(files(root)) <= 4 * (1 + 2)   # a compacted file and two batches for each day and for rows without one
    assert facts.compact_facts(spark, root, min_writes=2) == {"user_prompts": 4, **dict.fromkeys(
        ["api_requests", "tool_uses", "api_errors", "tool_decisions"], 0)}
    assert len(files(root)) == 4 and content(spark, root) == sorted(plain)
    assert facts.stored_days(spark, root, "user_prompts") == ["2024-01-03", "2024-01-02", "2024-01-01"]
    one_day = facts.read_fact(spark, root, "user_prompts", keep_partition_date=True).where("event_date = '2024-01-02'")
    assert one_day.count() == 50


def test_replay_after_compaction_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    for b in range(3):
        facts.write_facts(prompts(spark, b), root, f"s-{b}")
    before = content(spark, root)
    facts.compact_facts(spark, root, min_writes=2)
    facts.write_facts(prompts(spark, 2), root, "s-2")       # the batch is replayed
    assert content(spark, root) == before
    facts.write_facts(prompts(spark, 3), root, "s-3")
    facts.compact_facts(spark, root, min_writes=2)
    assert [i for i, *_ in content(spark, root)] == sorted(b * 100 + d for b in range(4) for d in (0, 1, 2, 99))
    assert len(files(root)) == 4


@pytest.mark.parametrize("fails_at", [0, 1, 3])
def test_crash_during_compaction(spark, tmp_path, monkeypatch, fails_at):
    """Whatever of the old folders is still there: every row counts once, and the next run cleans up."""
    root = str(tmp_path)
    for b in range(3):
        facts.write_facts(prompts(spark, b), root, f"s-{b}")
    facts.compact_facts(spark, root, min_writes=3)
    facts.write_facts(prompts(spark, 3), root, "s-3")
    before, calls, discard = content(spark, root), [], folders.discard

    def dies(spark, path):
        calls.append(path)
        if len(calls) > fails_at:
            raise OSError("killed")
        discard(spark, path)

    monkeypatch.setattr(folders, "discard", dies)
    with pytest.raises(OSError):
        facts.compact_facts(spark, root, min_writes=2)
    assert content(spark, root) == before
    monkeypatch.setattr(folders, "discard", discard)
    facts.compact_facts(spark, root, min_writes=2)
    assert content(spark, root) == before and len(files(root)) == 4


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "aws_request_id string").coalesce(1)


def rows_read(df):
    """Rows that the scans of a collected plan have handed on."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if hasattr(node, "executedPlan") and "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_batch_reads_only_runs_that_may_hold_its_ids(spark, tmp_path):
    root, n = str(tmp_path), 40
    name = lambda b, i: f"{(b * 7919 + i * 104729) % 999983:06d}-{b}-{i}"
    for b in range(100):
        facts.write_request_ids(ids(spark, [name(b, i) for i in range(n)]), root, f"s-{b}")
        facts.merge_request_ids(spark, root)
    runs = facts.id_runs(spark, root)
    assert {k: len(v) for k, v in runs.items()} == {0: 4, 1: 4, 2: 1}
    assert facts.read_request_ids(spark, root).count() == 100 * n
    wanted = [name(99, i) for i in range(0, n, 2)]                    # all in one run of level 0
    found = facts.read_request_ids(spark, root, wanted + ["000000-new", "555555-new"])
    assert sorted(r[0] for r in found.collect()) == sorted(wanted) and rows_read(found) == n
    fresh = [f"{i:06d}-fresh" for i in range(0, 990000, 9900)]
    none = facts.read_request_ids(spark, root, fresh)
    assert none.count() == 0 and rows_read(none) == 0                   # no run is read for new ids
    assert facts.read_request_ids(spark, root, wanted, without="s-99").count() == 0
    old = [name(0, i) for i in range(n)]                                # merged twice; its origin is still known
    assert facts.read_request_ids(spark, root, old).count() == n
    assert facts.read_request_ids(spark, root, old, without="s-0").count() == 0
    facts.write_request_ids(ids(spark, old), root, "s-0")               # a replay stores them once more
    assert facts.read_request_ids(spark, root, old).distinct().count() == n
    assert facts.read_request_ids(spark, str(tmp_path / "nowhere")) is None


def requests(spark, src, batches):
    for i in range(batches):
        spark.createDataFrame([(DAY + dt.timedelta(days=i % 4, hours=i % 7), f"u{i % 3}@x", 0.5, i, 1)],
                              "timestamp timestamp, user_email string, cost_usd double, input_tokens bigint, output_tokens bigint"
                              ).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_live_sink_holds_a_snapshot_and_few_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 4)
    stream, out = requests(spark, str(tmp_path / "in"), 18), str(tmp_path / "daily")

    def run():
        live.stream_daily_cost(stream, out, str(tmp_path / "ck")).awaitTermination()

    died, discard = [], folders.discard

    def dies(spark, path):
        if "/batch=2" in path and not died and glob.glob(f"{out}/stream=*/snapshot=*"):
            died.append(path)
            raise OSError("killed")
        discard(spark, path)

    monkeypatch.setattr(folders, "discard", dies)
    with pytest.raises(Exception, match="killed"):
        run()                                  # between the snapshot's move and the deletions
    got = {r["day"].day: r["requests"] for r in live.read_daily_cost(spark, out).collect()}
    assert got == {d + 1: 1 for d in range(4)}
    run()                                      # the batch is replayed, the rest follows
    got = {r["day"].day: (r["requests"], r["input_tokens"]) for r in live.read_daily_cost(spark, out).collect()}
    assert got == {d + 1: (len(x), sum(x)) for d in range(4) for x in [range(d, 18, 4)]}
    parts = glob.glob(f"{out}/stream=*/*")
    assert len([p for p in parts if "/snapshot=" in p]) == 1 and len([p for p in parts if "/batch=" in p]) < 4
    assert not glob.glob(f"{out}/stream=*/_gone-*")
