"""Stored facts: rollups answer like the raw rows, the feed reads the newest days only."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import feed, rollups, usage
from usagelens.params import Filters
from usagelens.sources import facts
from tests.test_maintenance import rows_read

T0 = dt.datetime(2024, 1, 1)
NAMES = ("summary", "cost_over_time", "by_model", "tool_stats", "hourly_activity")


def answers(spark, module, t, f):
    out = []
    for name in NAMES:
        rows = getattr(module, name)(spark, t, f).collect()
        out.append(sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows))
    return out


def batch(spark, rng, n, days=4):
    """Requests, tools, prompts and errors at odd times, some at the full hour, some without a time, user or session."""
    def when():
        if rng.random() < 0.05:
            return None
        at = T0 + dt.timedelta(hours=rng.randrange(24 * days))
        return at if rng.random() < 0.2 else at + dt.timedelta(seconds=rng.randrange(3600), microseconds=rng.choice([0, 999999]))

    user = lambda: rng.choice(["a@x", "b@x", "c@x", None])
    req = [(rng.randrange(10 ** 9), when(), user(), rng.choice(["s1", "s2", "s3", None]), rng.choice(["m1", "m2", None]), rng.random(),
            rng.choice([None, 3, 50]), rng.randrange(9), rng.choice(["claude_code", "bedrock", None])) for _ in range(n)]
    tool = [(i, when(), user(), rng.choice(["Bash", "Edit", None]), rng.choice([0, 1, None]), rng.choice([None, 10, 25])) for i in range(n)]
    other = [(i, when(), user()) for i in range(n)]
    common = "id bigint, timestamp timestamp, user_email string"
    return {"api_requests": spark.createDataFrame(req, common + ", session_id string, model string, cost_usd double, input_tokens bigint, "
                                                  "output_tokens bigint, source string").coalesce(1),
            "tool_uses": spark.createDataFrame(tool, common + ", tool_name string, success int, duration_ms bigint").coalesce(1),
            "user_prompts": spark.createDataFrame(other, common).coalesce(1), "api_errors": spark.createDataFrame(other[:5], common).coalesce(1)}


def test_rollups_equal_raw_rows(spark, tmp_path):
    root, rng = str(tmp_path), random.Random(5)
    facts.write_facts(batch(spark, rng, 60), root, "s-0")
    facts.build_rollups(spark, root)
    facts.write_facts(batch(spark, rng, 40), root, "s-1")           # late rows of the same hours
    last = batch(spark, rng, 30)
    facts.write_facts(last, root, "s-2")
    assert facts.compact_facts(spark, root, min_writes=2)["hourly_requests"] > 0
    facts.write_facts(last, root, "s-2")                            # replayed after the compaction
    t = facts.load_stored_tables(spark, root)
    ranges = [Filters(), Filters(from_="2024-01-02T05:17:00"), Filters(to="2024-01-03T00:00:00"),
              Filters(from_="2024-01-01T10:30:00", to="2024-01-01T10:45:30", users=("a@x", "c@x")),
              Filters(from_="2024-01-01T10:00:00", to="2024-01-02T11:00:00", source="claude_code"),
              Filters(from_=dt.datetime(2024, 1, 1, 23, 59, 59, 999999), to=dt.datetime(2024, 1, 3, 7, 30), source="bedrock", users=("b@x",)),
              Filters(from_="2024-01-03", to="2024-01-02"), Filters(from_="2030-01-01")]
    for f in ranges:
        assert answers(spark, rollups, t, f) == answers(spark, usage, t, f), f
    facts.build_rollups(spark, root)                                # again over all that is there
    assert answers(spark, rollups, facts.load_stored_tables(spark, root), ranges[1]) == answers(spark, usage, t, ranges[1])


def test_a_range_reads_rollups_and_two_cut_hours(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(20000).select("id", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 30 as int), cast(id % 5 as int), 0, id % 3000)")
                                     .alias("timestamp"), F.lit("a@x").alias("user_email"), F.lit("s").alias("session_id"), F.lit(0.5).alias("cost_usd"))
    facts.write_facts({"api_requests": rows}, root, "s-0")
    facts.build_rollups(spark, root)
    t = facts.load_stored_tables(spark, root)
    f = Filters(from_="2024-01-05T10:20:00", to="2024-01-25T02:20:00")
    days = rows_read(t.api_requests.where("event_date in ('2024-01-05', '2024-01-25')"))
    hours = rows_read(t.extra["rollups"]["hourly_requests"])
    answer = rollups.by_model(spark, t, f)
    assert answer.count() == 1 and rows_read(answer) <= days + hours < 20000 / 10


@pytest.fixture
def sixty_days(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(6000).select("id", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 60 as int), 0, 0, id)").alias("timestamp"),
                                    F.concat(F.lit("u"), F.col("id") % 7).alias("user_email"), F.lit(0.5).alias("cost_usd"),
                                    F.col("id").alias("duration_ms"))
    facts.write_facts({"api_requests": rows, "tool_uses": rows.where("id % 3 = 0"), "user_prompts": rows.limit(50),
                       "api_errors": rows.withColumn("timestamp", F.lit(None).cast("timestamp")).limit(9)}, root)
    return facts.load_stored_tables(spark, root)


def test_feed_reads_the_newest_days(spark, sixty_days):
    import dataclasses

    plain = dataclasses.replace(sixty_days, extra={})
    for f, k in ((Filters(), 50), (Filters(), 500), (Filters(users=("u3",)), 20), (Filters(users=("nobody",)), 5), (Filters(), 10 ** 6)):
        got = [tuple(r) for r in feed.recent_events(spark, sixty_days, f, k).collect()]
        assert got == [tuple(r) for r in feed.recent_events(spark, plain, f, k).collect()]
    assert rows_read(feed.recent_events(spark, sixty_days, Filters(), 50)) < 200
    assert rows_read(feed.recent_events(spark, plain, Filters(), 50)) > 8000


def test_stored_facts_are_landed_from_one_reading_of_the_events(spark, tmp_path):
    from usagelens import schemas
    from usagelens.plans import landed
    from usagelens.sources import fixtures

    kinds = ["view", "purchase", "click", "signup", "error", None]
    rows = [(None if i % 50 == 7 else i % 120, None if i % 40 == 3 else T0 + dt.timedelta(minutes=37 * i), None if i % 30 == 9 else i % 11,
             kinds[i % 6], i / 4, None if i % 25 == 4 else '{"k": %d}' % (i % 100)) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    orders = spark.createDataFrame([], "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double")
    sf = str(tmp_path)
    events.coalesce(1).write.parquet(f"{sf}/events.parquet")
    orders.write.parquet(f"{sf}/orders.parquet")
    t = fixtures.load_tables(spark, sf)
    key = (fixtures.session_key(spark), sf, "facts")
    stored = facts.load_stored_tables(spark, landed.facts_root(spark, sf))
    for name in schemas.FACTS:
        want = facts.align_schema(getattr(t, name), schemas.FACTS[name])
        got = getattr(stored, name).drop("event_date")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0, name
    assert answers(spark, rollups, stored, Filters()) == answers(spark, usage, t, Filters())
    # every write reads its own part, no write goes back to the events and their JSON
    dealt = landed._dealt_base(t, f"{sf}/base")
    assert rows_read(fixtures.api_requests(dealt.where("part = 1").drop("part"))) == dealt.where("part = 1").count() < len(rows) / 2
    assert sum(dealt.where(f"part = {p}").count() for p in range(landed.FACT_WRITES)) == len(rows) and key in landed._LANDED
