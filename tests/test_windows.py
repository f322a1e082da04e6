"""Gap windows: thresholds, rounding, ties, NULL users; brute force check."""

import datetime as dt
import random

from pyspark.sql import functions as F

from usagelens.operators import windows
from usagelens.params import Filters

T0 = dt.datetime(2024, 1, 1)


def _req(spark, rows):
    return spark.createDataFrame(
        [(u, ts, c, i, o) for u, ts, c, i, o in rows],
        "user_email string, timestamp timestamp, cost_usd double, input_tokens bigint, output_tokens bigint")


def _count(spark, rows, gap=windows.SESSION_GAP_SECONDS):
    return {r["user_email"]: r["window_count"]
            for r in windows.per_user_windows(windows.usage_windows(_req(spark, rows), gap)).collect()}


def test_threshold_and_rounding(spark):
    s = dt.timedelta(seconds=1)
    rows = [
        ("at", T0, 1.0, 1, 1), ("at", T0 + 18000 * s, 1.0, 1, 1),                      # exactly 5 h: same
        ("below_half", T0, 1.0, 1, 1), ("below_half", T0 + 18000.499 * s, 1.0, 1, 1),  # rounds to 18000
        ("half", T0, 1.0, 1, 1), ("half", T0 + 18000.5 * s, 1.0, 1, 1),              # rounds to 18001: split
        ("over", T0, 1.0, 1, 1), ("over", T0 + 18001 * s, 1.0, 1, 1),
    ]
    assert _count(spark, rows) == {"at": 1, "below_half": 1, "half": 2, "over": 2}


def test_ties_null_user_and_durations(spark):
    h = dt.timedelta(hours=1)
    rows = [(None, T0, 1.0, 1, 2), (None, T0, 2.0, None, 3), (None, T0 + 2 * h, None, 4, None),
            (None, T0 + 10 * h, 1.5, 1, 1), ("u", T0, 1.0, 1, 1)]
    w = {r["user_email"]: r for r in windows.per_user_windows(
        windows.usage_windows(_req(spark, rows), windows.SESSION_GAP_SECONDS)).collect()}
    assert w[None]["window_count"] == 2
    assert w[None]["total_requests"] == 4
    assert w[None]["total_tokens"] == 1 + 2 + 3 + 4 + 2
    assert w[None]["total_hours"] == 2.0
    assert w[None]["total_cost"] == 4.5
    assert w["u"]["window_count"] == 1


def _brute(rows, gap):
    """Reference semantics, row by row: LAG, rounded gap, running sum."""
    out = {}
    by_user = {}
    for u, ts, c, i, o in rows:
        by_user.setdefault(u, []).append((ts, c, i, o))
    for u, rs in by_user.items():
        rs.sort(key=lambda r: r[0])
        prev, wid, wins = None, 0, {}
        for ts, c, i, o in rs:
            g = None if prev is None else (ts - prev).total_seconds()
            if g is None or int(g + 0.5) > gap:
                wid += 1
            prev = ts
            w = wins.setdefault(wid, [0, 0.0, 0, ts, ts])
            w[0] += 1
            w[1] += c or 0.0
            w[2] += (i or 0) + (o or 0)
            w[3], w[4] = min(w[3], ts), max(w[4], ts)
        out[u] = (len(wins), sum(w[0] for w in wins.values()), round(sum(w[1] for w in wins.values()), 6),
                  sum(w[2] for w in wins.values()),
                  round(sum((w[4] - w[3]).total_seconds() / 3600 for w in wins.values()), 4))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for n in range(600):
        u = rnd.choice(["a", "b", "c", None])
        ts = T0 + dt.timedelta(seconds=rnd.choice([rnd.randint(0, 10 ** 6), rnd.randint(0, 200) * 18000]))
        rows.append((u, ts, round(rnd.random(), 4), rnd.choice([None, rnd.randint(0, 900)]), rnd.randint(0, 50)))
    for gap in (windows.SESSION_GAP_SECONDS, 3600, windows.WEEKLY_GAP_SECONDS):
        got = {r["user_email"]: (r["window_count"], r["total_requests"], r["total_cost"], r["total_tokens"],
                                 r["total_hours"])
               for r in windows.per_user_windows(windows.usage_windows(_req(spark, rows), gap)).collect()}
        assert got == _brute(rows, gap), gap


def test_filter_applies_before_windows(spark, tables):
    # Cutting the range can only split windows apart, never merge them.
    full = windows.session_windows(spark, tables, Filters())
    cut = windows.session_windows(spark, tables, Filters(from_="2024-01-10", to="2024-01-12"))
    assert cut.count() <= full.count()
    assert cut.agg(F.sum("total_requests")).first()[0] < full.agg(F.sum("total_requests")).first()[0]


def test_label_requests_consistent(spark):
    h = dt.timedelta(hours=1)
    rows = [("a", T0, 1.0, 1, 1), ("a", T0 + 4 * h, 1.0, 1, 1), ("a", T0 + 10 * h, 1.0, 1, 1)]
    lab = windows.label_requests(_req(spark, rows), windows.SESSION_GAP_SECONDS).orderBy("timestamp")
    assert [r["window_id"] for r in lab.collect()] == [1, 1, 2]


def test_window_summary_empty(spark):
    empty = windows.per_user_windows(windows.usage_windows(_req(spark, []), 18000))
    r = windows.window_summary(empty).first()
    assert r["total_windows"] == 0 and r["avg_cost_per_window"] == 0.0 and r["avg_cost_per_active_hour"] is None
