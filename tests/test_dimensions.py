"""Roster CSV merge, patches, team changes, aliases and masking."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from usagelens.operators import aliases, roster, teams
from usagelens.sources import roster_csv

AS_OF = dt.datetime(2024, 3, 1)
ROSTER = "email string, name string, role string, status string, seat_tier string, billing_model string, imported_at timestamp"


def lines(spark, text, file="r.csv"):
    rows = [(file, i, v) for i, v in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line int, value string")


def test_csv_parse_and_merge(spark):
    text = "\n".join([
        " name ,EMAIL,Billing Model,Seat Tier",
        "Ann, ann@x ,Enterprise,Premium",
        "",
        "Bob,bob@x,,Standard",
        " ,,seat,",
        "Ann2,ann@x,,",
        "Cy,cy@x,weird,",
    ])
    rows = roster_csv.parse_roster_lines(lines(spark, text))
    assert rows.count() == 4
    current = spark.createDataFrame([("bob@x", "B", "r", "s", "Premium", "enterprise", dt.datetime(2024, 1, 1)),
                                     ("zed@x", "Z", None, None, None, "seat", dt.datetime(2024, 1, 1))], ROSTER)
    out = {r["email"]: r for r in roster.merge_roster(current, rows, AS_OF).collect()}
    assert out["ann@x"]["name"] == "Ann2" and out["ann@x"]["billing_model"] == "enterprise"
    assert out["ann@x"]["seat_tier"] is None                       # overwritten by the last row's blank
    assert out["bob@x"]["billing_model"] == "enterprise"           # blank cell keeps the stored value
    assert out["bob@x"]["role"] is None and out["bob@x"]["imported_at"] == AS_OF
    assert out["cy@x"]["billing_model"] == "seat"
    assert out["zed@x"]["imported_at"] == dt.datetime(2024, 1, 1)
    assert roster.upserted_count(rows).first()[0] == 4


def test_csv_missing_email_column(spark):
    rows = roster_csv.parse_roster_lines(lines(spark, "name,role\nAnn,admin"))
    with pytest.raises(Exception, match="without an email column"):
        rows.collect()


def test_csv_file_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Email,Name\r\nx@y,X\r\n\r\n")
    rows = roster_csv.read_roster_csv(spark, str(tmp_path)).collect()
    assert [(r["email"], r["name"]) for r in rows] == [("x@y", "X")]


def test_several_files_in_order_and_a_large_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Email,Name\n" + "".join(f"u{i}@y,{'n' * 60}{i}\n" for i in range(20000)) + "x@y,first\n")
    (tmp_path / "b.csv").write_text("Name,Email\nsecond,x@y\n")
    (tmp_path / "c.csv").write_text("Email,Name\nz@y,Z\nu7@y,third\n")
    assert (tmp_path / "a.csv").stat().st_size > 1 << 20
    rows = roster_csv.read_roster_csv(spark, str(tmp_path))
    out = {r["email"]: r["name"] for r in roster.merge_roster(None, rows, AS_OF).collect()}
    assert len(out) == 20002 and out["x@y"] == "second" and out["u7@y"] == "third" and out["z@y"] == "Z"


def test_patches(spark):
    current = spark.createDataFrame([("a@x", "A", None, None, "Standard", "seat", dt.datetime(2024, 1, 1))], ROSTER)
    patches = spark.createDataFrame([
        (1, "a@x", "ENTERPRISE", None), (2, "a@x", None, "Premium"), (3, "a@x", "bad", "Standard"),
        (4, "n@x", None, None), (5, "n@x", None, "Standard"), (6, "USER-1", "seat", None)],
        "seq int, email string, billing_model string, seat_tier string")
    al = spark.createDataFrame([("al@x", "USER-1", AS_OF)], "email string, alias string, created_at timestamp")
    out = {r["email"]: r for r in roster.patch_roster(current, patches, AS_OF, al).collect()}
    assert (out["a@x"]["billing_model"], out["a@x"]["seat_tier"]) == ("enterprise", "Premium")
    assert (out["n@x"]["billing_model"], out["n@x"]["seat_tier"], out["n@x"]["imported_at"]) == ("seat", "Standard", AS_OF)
    assert out["al@x"]["billing_model"] == "seat"
    _, bad = roster.validate_patches(patches)
    assert sorted(r["seq"] for r in bad.collect()) == [3, 4]


def test_team_changes(spark):
    tm = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string").withColumn("created_at", F.lit(None).cast("timestamp"))
    members = spark.createDataFrame([(1, "x@x"), (2, "y@x")], "team_id bigint, user_email string")
    changes = spark.createDataFrame([
        (1, 1, " z@x ", "add"), (2, 1, "x@x", "remove"), (3, 1, "x@x", "add"), (4, 1, "z@x", "remove"),
        (5, 2, "w@x", "add"), (6, 2, None, "drop_team"), (7, 2, "v@x", "add"), (8, 9, "q@x", "add"),
        (9, 1, "", "add")], "seq bigint, team_id bigint, user_email string, op string")
    new_teams, new_members = teams.apply_team_changes(tm, members, changes)
    assert sorted(r["id"] for r in new_teams.collect()) == [1]
    assert sorted((r["team_id"], r["user_email"]) for r in new_members.collect()) == [(1, "x@x")]


def test_team_rosters(spark):
    tm = spark.createDataFrame([(1, "b"), (2, "a"), (3, "empty")], "id bigint, name string")
    members = spark.createDataFrame([(1, "z@x"), (1, "m@x"), (2, "q@x")], "team_id bigint, user_email string")
    got = [(r["name"], r["members"]) for r in teams.team_rosters(tm, members).collect()]
    assert got == [("a", ["q@x"]), ("b", ["m@x", "z@x"]), ("empty", [])]


def test_assign_aliases_continues_numbering(spark):
    current = spark.createDataFrame([("b@x", "USER-2", AS_OF), ("a@x", "USER-10", AS_OF)],
                                    "email string, alias string, created_at timestamp")
    ids = spark.createDataFrame([(e,) for e in ["d@x", "a@x", "c@x", "e@x", None, "c@x"]], "email string")
    out = {r["email"]: r["alias"] for r in aliases.assign_aliases(ids, current, AS_OF, n_ranges=3).collect()}
    assert out == {"b@x": "USER-2", "a@x": "USER-10", "c@x": "USER-11", "d@x": "USER-12", "e@x": "USER-13"}
    far = spark.createDataFrame([("a@x", "USER-2147483648", AS_OF)], "email string, alias string, created_at timestamp")
    assert {r["alias"] for r in aliases.new_aliases(ids, far, AS_OF).collect()} == {f"USER-{2147483648 + n}" for n in (1, 2, 3)}
    fresh = {r["email"]: r["alias"] for r in aliases.assign_aliases(ids, None, AS_OF).collect()}
    assert fresh == {"a@x": "USER-1", "c@x": "USER-2", "d@x": "USER-3", "e@x": "USER-4"}


def test_mask_and_natural_sort(spark, tables):
    from usagelens.operators import usage

    users = [r["user_email"] for r in usage.known_users(spark, tables, masked=True).collect()]
    nums = [int(u[5:]) for u in users if u.startswith("USER-")]
    assert nums == sorted(nums) and nums
    df = spark.createDataFrame([("a@x", "Ann"), ("b@x", "Bob")], "user_email string, name string")
    al = spark.createDataFrame([("a@x", "USER-1")], "email string, alias string")
    got = sorted((r["user_email"], r["name"]) for r in aliases.mask(df, al, cols=("user_email", "name")).collect())
    assert got == [("USER-1", "USER-1"), ("b@x", "Bob")]
    strict = sorted(str(r["user_email"]) for r in aliases.mask(df, al, strict=True).collect())
    assert strict == ["None", "USER-1"]


def test_alias_lookup_and_new_ids(spark):
    from usagelens.sources import invocations

    df = spark.createDataFrame([("a@x", 1), ("b@x", 2), (None, 3)], "user_email string, n int")
    al = spark.createDataFrame([("a@x", "USER-1")], "email string, alias string")
    assert {r["n"]: r["alias"] for r in aliases.alias_lookup(df, al).collect()} == {1: "USER-1", 2: None, 3: None}
    new = spark.createDataFrame([("r1",), ("r2",)], "aws_request_id string")
    old = spark.createDataFrame([("r1",), (None,)], "aws_request_id string")
    assert [r[0] for r in invocations.new_ids_only(new, old).collect()] == ["r2"]
