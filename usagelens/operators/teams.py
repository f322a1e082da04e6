"""Teams: membership changes and rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.aliases import mask
from usagelens.operators.filters import unmask


def apply_team_changes(teams: DataFrame, members: DataFrame, changes: DataFrame,
                       aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K3: apply (seq, team_id, user_email, op) changes as if in ``seq``
    order, set-based. ``op`` is add | remove | drop_team.

    * drop_team removes the team and all its memberships; later changes to
      that team fail (it no longer exists);
    * add needs an existing team, ignores duplicates, trims the email and
      resolves an alias; blank emails are rejected;
    * per (team, email) the last add/remove decides membership.
    Returns (teams, team_members).
    """
    ch = changes.withColumn("user_email", F.trim("user_email"))
    if aliases is not None:
        ch = unmask(ch, "user_email", aliases)
    drops = ch.filter(F.col("op") == "drop_team").groupBy("team_id").agg(F.min("seq").alias("_drop_seq"))
    live_teams = teams.join(drops, teams["id"] == drops["team_id"], "left_anti")
    tids = teams.select(F.col("id").alias("_tid"))
    d = drops.withColumnRenamed("team_id", "_dtid")
    edits = (
        ch.filter(F.col("op").isin("add", "remove") & F.col("user_email").isNotNull() & (F.col("user_email") != ""))
        .join(tids, F.col("team_id") == F.col("_tid"), "left_semi")
        .join(d, F.col("team_id") == F.col("_dtid"), "left")
        .filter(F.col("_drop_seq").isNull() | (F.col("seq") < F.col("_drop_seq")))
    )
    last = edits.groupBy("team_id", "user_email").agg(F.max_by("op", "seq").alias("_op"))
    keep = members.join(last.select("team_id", "user_email"), ["team_id", "user_email"], "left_anti")
    added = last.filter(F.col("_op") == "add").select("team_id", "user_email")
    new_members = keep.unionByName(added).distinct().join(
        d, F.col("team_id") == F.col("_dtid"), "left_anti")
    return live_teams, new_members


def team_rosters(teams: DataFrame, members: DataFrame, aliases: DataFrame | None = None,
                 masked: bool = False, nested: bool = True) -> DataFrame:
    """Every team (also empty ones) with its members. ``nested`` gives
    a members array sorted by email; otherwise one row per membership
    (NULL member for an empty team)."""
    m = members
    if masked:
        m = mask(m, aliases)
    j = teams.join(m, teams["id"] == m["team_id"], "left").select(
        teams["id"], teams["name"], m["user_email"].alias("member"))
    if not nested:
        return j.orderBy("name", "member")
    return j.groupBy("id", "name").agg(
        F.array_sort(F.collect_list("member")).alias("members")).orderBy("name")
