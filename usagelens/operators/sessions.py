"""Session list (E10) and per-prompt session timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.aliases import mask
from usagelens.operators.filters import apply_filters
from usagelens.params import Filters, Tables

DEFAULT_SESSIONS_LIMIT = 100


def sessions(spark: SparkSession, t: Tables, f: Filters, limit: int | None = DEFAULT_SESSIONS_LIMIT) -> DataFrame:
    """Per session (NULL is a group), newest first, top ``limit``.
    user_email is the user of the session's first request; models are the
    distinct models, sorted, comma-joined (NULL when none)."""
    r = apply_filters(spark, t.api_requests, t, f)
    out = r.groupBy("session_id").agg(
        F.min_by("user_email", F.struct("timestamp", "id")).alias("user_email"),
        F.min("timestamp").alias("started"),
        F.max("timestamp").alias("ended"),
        F.count(F.lit(1)).alias("requests"),
        F.sum("cost_usd").alias("cost"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.nullif(F.concat_ws(",", F.sort_array(F.collect_set("model"))), F.lit("")).alias("models"),
    )
    out = out.orderBy(F.desc("started"), F.asc_nulls_first("session_id"))
    if limit is not None:
        out = out.limit(limit)
    if f.masked:
        out = mask(out, t.user_aliases).orderBy(F.desc("started"), F.asc_nulls_first("session_id"))
    return out


def _timeline_rows(t: Tables, session_ids=None) -> DataFrame:
    """Prompts, requests and tools of the selected sessions as one tagged
    row set (kind 0/1/2), so a single aggregation builds every entry."""
    def sel(df):
        df = df.filter(F.col("session_id").isNotNull())
        if session_ids is not None:
            ids = [session_ids] if isinstance(session_ids, str) else list(session_ids)
            df = df.filter(F.col("session_id").isin(ids))
        return df

    def n(tp):
        return F.lit(None).cast(tp)

    p = sel(t.user_prompts).select(
        F.lit(0).alias("kind"), "session_id", "prompt_id", "timestamp", "id",
        "prompt_content", "prompt_length", n("string").alias("response_content"), n("string").alias("model"),
        n("double").alias("cost_usd"), n("bigint").alias("input_tokens"), n("bigint").alias("output_tokens"),
        n("bigint").alias("duration_ms"), n("string").alias("tool_name"), n("int").alias("success"),
        n("string").alias("error"))
    r = sel(t.api_requests).select(
        F.lit(1).alias("kind"), "session_id", "prompt_id", "timestamp", "id",
        n("string").alias("prompt_content"), n("bigint").alias("prompt_length"), "response_content", "model",
        "cost_usd", "input_tokens", "output_tokens", "duration_ms", n("string").alias("tool_name"),
        n("int").alias("success"), n("string").alias("error"))
    tl = sel(t.tool_uses).select(
        F.lit(2).alias("kind"), "session_id", "prompt_id", "timestamp", "id",
        n("string").alias("prompt_content"), n("bigint").alias("prompt_length"), n("string").alias("response_content"),
        n("string").alias("model"), n("double").alias("cost_usd"), n("bigint").alias("input_tokens"),
        n("bigint").alias("output_tokens"), "duration_ms", "tool_name", "success", "error")
    return p.unionByName(r).unionByName(tl)


def session_timeline(t: Tables, session_ids=None, nested: bool = True) -> DataFrame:
    """One entry per (session, prompt_id); prompt_id NULL is a key.

    * prompt fields come from the session's last prompt of that id;
    * response/model from the last request (even when NULL), sums of cost,
      tokens and duration over all its requests (NULL counts 0);
    * entries without a prompt take the first request's timestamp;
    * tools attach (in time order) only to entries that exist.

    ``nested=True`` adds the ``tools`` array (bounded by one prompt's tool
    calls); ``nested=False`` gives tool counts instead, for unbounded data.
    The rows of a session lie together, ordered by time, prompts before
    request-only entries (sorted within the partitions: no global sort).
    """
    u = _timeline_rows(t, session_ids)
    k = F.col("kind")
    order = F.struct("timestamp", "id")
    aggs = [
        # The kinds present (at most 3 values). Being a typed aggregate it
        # also lets Spark run the whole aggregation hash-based (struct-valued
        # max_by alone would force a sort-based aggregate).
        F.collect_set("kind").alias("_kinds"),
        F.max_by(F.struct("timestamp", "prompt_content", "prompt_length"), F.when(k == 0, order)).alias("_p"),
        F.max_by(F.struct("response_content", "model"), F.when(k == 1, order)).alias("_r"),
        F.min(F.when(k == 1, F.col("timestamp"))).alias("_first_req"),
        F.sum(F.when(k == 1, F.coalesce("cost_usd", F.lit(0.0))).otherwise(0.0)).alias("cost_usd"),
        F.sum(F.when(k == 1, F.coalesce("input_tokens", F.lit(0))).otherwise(0)).cast("bigint").alias("input_tokens"),
        F.sum(F.when(k == 1, F.coalesce("output_tokens", F.lit(0))).otherwise(0)).cast("bigint").alias("output_tokens"),
        F.sum(F.when(k == 1, F.coalesce("duration_ms", F.lit(0))).otherwise(0)).cast("bigint").alias("duration_ms"),
        F.count_if(k == 2).alias("tool_count"),
        F.count_if((k == 2) & (F.col("success") == 0)).alias("tool_failures"),
    ]
    if nested:
        aggs.append(F.array_sort(F.collect_list(F.when(k == 2, F.struct(
            "timestamp", "id", "tool_name", "success", "duration_ms", "error")))).alias("_tools"))
    g = u.groupBy("session_id", "prompt_id").agg(*aggs).filter(
        F.array_contains("_kinds", 0) | F.array_contains("_kinds", 1))
    has_prompt = F.array_contains("_kinds", 0)
    cols = [
        "session_id", "prompt_id",
        F.when(has_prompt, F.col("_p.timestamp")).otherwise(F.col("_first_req")).alias("timestamp"),
        F.col("_p.prompt_content").alias("prompt"),
        F.col("_p.prompt_length").alias("prompt_length"),
        F.col("_r.response_content").alias("response"),
        F.col("_r.model").alias("model"),
        "cost_usd", "input_tokens", "output_tokens", "duration_ms",
        has_prompt.alias("has_prompt"),
    ]
    if nested:
        cols.append(F.transform("_tools", lambda x: F.struct(
            x["tool_name"].alias("tool_name"), x["success"].alias("success"),
            x["duration_ms"].alias("duration_ms"), x["error"].alias("error"))).alias("tools"))
    else:
        cols += ["tool_count", "tool_failures"]
    return g.select(*cols).repartition("session_id").sortWithinPartitions(
        "session_id", "timestamp", F.desc("has_prompt"), "prompt_id")


def session_timeline_tools(t: Tables, session_ids=None) -> DataFrame:
    """The tool rows attached to timeline entries, one row each (the flat
    form of the nested ``tools`` arrays)."""
    u = _timeline_rows(t, session_ids)
    entries = (u.filter(F.col("kind") < 2).select("session_id", "prompt_id").distinct()
               .withColumnRenamed("session_id", "_s").withColumnRenamed("prompt_id", "_p"))
    tools = u.filter(F.col("kind") == 2)
    return tools.join(
        entries, (tools["session_id"] == entries["_s"]) & tools["prompt_id"].eqNullSafe(entries["_p"]), "left_semi"
    ).select("session_id", "prompt_id", "timestamp", "id", "tool_name", "success", "duration_ms", "error")


def session_conversation(t: Tables, session_id: str) -> DataFrame:
    """The reference's single-session response: one row with the ordered
    conversation array (bounded by one session)."""
    e = session_timeline(t, session_id, nested=True)
    return e.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "timestamp", (~F.col("has_prompt")).alias("_rank"), "prompt_id", "prompt", "prompt_length",
            "response", "model", "cost_usd", "input_tokens", "output_tokens", "duration_ms", "tools"))).alias("conversation"))
