"""OTLP JSON log ingest (A1, A2 transform, B1-B20).

A payload is ``{resourceLogs: [{resource: {attributes}, scopeLogs:
[{logRecords: [...]}]}]}``; every level may also be snake_case. One fixed
schema covers both spellings (no schema inference) and the whole transform is
narrow: the payload is cut into records by three posexplodes, each record is
parsed once, maps are built, five projections follow -- no shuffle, and no row
holds more than one record and its resource.

Attribute values keep JavaScript semantics: each attribute becomes
``struct(v, f)`` where ``v`` is the first of string/int/double/bool value
(camelCase before snake_case) or the value's JSON, and ``f`` marks values
JavaScript treats as falsy ('' , numeric 0 from doubleValue, false), so both
``a ?? b`` (first present) and ``a || b`` (first truthy) can be expressed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.jsvalues import to_int, to_num
from usagelens.session import configure

S = T.StringType()


def _st(*names, t=S) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n in names])


# OTLP AnyValue kinds in the order the value is chosen, then
# the structured kinds (kept as raw JSON text).
SCALAR_KINDS = ["stringValue", "string_value", "intValue", "int_value",
                "doubleValue", "double_value", "boolValue", "bool_value"]
OTHER_KINDS = ["arrayValue", "array_value", "kvlistValue", "kvlist_value", "bytesValue", "bytes_value"]
CORRUPT = "_corrupt_record"

ANY_VALUE = _st(*SCALAR_KINDS, *OTHER_KINDS)
ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("key", S), T.StructField("value", ANY_VALUE)]))
BODY = _st("stringValue", "string_value")
LOG_RECORD = T.StructType([
    *[T.StructField(n, S) for n in ("timeUnixNano", "time_unix_nano", "observedTimeUnixNano",
                                    "observed_time_unix_nano")],
    T.StructField("body", BODY),
    T.StructField("attributes", ATTRIBUTES),
])
RESOURCE = T.StructType([T.StructField("attributes", ATTRIBUTES)])
# Whole payloads are only cut up: a resource and a record stay JSON text until
# they stand alone in a row.
SCOPE_LOGS = _st("logRecords", "log_records", t=T.ArrayType(S))
RESOURCE_LOGS = T.StructType([T.StructField("resource", S), T.StructField("scopeLogs", T.ArrayType(SCOPE_LOGS)),
                              T.StructField("scope_logs", T.ArrayType(SCOPE_LOGS))])
PAYLOAD = T.StructType([*_st("resourceLogs", "resource_logs", t=T.ArrayType(RESOURCE_LOGS)).fields, T.StructField(CORRUPT, S)])

# Event names routed to the five fact tables.
EVENT_PREFIX = "claude_code."
DEFAULT_SOURCE = "claude_code"
# Attribute keys of the wire format, in the order they are tried.
MODEL_KEYS = ["gen_ai.request.model", "model", "modelID", "model_id"]
COST_KEYS = ["cost_usd", "cost", "cost.usd", "claude_code.cost.usage"]
INPUT_KEYS = ["gen_ai.usage.input_tokens", "input_tokens", "llm.usage.prompt_tokens", "gen_ai.usage.prompt_tokens",
              "tokens.input", "input"]
OUTPUT_KEYS = ["gen_ai.usage.output_tokens", "output_tokens", "llm.usage.completion_tokens",
               "gen_ai.usage.completion_tokens", "tokens.output", "output"]
CACHE_READ_KEYS = ["cache_read_input_tokens", "gen_ai.usage.cache_read_input_tokens", "cache_read_tokens", "tokens.cacheRead"]
CACHE_CREATION_KEYS = ["cache_creation_input_tokens", "gen_ai.usage.cache_creation_input_tokens", "cache_creation_tokens",
                       "tokens.cacheCreation"]
DURATION_KEYS = ["duration_ms", "duration"]
RESPONSE_KEYS = ["response.content", "gen_ai.response.content"]
TOOL_KEYS = ["tool.name", "tool_name"]
TOOL_DURATION_KEYS = ["tool.duration_ms", "duration_ms"]
PROMPT_LENGTH_KEYS = ["prompt.length", "prompt_length"]
PROMPT_KEYS = ["prompt", "prompt.content"]
USER_ID_KEYS = ["user.id", "user.account_uuid"]
# Event name -> fact table.
EVENTS = {
    "api_request": "api_requests",
    "tool_result": "tool_uses",
    "user_prompt": "user_prompts",
    "api_error": "api_errors",
    "tool_decision": "tool_decisions",
}


# Fixed value: the largest distance from the epoch a JavaScript date can have.
MAX_MS = 8_640_000_000_000_000


# ── attribute maps ──────────────────────────────────────────────────────────
# Each attribute's JavaScript value is computed once, when the map is built
# (one ``transform`` over the values); lookups are then plain map probes.
# Measured alternatives (rules applied at every lookup, or values parsed as
# maps) generate far larger code and ran 2-3x slower.
def _any(arr: Column, test) -> Column:
    return F.coalesce(F.exists(arr, test), F.lit(False))


def _unread(v: Column) -> Column:
    """A value that the AnyValue schema could not hold: an unknown kind, or not
    an object (the parser leaves every field, or the struct itself, NULL)."""
    return v.isNull() | F.coalesce(*[v[k] for k in SCALAR_KINDS + OTHER_KINDS]).isNull()


def _raw_value(text: Column, i: Column) -> Column:
    """JSON of the i-th attribute's value, from the text of its record or
    resource (only read for values that the schema could not hold); NULL if it
    has none."""
    raw = F.call_function("get_json_object", text, F.concat(F.lit("$.attributes["), i.cast("string"), F.lit("].value")))
    return F.when(raw.rlike(r"^([\[{].*|-?[0-9][0-9.eE+-]*|true|false)$"), raw).otherwise(F.concat(F.lit('"'), raw, F.lit('"')))


def _attr_value(v: Column, raw: Column) -> Column:
    """struct(v, f) for one AnyValue (B3): ``v`` is the first of string,
    int, double, bool (camelCase before snake_case) or the value's JSON
    (``raw`` where the schema could not hold it); ``f`` marks values JavaScript
    treats as falsy ('', numeric 0 from doubleValue, false); intValue keeps its
    string encoding ('0' truthy)."""
    s = F.coalesce(v["stringValue"], v["string_value"])
    i = F.coalesce(v["intValue"], v["int_value"])
    d = F.coalesce(v["doubleValue"], v["double_value"])
    b = F.coalesce(v["boolValue"], v["bool_value"])
    structured = [F.concat(F.lit('{"' + k + '":'), v[k], F.lit("}")) for k in OTHER_KINDS]
    val = F.coalesce(s, i, d, b, *structured, raw)
    falsy = (
        F.when(s.isNotNull(), s == "")
        .when(i.isNotNull(), F.lit(False))
        .when(d.isNotNull(), F.coalesce(d.try_cast("double") == 0, F.lit(False)))
        .when(b.isNotNull(), b == "false")
        .otherwise(F.lit(False))
    )
    return F.struct(val.alias("v"), falsy.alias("f"))


def attr_map(attrs: Column, text: Column | None = None) -> Column:
    """Attribute list -> map<key, struct(v, f)>; a repeated key keeps
    the last value (session conf mapKeyDedupPolicy=LAST_WIN). NULL when an
    attribute has no key (malformed; such records are quarantined). ``text``:
    the JSON object whose ``attributes`` these are, for values kept as JSON."""
    a = F.coalesce(attrs, F.array().cast(ATTRIBUTES))

    def value(v, i):
        raw = F.lit(None).cast("string") if text is None else F.when(_unread(v), _raw_value(text, i))
        return _attr_value(v, raw)

    return F.when(~_any(a["key"], lambda k: k.isNull()), F.map_from_arrays(a["key"], F.transform(a["value"], value)))


def malformed_attrs(attrs: Column, m: Column) -> Column:
    """An attribute without a key or without a value (the reference throws);
    ``m`` is the list's map."""
    a = F.coalesce(attrs, F.array().cast(ATTRIBUTES))
    return m.isNull() | (_any(a["value"], lambda v: v.isNull()) & _any(F.map_values(m), lambda e: e["v"].isNull()))


ATTR_MAP = T.MapType(S, T.StructType([T.StructField("v", S), T.StructField("f", T.BooleanType())]))


def merge_attrs(resource: Column, record: Column) -> Column:
    """Resource attributes overlaid by record attributes."""
    empty = F.create_map().cast(ATTR_MAP)
    return F.map_concat(F.coalesce(resource, empty), F.coalesce(record, empty))


def present(m: Column, keys: list[str]) -> Column:
    """``a[k1] ?? a[k2] ?? ...`` over the attribute map."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k))["v"] for k in keys])


def truthy(m: Column, keys: list[str]) -> Column:
    """``a[k1] || a[k2] || ... || null`` over the attribute map."""
    out = []
    for k in keys:
        e = F.try_element_at(m, F.lit(k))
        out.append(F.when(~e["f"], e["v"]))
    return F.coalesce(*out)


def _first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def nanos_to_ts(nanos: Column, as_of: dt.datetime | Column | None) -> Column:
    """Epoch nanoseconds (text) -> timestamp truncated to ms; missing
    -> ``as_of`` (the reference uses the arrival time; None = the batch's
    processing time)."""
    ms = F.floor(nanos.try_cast("decimal(30,0)") / F.lit(1_000_000)).try_cast("bigint")
    ms = F.when(F.abs(ms) <= MAX_MS, ms)  # beyond that no timestamp can hold it
    if as_of is None:
        fallback = F.current_timestamp()
    elif isinstance(as_of, Column):
        fallback = as_of
    else:
        fallback = F.lit(as_of).cast("timestamp")
    return F.coalesce(F.timestamp_millis(ms), fallback)


def otlp_schema() -> T.StructType:
    """B1: the payload schema (camelCase and snake_case at every level)."""
    return PAYLOAD


def event_name(body: Column, record_attrs: Column) -> Column:
    """Non-empty body.stringValue, else body.string_value, else the
    record's own ``event.name`` attribute (not the resource's), else ''."""
    return F.coalesce(_first_nonempty(body["stringValue"], body["string_value"]),
                      truthy(record_attrs, ["event.name"]), F.lit(""))


def identity_cols(attrs: Column) -> list[Column]:
    """Session, prompt, user and organisation columns (empty -> NULL)."""
    return [
        truthy(attrs, ["session.id"]).alias("session_id"),
        truthy(attrs, ["prompt.id"]).alias("prompt_id"),
        truthy(attrs, ["user.email"]).alias("user_email"),
        truthy(attrs, USER_ID_KEYS).alias("user_id"),
        truthy(attrs, ["organization.id"]).alias("org_id"),
    ]


def canonical_event(name: Column) -> Column:
    """Drop the leading product prefix of the event name."""
    return F.regexp_replace(name, "^" + EVENT_PREFIX.replace(".", r"\."), "")


def source_of(attrs: Column) -> Column:
    """Service.name with '-' -> '_', default 'claude_code'."""
    return F.coalesce(F.translate(truthy(attrs, ["service.name"]), "-", "_"), F.lit(DEFAULT_SOURCE))


# Why a payload or record is quarantined.
BAD_JSON, NO_VALUE = "invalid JSON", "attribute without value"


# ── flatten ─────────────────────────────────────────────────────────────────
def _resources(p: Column) -> Column:
    return F.coalesce(p["resourceLogs"], p["resource_logs"])


def _scopes(rl: Column) -> Column:
    return F.coalesce(rl["scopeLogs"], rl["scope_logs"])


def _records(sl: Column) -> Column:
    return F.coalesce(sl["logRecords"], sl["log_records"])


def _once(value: Column) -> Column:
    """A value out of a generator: computed once a row, whatever reads it."""
    return F.explode_outer(F.array(value))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """(file, value[, block, row]) -> (file, block, row, content, p, bad_json,
    text). ``value`` is one payload, ``content`` its hash; text that is not JSON
    lands in the corrupt-record field (no second parse). ``text`` is kept of
    payloads that are no JSON or hold a single record, which make one row."""
    none = F.lit(None).cast("bigint")
    place = [F.col(c) if c in payloads.columns else none.alias(c) for c in ("block", "row")]
    p = payloads.select("file", *place, "value", _once(F.struct(
        F.from_json("value", PAYLOAD, {"columnNameOfCorruptRecord": CORRUPT}).alias("p"), F.xxhash64("value").alias("content"))).alias("once"))
    all_ = _resources(F.col("once.p"))
    bad = F.col("once.p").isNull() | (all_.isNull() & F.col(f"once.p.{CORRUPT}").isNotNull())
    scopes = _scopes(F.get(all_, F.lit(0)))
    single = (F.size(all_) == 1) & (F.size(scopes) == 1) & (F.size(_records(F.get(scopes, F.lit(0)))) == 1)
    return p.select("file", "block", "row", "once.content", all_.alias("resources"), bad.alias("bad_json"), F.when(bad | single, F.col("value")).alias("text"))


def flatten_records(parsed: DataFrame) -> DataFrame:
    """B2: resourceLogs -> scopeLogs -> logRecords (empty levels give no
    rows). Text that is not JSON gives one row without a record, so that it
    reaches the quarantine in the same pass.

    A row holds its own record, its resource and its place, nothing of the rest
    of the payload: a generator buffers all rows of a payload, so anything
    larger would count once for each of its records."""
    bad = F.col("bad_json")
    keep = ["file", "block", "row", "content", "bad_json", "text"]

    def level(elements):
        return F.posexplode(F.when(bad, F.array(F.lit(None))).otherwise(elements))

    rl = parsed.select(*keep, level(F.col("resources")).alias("rl_pos", "rl"))
    rl = rl.select(*keep, "rl_pos", F.col("rl.resource").alias("resource"), _scopes(F.col("rl")).alias("scopes"))
    rl = rl.select(*keep, "rl_pos", "resource", "scopes", _once(F.from_json("resource", RESOURCE)["attributes"]).alias("attributes"))
    rl = rl.select(*keep, "rl_pos", "resource", "scopes", "attributes", _once(attr_map(F.col("attributes"), F.col("resource"))).alias("map"))
    rl = rl.select(*keep, "rl_pos", "resource", "scopes", "map", malformed_attrs(F.col("attributes"), F.col("map")).alias("res_bad"))
    keep += ["rl_pos", "resource", "map", "res_bad"]
    sl = rl.select(*keep, level(F.col("scopes")).alias("sl_pos", "sl")).select(*keep, "sl_pos", _records(F.col("sl")).alias("records"))
    keep += ["sl_pos"]
    rec = sl.select(*keep, level(F.col("records")).alias("rec_pos", "record"))
    return rec.select(*keep, "rec_pos", "record", _once(F.from_json("record", LOG_RECORD)).alias("rec"))


def normalize_records(records: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row per log record with the event, timestamp, merged
    attributes, source and identity columns. ``reason`` says why a row is
    quarantined (NULL: it is not). ``payload`` then holds a payload with this
    record alone (the payload itself, if it has no other), so that a mended
    record can be sent again without the rest.

    ``id`` hashes the file, the payload's content and the place inside the
    payload: it does not depend on how the file was split (a payload line that
    is repeated in one file repeats its ids). ``ingest_seq`` is the arrival
    order. The maps come out of a generator, so each is built once and not
    inlined into every expression that looks something up."""
    recs = records.select("*", _once(attr_map(F.col("rec.attributes"), F.col("record"))).alias("own"))
    no_value = malformed_attrs(F.col("rec.attributes"), F.col("own")) | F.col("res_bad")
    reason = F.when(F.col("bad_json"), BAD_JSON).when(no_value, NO_VALUE)
    recs = recs.withColumn("reason", reason).withColumn("attrs", _once(merge_attrs(F.col("map"), F.col("own"))))
    alone = F.concat(F.lit('{"resourceLogs":[{"resource":'), F.coalesce("resource", F.lit("{}")), F.lit(',"scopeLogs":[{"logRecords":['),
                     F.coalesce("record", F.lit("null")), F.lit("]}]}]}"))
    name = event_name(F.col("rec.body"), F.col("own"))
    nanos = _first_nonempty(F.col("rec.timeUnixNano"), F.col("rec.time_unix_nano"),
                            F.col("rec.observedTimeUnixNano"), F.col("rec.observed_time_unix_nano"))
    at = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    out = recs.select(
        F.xxhash64("file", "content", "rl_pos", "sl_pos", "rec_pos").alias("id"),
        F.struct("file", F.col("content").alias("payload"), "rl_pos", "sl_pos", "rec_pos").alias("ingest_pos"),
        F.struct(at.alias("at"), "file", "block", "row", F.col("rl_pos").alias("rl"), F.col("sl_pos").alias("sl"),
                 F.col("rec_pos").alias("rec")).alias("ingest_seq"),
        nanos_to_ts(nanos, as_of).alias("timestamp"),
        name.alias("event_name"),
        "attrs",
        "reason",
        F.col("reason").isNotNull().alias("quarantined"),
        F.when(F.col("reason").isNotNull(), F.coalesce(F.col("text"), alone)).alias("payload"),
    )
    a = F.col("attrs")
    return out.select("*", canonical_event(F.col("event_name")).alias("event"), source_of(a).alias("source"),
                      *identity_cols(a))


def flatten_otlp(payloads: DataFrame, as_of: dt.datetime) -> DataFrame:
    """A1 transform shared by batch and streaming: payload text -> records."""
    return normalize_records(flatten_records(parse_payloads(payloads)), as_of)


def read_otlp(spark: SparkSession, path: str, as_of: dt.datetime, one_per_file: bool = False) -> DataFrame:
    """A1: OTLP payload files. Default one payload per line (NDJSON);
    ``one_per_file`` reads each file as one payload (a request body is at
    most 10 MB in the reference, which bounds that task)."""
    configure(spark)
    reader = spark.read.option("wholetext", True) if one_per_file else spark.read
    return flatten_otlp(with_place(reader.text(path)), as_of)


def with_place(lines: DataFrame) -> DataFrame:
    """(file, block, row, value) of text lines: where each was read. Within a
    file, (block, row) follows the order of the lines, however it is split."""
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"), "value")


def quarantine(payloads: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rejected input with its text: payloads that are not JSON, records with
    an attribute lacking a value."""
    return quarantined(flatten_otlp(payloads, as_of))


def quarantined(records: DataFrame) -> DataFrame:
    """The quarantined rows among ``records``: file, reason, id, payload (what was
    rejected can be replayed from it)."""
    return records.filter("quarantined").select(F.col("ingest_pos.file").alias("file"), "reason", "id", "payload")


# ── routing and projections ─────────────────────────────────────────────────
def _common() -> list[Column]:
    return [F.col(c) for c in ("id", "ingest_seq", "timestamp", "session_id", "prompt_id", "user_email", "user_id", "org_id")]


def _usage(a: Column) -> list[Column]:
    """cost, input and output tokens of an api_request (B11 fallbacks)."""
    return [
        to_num(present(a, COST_KEYS)).alias("cost_usd"),
        to_int(present(a, INPUT_KEYS)).alias("input_tokens"),
        to_int(present(a, OUTPUT_KEYS)).alias("output_tokens"),
    ]


def to_api_requests(df: DataFrame) -> DataFrame:
    """B11."""
    a = F.col("attrs")
    return df.select(
        *_common(),
        truthy(a, MODEL_KEYS).alias("model"),
        *_usage(a),
        to_int(present(a, CACHE_READ_KEYS)).alias("cache_read_tokens"),
        to_int(present(a, CACHE_CREATION_KEYS)).alias("cache_creation_tokens"),
        to_int(present(a, DURATION_KEYS)).alias("duration_ms"),
        truthy(a, ["app.version"]).alias("app_version"),
        truthy(a, ["terminal.type"]).alias("terminal_type"),
        truthy(a, RESPONSE_KEYS).alias("response_content"),
        "source",
        F.lit(None).cast("string").alias("aws_request_id"),
    )


def to_tool_uses(df: DataFrame) -> DataFrame:
    """B12."""
    a = F.col("attrs")
    return df.select(
        *_common(),
        truthy(a, TOOL_KEYS).alias("tool_name"),
        F.when(present(a, ["tool.success"]) == "true", 1).otherwise(0).alias("success"),
        to_int(truthy(a, TOOL_DURATION_KEYS)).alias("duration_ms"),
        truthy(a, ["tool.error"]).alias("error"),
    )


def to_user_prompts(df: DataFrame) -> DataFrame:
    """B13."""
    a = F.col("attrs")
    return df.select(
        *_common(),
        to_int(present(a, PROMPT_LENGTH_KEYS)).alias("prompt_length"),
        truthy(a, PROMPT_KEYS).alias("prompt_content"),
    )


def to_api_errors(df: DataFrame) -> DataFrame:
    """B14."""
    a = F.col("attrs")
    return df.select(
        *_common(),
        truthy(a, ["error.message"]).alias("error_message"),
        to_int(present(a, ["http.status_code"])).alias("status_code"),
        to_int(present(a, ["retry.count"])).alias("retries"),
    )


def to_tool_decisions(df: DataFrame) -> DataFrame:
    """B15."""
    a = F.col("attrs")
    return df.select(
        *_common(),
        truthy(a, ["tool.name"]).alias("tool_name"),
        truthy(a, ["tool.decision"]).alias("decision"),
    )


PROJECTIONS = {
    "api_requests": to_api_requests,
    "tool_uses": to_tool_uses,
    "user_prompts": to_user_prompts,
    "api_errors": to_api_errors,
    "tool_decisions": to_tool_decisions,
}


def route(records: DataFrame) -> dict[str, DataFrame]:
    """The five fact tables; unknown events are dropped."""
    ok = records.filter(~F.col("quarantined"))
    return {table: PROJECTIONS[table](ok.filter(F.col("event") == ev)) for ev, table in EVENTS.items()}


def ingest_otlp(records: DataFrame, root: str, ingest: str | None = None) -> str:
    """A1 -> A7: ``records`` into the five fact tables below ``root``. The
    payloads are parsed once; the tables are written from the kept records."""
    from usagelens.sources.facts import write_facts

    kept = records.persist()
    try:
        return write_facts(route(kept), root, ingest)
    finally:
        kept.unpersist()


# ── diagnostics ─────────────────────────────────────────────────────────────
def ingest_counts(records: DataFrame) -> DataFrame:
    """Stored records per target table (unknown events store 0)."""
    known = F.create_map(*[x for ev, tb in EVENTS.items() for x in (F.lit(ev), F.lit(tb))])
    return (records.filter(~F.col("quarantined"))
            .select(F.coalesce(F.try_element_at(known, F.col("event")), F.lit("(unknown)")).alias("target"))
            .groupBy("target").agg(F.count(F.lit(1)).alias("records")))


def missing_usage_report(records: DataFrame) -> DataFrame:
    """api_request records with no cost, input or output tokens, per
    source and attribute-key set."""
    r = records.filter((F.col("event") == "api_request") & ~F.col("quarantined"))
    u = r.select("source", "attrs", *_usage(F.col("attrs")))
    miss = u.filter(F.col("cost_usd").isNull() & F.col("input_tokens").isNull() & F.col("output_tokens").isNull())
    return miss.groupBy("source", F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attribute_keys")).agg(
        F.count(F.lit(1)).alias("records"))


def attribute_profile(records: DataFrame) -> DataFrame:
    """Attribute keys seen on api_request records per service.name,
    with and without user.email."""
    r = records.filter((F.col("event") == "api_request") & ~F.col("quarantined"))
    svc = F.try_element_at(F.col("attrs"), F.lit("service.name"))["v"]
    has_email = F.try_element_at(F.col("attrs"), F.lit("user.email")).isNotNull()
    return r.select(svc.alias("service_name"), has_email.alias("_e"), F.explode(F.map_keys("attrs")).alias("key")) \
        .groupBy("service_name", "key").agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if("_e").alias("with_email"),
            F.count_if(~F.col("_e")).alias("without_email"))
