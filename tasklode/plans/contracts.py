"""Queries that hold single operators against their DuckDB twins, over the driver's tables in the operators' roles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tasklode.functions.text import action_kind, contains_argument, file_component, log_value, looks_like_product, normalize_action
from tasklode.operators import attempts, audit, catalog, checks, dataset, gates, lineage, profiling, rewards, sampling, scheduling
from tasklode.plans.registry import ORACLE_SQL, query, six
from tasklode.session import shared_folder, table
from tasklode.sources import sinks


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


# --- sets and lookups -----------------------------------------------------------------------------


@query("""
SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return checks.set_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""
SELECT count(*) = 0 AS equal FROM ((SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) UNION ALL (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation))""")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    return checks.sets_equal(table(spark, sf, "nation"), table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def overlap_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.overlap(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def unique_match(spark: SparkSession, sf: str) -> DataFrame:
    out = checks.unique_match(table(spark, sf, "nation"), table(spark, sf, "region"), "n_regionkey", "r_regionkey")
    return out.select("n_nationkey", F.col("match.r_name").alias("r_name"))


@query("""
SELECT c_custkey, coalesce(o.status, '') AS status, coalesce(o.priority, '') AS priority, coalesce(o.first_order, '') AS first_order FROM customer
LEFT JOIN (SELECT o_custkey, first(o_orderstatus ORDER BY o_orderkey) AS status, first(o_orderpriority ORDER BY o_orderkey) AS priority, first(o_orderkey::VARCHAR ORDER BY o_orderkey) AS first_order
  FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def metadata_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the fields of their first order: keys repeat, and all fields are of one row."""
    meta = _orders(spark, sf).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("first_order"))
    return checks.enriched(table(spark, sf, "customer").select("c_custkey"), meta, "c_custkey", ["status", "priority", "first_order"], ["o_orderkey"])


@query("""
SELECT count(*) AS n, sha256(string_agg(r_regionkey::VARCHAR, chr(10) ORDER BY r_regionkey)) AS task_ids_sha256, count(*) = 5
  AND string_agg(r_regionkey::VARCHAR, ',' ORDER BY r_regionkey) = '0,1,2,3,4' AS holds FROM region""")
def fixed_list(spark: SparkSession, sf: str) -> DataFrame:
    return checks.fixed_set(table(spark, sf, "region"), "r_regionkey", "r_regionkey", 5, "2965d24b80b4f692ecd619cf932ebd8bcefbf39e062b0fbb079eaa01b0e2b00a")


@query("SELECT p_partkey AS source_index, p_name AS task_id, p_type FROM part")
def checked_lookup(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tasks = part.select(F.col("p_partkey").alias("source_index"), F.col("p_name").alias("task_id"))
    return catalog.checked_join(tasks, part.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("asin"), "p_type"))


# --- profiles -------------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(source, ''), '<missing>') AS source, count(*) AS n FROM documents GROUP BY 1")
def source_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.histogram(table(spark, sf, "documents"), "source")


@query("""
SELECT (SELECT count(*) FROM documents) AS count, n_chars, doc_id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 1""")
def longest_of_selection(spark: SparkSession, sf: str) -> DataFrame:
    out = checks.longest_of(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")
    return out.select("count", "longest.n_chars", "longest.doc_id")


@query("""
SELECT count(*) AS attempts, count(DISTINCT user_id) AS touched, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS terminal,
       count(*) FILTER (WHERE event_type = 'purchase') AS successes FROM events""")
def attempt_coverage(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "profile_unsolved").when(F.col("event_type") == "purchase", "success").otherwise("other")
    return checks.coverage(_events(spark, sf).withColumn("status", status), "user_id")


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'train' WHEN 'O' THEN 'eval' ELSE 'test' END AS split FROM orders""")
def split_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_by_tag(_orders(spark, sf), "o_orderstatus", {"P": "train", "O": "eval", "F": "test"}).select("o_orderkey", "split")


# --- text and actions -----------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'click' ELSE 'invalid' END AS kind,
       CASE WHEN event_type = 'click' THEN 'v ' || event_id ELSE 'think action: ' || event_type || '[ v ' || event_id || ' ]' END AS arg FROM events""")
def normalized_actions(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("Think\nAction: "), F.initcap("event_type"), F.lit("[  V  "), F.col("event_id"), F.lit(" ]"))
    return _events(spark, sf).select("event_id", normalize_action(raw).alias("a")).select("event_id", "a.kind", "a.arg")


_ARGUMENT = "CASE event_id % 8 WHEN 0 THEN '12345678' WHEN 1 THEN 'abc12345' WHEN 2 THEN ' Buy Now ' WHEN 3 THEN 'next >' WHEN 4 THEN 'Prev' WHEN 5 THEN 'Reviews' WHEN 6 THEN '' ELSE 'red' END"


@query(f"""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'search' WHEN event_type <> 'click' OR event_id % 8 = 6 THEN 'malformed/other'
   ELSE CASE event_id % 8 WHEN 0 THEN 'product ASIN/numeric click' WHEN 2 THEN 'Buy Now' WHEN 3 THEN 'Next >' WHEN 4 THEN 'Back/navigation' WHEN 5 THEN 'product section' ELSE 'option/other click' END END AS kind,
   event_id % 8 IN (0, 1) AND length({_ARGUMENT}) > 0 AS product_like FROM events""")
def action_kinds(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "search").otherwise(F.col("event_type"))
    argument = F.expr(_ARGUMENT)
    return _events(spark, sf).select("event_id", action_kind(name, argument).alias("kind"), looks_like_product(argument).alias("product_like"))


@query("""
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') OR event_id % 5 = 0 THEN NULL WHEN event_type = 'view' THEN TRUE
   WHEN event_id % 5 = 1 THEN FALSE ELSE event_id % 2 = 0 END AS valid FROM events""")
def action_validity(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "search").otherwise(F.col("event_type"))
    argument = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "Search").otherwise("Red")
    seen = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("red"), F.lit("search"))).otherwise(F.array(F.lit("blue"), F.lit("search")))
    return _events(spark, sf).select("event_id", checks.action_is_valid(name, argument, seen).alias("valid"))


@query("SELECT doc_id, contains(lower(text), 'the') AS shown FROM documents")
def argument_shown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", contains_argument(F.lit(" THE "), "text").alias("shown"))


@query(r"""
WITH t AS (SELECT p_partkey, p_name || ' #é/' || p_type AS x FROM part)
SELECT p_partkey, left(regexp_replace(x, '[^\p{L}\p{N}._:/=-]', '', 'g'), 180) AS logged,
       regexp_replace(regexp_replace('.' || x || '_', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS component FROM t""")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    x = F.concat("p_name", F.lit(" #é/"), "p_type")
    return table(spark, sf, "part").select("p_partkey", log_value(x).alias("logged"), file_component(F.concat(F.lit("."), x, F.lit("_"))).alias("component"))


# --- attempts -------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 90.0::DOUBLE END AS seconds FROM orders""")
def wall_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """A readable end after the start, one before it, and one that can't be read."""
    shown = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    start = F.date_format("o_orderdate", shown)
    later, before = (F.date_format(F.expr(f"o_orderdate {sign} INTERVAL 90 SECONDS"), shown) for sign in "+-")
    end = F.when(F.col("o_orderkey") % 3 == 0, later).when(F.col("o_orderkey") % 3 == 1, before).otherwise("soon")
    return _orders(spark, sf).select("o_orderkey", attempts.wall_seconds(start, end).alias("seconds"))


@query("""
SELECT event_id, accepted FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS accepted FROM events WHERE event_type = 'purchase') WHERE accepted % 25 = 0""")
def progress_marks(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.progress_marks(_events(spark, sf).filter("event_type = 'purchase'"), "event_id")


@query("""
WITH d AS (SELECT o_orderkey % 3 AS retries, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 429 ELSE 503 END END AS code FROM orders)
SELECT count(*) AS calls, sum(retries)::BIGINT AS retries, count(*) FILTER (WHERE code = 429) AS http_429, count(*) FILTER (WHERE code = 503) AS http_5xx,
       bool_and(retries = 0 OR code IS NOT NULL) AS complete FROM d""")
def retry_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    out = attempts.retry_telemetry(_with_calls(spark, sf), "d")
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("calls", "retries", "http_429", "http_5xx")), "complete")


def _with_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as attempts with one call each."""
    key = F.col("o_orderkey")
    event = F.struct(F.when(key % 2 == 0, 429).otherwise(503).alias("status_code"))
    events = F.when((key % 3 > 0) & (key % 5 > 0), F.array(event)).otherwise(F.array().cast("array<struct<status_code: int>>"))
    return _orders(spark, sf).select("o_custkey", F.array(F.struct((key % 3).cast("int").alias("retries"), events.alias("retry_events"))).alias("d"))


@query("""
WITH d AS (SELECT o_custkey, o_orderkey % 3 AS retries, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 429 ELSE 503 END END AS code FROM orders)
SELECT count(DISTINCT o_custkey) AS tasks, count(*) AS calls, sum(retries)::BIGINT AS retries, count(*) FILTER (WHERE code = 429) AS http_429, count(*) FILTER (WHERE code = 503) AS http_5xx,
       bool_and(retries = 0 OR code IS NOT NULL) AS complete FROM d""")
def observed_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tasks, counted by a plan over the attempts, and the retries that were observed while it ran."""
    seen = Observation("retries")
    tasks = attempts.observed_retries(_with_calls(spark, sf), "d", seen).agg(F.count_distinct("o_custkey").alias("tasks")).first().tasks
    row = (tasks, *(seen.get[c] for c in ("calls", "retries", "http_429", "http_5xx", "complete")))
    return spark.createDataFrame([row], "tasks long, calls long, retries long, http_429 long, http_5xx long, complete boolean")


@query("""
WITH x AS (SELECT ts AS t, 1 AS d FROM events UNION ALL SELECT ts + INTERVAL 5 MINUTE, -1 FROM events),
s AS (SELECT t, sum(d) AS d FROM x GROUP BY t),
p AS (SELECT max(r)::BIGINT AS peak FROM (SELECT sum(d) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM s)),
m AS (SELECT epoch_us(max(ts)) / 1e6::DOUBLE + 300 - epoch_us(min(ts)) / 1e6::DOUBLE AS makespan, count(*) * 300.0::DOUBLE AS wall, count(*) FILTER (WHERE event_type = 'purchase') AS ok FROM events)
SELECT round(makespan, 3) AS makespan_s, wall AS wall_s, round(wall / makespan, 6) AS speedup, round(ok / makespan * 3600, 6) AS trajectories_per_hour, peak FROM m, p""")
def concurrency(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "success").otherwise("failure")
    rows = _events(spark, sf).select("ts", F.expr("ts + INTERVAL 5 MINUTES").alias("until"), F.lit(300).alias("wall"), outcome.alias("outcome"))
    out = attempts.concurrency(rows, "ts", "until", "wall", "outcome")
    return out.select(F.round("makespan_s", 3).alias("makespan_s"), "wall_s", six("speedup", "speedup"), six("trajectories_per_hour", "trajectories_per_hour"), "peak")


@query("""
SELECT event_id, CASE WHEN event_type = 'view' AND event_id NOT IN (1, 2) THEN 'infrastructure_interrupted' WHEN event_type = 'view' THEN 'in_progress' ELSE event_type END AS status FROM events""")
def stale_attempts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "in_progress").otherwise(F.col("event_type"))
    rows = _events(spark, sf).select("event_id", F.col("event_id").cast("string").alias("attempt_id"), status.alias("status"))
    return scheduling.stale_as_interrupted(rows, ["1", "2"]).select("event_id", "status")


# --- scheduling -----------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS slot, c_name FROM customer WHERE c_custkey % 3 = 0")
def initial_slots(spark: SparkSession, sf: str) -> DataFrame:
    return scheduling.initial_slots(table(spark, sf, "customer").filter("c_custkey % 3 = 0"), "c_custkey", "c_name")


@query("""
SELECT c_custkey AS slot, c_custkey::VARCHAR AS task_id, c_custkey % 4 + 1 AS attempt FROM customer
WHERE c_acctbal <= 5000 AND c_nationkey <> 3 AND c_custkey NOT IN (1, 5) AND c_custkey % 4 < 3 ORDER BY slot LIMIT 20""")
def open_slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    task = F.col("c_custkey").cast("string").alias("task_id")
    slots = rows.select(F.col("c_custkey").alias("slot"), task, (F.col("c_acctbal") > 5000).alias("fulfilled"), (F.col("c_nationkey") == 3).alias("exhausted"))
    return checks.open_slots(slots, rows.select(task, (F.col("c_custkey") % 4).alias("first_attempts")), 3, 20, ["1", "5"])


@query("""
WITH f AS (SELECT s_suppkey AS slot, s_nationkey AS stratum, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
q AS (SELECT c_custkey AS reserve, c_nationkey AS stratum, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer WHERE c_acctbal > 8000)
SELECT f.slot, f.stratum, q.reserve FROM f LEFT JOIN q ON f.stratum = q.stratum AND f.r = q.r""")
def slot_replacements(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_nationkey").alias("stratum"))
    queue = table(spark, sf, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").alias("stratum"), F.col("c_custkey").alias("place"))
    return scheduling.replacements(failed, queue)


@query("""
WITH c AS (SELECT c_nationkey AS stratum, count(*) AS n FROM customer GROUP BY 1),
f AS (SELECT stratum, 300::DOUBLE * n / (SELECT sum(n) FROM c) AS raw FROM c),
r AS (SELECT stratum, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum) AS rk FROM f),
t AS (SELECT stratum, (base + CASE WHEN rk <= 300 - (SELECT sum(floor(raw)) FROM f) THEN 1 ELSE 0 END)::BIGINT AS target FROM r),
a AS (SELECT s_nationkey AS stratum, sum(s_suppkey % 3)::BIGINT AS accepted FROM supplier GROUP BY 1)
SELECT t.stratum, target, coalesce(accepted, 0) AS accepted, target - coalesce(accepted, 0) AS deficit FROM t LEFT JOIN a ON t.stratum = a.stratum""")
def stratum_deficits(spark: SparkSession, sf: str) -> DataFrame:
    accepted = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("stratum"), (F.col("s_suppkey") % 3).alias("accepted_count"))
    return scheduling.deficits(accepted, table(spark, sf, "customer").select(F.col("c_nationkey").alias("stratum")), 300)


@query("""
SELECT c_custkey::VARCHAR AS task_id, c_custkey % 3 AS accepted, n_nationkey % 7 AS deficit FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal > 0 AND c_custkey % 4 > 0 ORDER BY accepted, deficit DESC, c_custkey LIMIT 15""")
def third_pass(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    states = table(spark, sf, "customer").select(
        key.cast("string").alias("task_id"), key.alias("slot"), F.col("c_nationkey").alias("stratum"), (F.col("c_acctbal") > 0).alias("first_success"), (key % 3).alias("accepted"), (key % 4).alias("left")
    )
    shortfall = table(spark, sf, "nation").select(F.col("n_nationkey").alias("stratum"), (F.col("n_nationkey") % 7).alias("deficit"))
    return scheduling.third_pass(states, shortfall, 15).select("task_id", "accepted", "deficit")


# --- gates, lineage, rewards ----------------------------------------------------------------------


@query("""
WITH r AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'terminal_unsuccessful' WHEN o_orderkey % 7 = 0 THEN 'missing_reward_metrics' WHEN o_totalprice <= 100000 THEN 'terminal_unsuccessful'
    WHEN o_orderkey % 11 = 0 THEN 'hygiene_reject' END AS gate FROM orders),
h AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 50 = 0),
p AS (SELECT r.*, h.o_custkey IS NOT NULL AS had, row_number() OVER (PARTITION BY r.o_custkey, r.o_orderpriority, gate IS NULL ORDER BY o_orderkey) AS place
      FROM r LEFT JOIN h ON r.o_custkey = h.o_custkey AND r.o_orderpriority = h.o_orderpriority)
SELECT o_orderkey, coalesce(gate, CASE WHEN had OR place > 1 THEN 'exact_duplicate' END) AS rejection_reason FROM p""")
def acceptance_gates(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    reward = F.when(key % 7 == 0, F.lit(None).cast("double")).otherwise(1.0)
    rows = _orders(spark, sf).select(
        "o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderstatus") != "P").alias("done"), F.lit("b01").alias("purchase"), F.array(reward, *([F.lit(1.0)] * 7)).alias("rewards"),
        F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.5).alias("r_succ"), F.when(key % 11 == 0, "loop").alias("hygiene"),
    )
    history = rows.filter("o_orderkey % 50 = 0").select("o_custkey", "o_orderpriority")
    return gates.acceptance(rows, history, "o_custkey", "o_orderpriority", "o_orderkey").select("o_orderkey", "rejection_reason")


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderdate, CASE o_orderstatus WHEN 'P' THEN 'base' WHEN 'O' THEN 'repair' END AS kind, o_totalprice > 100000 AS complete FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, kind, complete ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM r)
SELECT o_orderkey, CASE WHEN complete AND kind IS NOT NULL AND place = 1 THEN kind ELSE 'excluded' END AS role FROM p""")
def canonical_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = _orders(spark, sf).select(
        "o_orderkey", "o_orderpriority", "o_orderdate", (F.col("o_orderstatus") == "P").alias("base"), (F.col("o_orderstatus") == "O").alias("repair"), (F.col("o_totalprice") > 100000).alias("complete")
    )
    return lineage.canonical_runs(runs, "o_orderpriority", "o_orderdate", "o_orderkey", "base", "repair").select("o_orderkey", "role")


@query("SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_custkey) - 1 AS episode_seed FROM customer WHERE c_custkey % 2 = 1")
def episode_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.episode_seeds(table(spark, sf, "customer").filter("c_custkey % 2 = 1").select("c_custkey"), "c_custkey", 1000)


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS offset FROM documents")
def strata_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.strata_offsets(table(spark, sf, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "offset")


@query("""
SELECT c_custkey, sha256('["grpo",7,"rollout","' || c_mktsegment || '","' || c_name || '"]') AS stream FROM customer""")
def stream_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", lineage.stream_key("grpo", 7, "rollout", "c_mktsegment", "c_name").alias("stream"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def first_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", lineage.first_count("props", "missing", "k").alias("k"))


@query("""
WITH c AS (SELECT (o_orderkey // 7)::BIGINT AS chunk, count(*) AS n, min(o_orderkey // 21) AS low, max(o_orderkey // 21) AS high, min(CASE WHEN o_orderkey % 1000 = 0 THEN 1 ELSE 0 END) AS a,
   max(CASE WHEN o_orderkey % 1000 = 0 THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1)
SELECT chunk FROM c WHERE n <> 7 OR low <> high OR a <> b""")
def group_problems(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _orders(spark, sf).select("o_orderkey", F.floor(key / 21).alias("task"), F.when(key % 1000 == 0, 1).otherwise(0).alias("seed"))
    return rewards.contiguity_problems(rewards.chunks(rows, "o_orderkey", 7), 7, ["task", "seed"])


@query("SELECT o_orderkey, o_orderkey % 3 > 0 AND o_orderkey % 5 < 2 AND o_orderkey % 4 > 0 AS valid FROM orders")
def token_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Log probabilities over zero, masks that are neither 0 nor 1, and lists of other lengths."""
    key = F.col("o_orderkey")
    logprobs = F.array(F.lit(-0.5), F.when(key % 3 == 0, 0.1).otherwise(0.0))
    ids = F.when(key % 4 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    rows = _orders(spark, sf).select("o_orderkey", ids.alias("ids"), logprobs.alias("logprobs"), F.array(F.lit(1), (key % 5).cast("int")).alias("mask"))
    return rows.select("o_orderkey", rewards.trace_is_valid("ids", "logprobs", "mask").alias("valid"))


@query("SELECT doc_id, greatest(0, least(1024, 4096 - n_chars)) AS budget, 4096 - n_chars < 1024 AS capped_by_window FROM documents")
def generation_budgets(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "documents").select("doc_id", rewards.generation_budget("n_chars", 4096, 1024).alias("g"))
    return out.select("doc_id", F.col("g.budget").cast("long").alias("budget"), "g.capped_by_window")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'malformed_action' WHEN o_orderkey % 5 = 0 THEN 'invalid_action' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'terminal_unsuccessful' END
   WHEN o_orderkey % 11 = 0 THEN 'context_limit' ELSE 'max_steps' END AS status FROM orders""")
def terminal_statuses(spark: SparkSession, sf: str) -> DataFrame:
    key, no = F.col("o_orderkey"), F.lit(False)
    names = ("malformed", "invalid", "looped", "done", "success", "over_context")

    def step(*flags: Column) -> Column:
        return F.struct(*(f.alias(n) for f, n in zip(flags, names, strict=True)))

    steps = F.array(step(no, no, no, no, no, no), step(key % 7 == 0, key % 5 == 0, no, key % 3 == 0, key % 2 == 0, key % 11 == 0))
    return _orders(spark, sf).select("o_orderkey", rewards.status_of(steps, 2).alias("status"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'missing provenance' WHEN p_partkey % 5 = 0 THEN 'prompt hash differs' WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'missing persona'
   WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 'unexpected persona' END AS problem FROM part""")
def reset_contract(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("prompt"), F.when(key % 5 == 0, "x").otherwise(F.sha2("p_name", 256)).alias("prompt_sha256"), F.when(key % 4 > 0, F.col("p_brand")).alias("provenance"),
        F.when(key % 3 > 0, F.col("p_type")).alias("persona"), F.when(key % 2 == 1, "single_persona").otherwise("single").alias("scenario"),
    )
    return audit.reset_problems(rows).select("p_partkey", "problem")


@query("""
SELECT p_partkey, 1000 + row_number() OVER (ORDER BY p_partkey) - 1 AS episode_seed FROM part
QUALIFY row_number() OVER (ORDER BY p_partkey) > (SELECT count(*) FROM part WHERE p_partkey <= 150)""")
def remaining_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a manifest of which the first are done: what is left keeps the seeds of its places."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("task_id"))
    return lineage.remaining(parts, "p_partkey", "task_id", parts.filter("p_partkey <= 150"), 1000).select("p_partkey", "episode_seed")


@query("""
SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8192 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n, max(n_chars)::BIGINT AS most,
  0::BIGINT AS problems, true AS hashed FROM documents GROUP BY 1""")
def freeze_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents frozen to the shared folder: the manifest's counts, and whether what lies there is what was written."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc-"), "doc_id").alias("path"))
    reason = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 8192, "long")
    rows = docs.withColumn("reason", reason)
    folder = f"{shared_folder(spark).rstrip('/')}/frozen-{uuid.uuid4().hex}"
    told = sinks.freeze(rows, "reason", "n_chars", folder, selected=("doc_id", "sha256"), sources=docs)
    problems = sinks.frozen_problems(spark, folder).agg(F.count("*").alias("problems"))
    counts = spark.createDataFrame(sorted(told["reasons"].items()), "reason string, n long")
    hashed = all(p["files"] > 0 and len(p["sha256"]) == 64 for p in told["parts"].values())
    most = rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.max("n_chars").cast("long").alias("most"))
    return counts.join(most, "reason").crossJoin(F.broadcast(problems)).withColumn("hashed", F.lit(hashed))  # one row


def _dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as tasks and as the records that they came from, with gaps at fixed ids."""
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    tasks = docs.select(
        key.alias("source_index"), F.concat(F.lit("b"), key).alias("task_id"), F.when(key % 2 == 0, "single_persona").otherwise("standard").alias("scenario"),
        F.col("lang").alias("domain"), F.when(key % 4 > 0, F.col("source")).alias("category"),
    )
    first = F.struct(F.when(key % 5 > 0, F.left("text", F.lit(300))).alias("instruction"), F.sequence(F.lit(0), key % 6).alias("attributes"), F.when(key % 7 > 0, F.array(F.lit("a"))).alias("options"))
    persona = F.when(key % 3 > 0, F.struct("lang", "source"))
    record = F.struct(F.concat(F.when(key % 11 == 0, "x").otherwise("b"), key).alias("asin"), F.array(first).alias("instructions"), persona.alias("user_persona"))
    # prices of two kinds, of which one is a text and doesn't count
    prices = F.when(key % 9 > 0, F.concat(F.lit(', "pricing": ['), F.col("n_chars").cast("string"), F.lit(', "12", '), (key % 100).cast("string"), F.lit(".5]}"))).otherwise("}")
    json = F.concat(F.regexp_replace(F.to_json(record), r"\}\z", ""), prices)
    return dataset.measured(tasks, docs.filter(key % 13 > 0).select(key.alias("source_index"), json.alias("json")))


_DATASET = """
WITH d AS (SELECT *, doc_id % 13 > 0 AS there, doc_id % 2 = 0 AS own FROM documents),
m AS (SELECT 'instruction_chars' AS measure, length(left(text, 300))::DOUBLE AS v FROM d WHERE there AND doc_id % 5 > 0 AND length(text) > 0
  UNION ALL SELECT 'persona_chars', length('{"lang": "' || lang || '", "source": "' || source || '"}') FROM d WHERE there AND own AND doc_id % 3 > 0
  UNION ALL SELECT 'attribute_count', doc_id % 6 + 1 FROM d WHERE there UNION ALL SELECT 'option_count', 1 FROM d WHERE there AND doc_id % 7 > 0
  UNION ALL SELECT 'target_price_values', unnest([n_chars::DOUBLE, doc_id % 100 + 0.5]) FROM d WHERE there AND doc_id % 9 > 0)"""


@query(_DATASET + """
SELECT measure, count(*) AS n, round(min(v), 6) AS least, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95,
  round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM m GROUP BY measure""")
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = dataset.profile(_dataset(spark, sf))
    return out.select("measure", F.col("count").alias("n"), six("min", "least"), *(six(p, p) for p in ("p50", "p90", "p95", "p99")), six("max", "most"), six("mean", "mean"))


@query(_DATASET + """
SELECT count(*) AS task_count, count(DISTINCT CASE WHEN doc_id % 4 > 0 AND source <> '' THEN source ELSE '<missing>' END) AS category_count, count(DISTINCT coalesce(nullif(lang, ''), '<missing>')) AS domain_count,
  count_if(NOT (there AND doc_id % 5 > 0 AND coalesce(length(text), 0) > 0))::BIGINT AS missing_instruction, count_if(own AND NOT (there AND doc_id % 3 > 0))::BIGINT AS missing_user_persona,
  count_if(NOT there)::BIGINT AS missing_attributes, count_if(NOT (there AND doc_id % 7 > 0))::BIGINT AS missing_options, count_if(NOT (there AND doc_id % 9 > 0))::BIGINT AS missing_pricing,
  count_if(NOT there OR doc_id % 11 = 0)::BIGINT AS invalid_product_references FROM d""")
def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.counts(_dataset(spark, sf))


# --- attempts, as whole operators -----------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, bool_or(coalesce(event_type = a AND event_type = b, false)) AS stuck FROM e GROUP BY user_id""")
def stuck_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Users as attempts whose events are clicks: whether three in a row, and what was seen before them, are the same."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    rows = _events(spark, sf).groupBy("user_id").agg(F.transform(listed, lambda x: x["event_type"]).alias("seen"))
    clicks = F.transform("seen", lambda x: F.concat(F.lit("click["), x, F.lit("]")))
    return rows.select("user_id", attempts.no_progress(clicks, "seen").alias("stuck"))


@query(f"""
WITH q AS ({ORACLE_SQL["quantile_selection"]})
SELECT 'A' AS phase, doc_id FROM q WHERE contains(roles, 'longest') UNION ALL SELECT 'B', doc_id FROM q WHERE contains(roles, 'p50') OR contains(roles, 'p90') OR contains(roles, 'p99')
UNION ALL SELECT 'C', doc_id FROM q""")
def phases_of_selection(spark: SparkSession, sf: str) -> DataFrame:
    selection = sampling.quantile_selection(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    return checks.phase_plan(selection, "doc_id")


@query("""
SELECT o_custkey AS task_id, o_orderkey AS place, o_orderpriority AS note FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 > 0""")
def success_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a ledger and as artifacts, which disagree on some."""
    path = F.concat(F.lit("attempts/"), "o_orderkey")
    ledger = _orders(spark, sf).select(path.alias("artifact_path"), F.col("o_orderkey").alias("rowid"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("max_steps").alias("status"))
    said = F.when(F.col("o_orderkey") % 4 > 0, "success").otherwise("failed")
    artifacts = _orders(spark, sf).select(path.alias("artifact_path"), F.col("o_custkey").alias("task_id"), said.alias("profiling_status"), F.col("o_orderpriority").alias("note"))
    return checks.success_records(ledger, artifacts).select("task_id", "place", "note")


@query("""
WITH a AS (SELECT o_orderkey % 4 AS calls, o_orderkey % 3 AS retries, CASE o_orderkey % 5 WHEN 0 THEN 429 WHEN 1 THEN 502 END AS code, o_orderkey % 100 AS i, o_orderkey % 70 AS o FROM orders),
c AS (SELECT count_if(c_custkey % 2 = 0 OR c_custkey % 3 = 0)::BIGINT AS slots_completed, count(*) AS slots_total, count_if(c_custkey % 2 = 0)::BIGINT AS unique_successful_tasks FROM customer)
SELECT slots_completed, slots_total, unique_successful_tasks, sum(calls)::BIGINT AS api_calls, sum(retries)::BIGINT AS retries, count_if(code = 429)::BIGINT AS http_429, count_if(code = 502)::BIGINT AS http_5xx,
  sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM a, c GROUP BY 1, 2, 3""")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as attempts, customers as slots and tasks."""
    key, own = F.col("o_orderkey"), F.col("c_custkey")
    code = F.when(key % 5 == 0, 429).when(key % 5 == 1, 502)
    rows = _orders(spark, sf).select(
        F.slice(F.array(*(F.struct(F.lit(0.1).alias("latency_s")),) * 3), 1, (key % 4).cast("int")).alias("api_diagnostics"), (key % 3).alias("infrastructure_retries"),
        F.when(code.isNotNull(), F.array(F.struct(code.alias("status_code")))).otherwise(F.array().cast("array<struct<status_code: int>>")).alias("retry_events"),
        (key % 100).alias("total_input_tokens"), (key % 70).alias("total_output_tokens"),
    )
    slots = table(spark, sf, "customer").select((own % 2 == 0).alias("fulfilled"), (own % 3 == 0).alias("exhausted"))
    return attempts.run_summary(rows, slots, table(spark, sf, "customer").select((own % 2 == 0).alias("first_success")))
