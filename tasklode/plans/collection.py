"""Queries over the tables as collection runs: inputs, the profiler's loop, manifests, scores, audits and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklode.functions.text import available_summary, displayed, displayed_rate
from tasklode.operators import attempts, audit, checks, conversations, lineage, rewards, sampling, scheduling
from tasklode.plans.registry import query, six
from tasklode.session import shared_folder, table
from tasklode.sources import sinks


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


# --- inputs -----------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'c' || c_custkey END AS id, CASE WHEN c_custkey % 3 = 0 THEN 'single' ELSE 'single_persona' END AS scenario,
  CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM customer),
p AS (SELECT id, scenario, scenario AS want_scenario, split, CASE WHEN c_custkey % 101 = 0 THEN 'train' ELSE split END AS want_split FROM c
  UNION ALL SELECT id, scenario, scenario, 'test', 'test' FROM c WHERE c_custkey % 60 = 0 UNION ALL SELECT id, scenario, scenario, split, split FROM c WHERE c_custkey % 75 = 2),
n AS (SELECT want_scenario, id, count_if(want_split = 'train') AS a, count_if(want_split = 'test') AS b FROM p WHERE id <> '' GROUP BY ALL)
SELECT DISTINCT want_scenario AS scenario, want_split AS split, 'invalid official split manifest' AS problem FROM p WHERE id = '' OR split <> want_split
UNION ALL SELECT DISTINCT want_scenario, 'train', 'duplicate task IDs' FROM n WHERE a > 1 UNION ALL SELECT DISTINCT want_scenario, 'test', 'duplicate task IDs' FROM n WHERE b > 1
UNION ALL SELECT DISTINCT want_scenario, NULL, 'official train/test overlap' FROM n WHERE a > 0 AND b > 0
UNION ALL SELECT 'other', 'train', 'invalid official split manifest'""")
def official_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as the official pools, some without an id, in the wrong pool, in both or twice, and one pool without items."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        key, F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("c"), key)).alias("task_id"), F.when(key % 3 == 0, "single").otherwise("single_persona").alias("scenario"),
        F.when(key % 2 == 0, "train").otherwise("test").alias("split"),
    )
    first = rows.select("*", F.col("scenario").alias("want_scenario"), F.when(key % 101 == 0, "train").otherwise(F.col("split")).alias("want_split"))
    both = rows.filter(key % 60 == 0).withColumns({"split": F.lit("test"), "want_scenario": F.col("scenario"), "want_split": F.lit("test")})
    twice = rows.filter(key % 75 == 2).withColumns({"want_scenario": F.col("scenario"), "want_split": F.col("split")})
    pools = first.unionByName(both).unionByName(twice).drop("c_custkey")
    wanted = [(s, p) for s in ("single", "single_persona") for p in ("train", "test")] + [("other", "train")]
    return checks.pool_problems(pools, wanted)


@query("""
WITH t AS (SELECT doc_id, coalesce(nullif(lang, ''), '<missing>') || '|' || coalesce(nullif(source, ''), '<missing>') AS stratum FROM documents)
SELECT doc_id, 'primary' AS role, doc_id AS place FROM t WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, 'reserve', row_number() OVER (PARTITION BY stratum ORDER BY sha256('11' || chr(0) || stratum || chr(0) || doc_id::VARCHAR), doc_id) FROM t WHERE doc_id % 5 > 0""")
def collection_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the train manifest, a fifth of them as the primary one, half of those selected."""
    train = table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("doc_id").alias("position"))
    primary = train.filter("doc_id % 5 = 0")
    told = sampling.task_inputs(train, primary, "doc_id", ["lang", "source"], "11", primary.filter("doc_id % 10 = 0").select("doc_id", "position"))
    chosen = told.primary.select("doc_id", F.lit("primary").alias("role"), F.col("position").alias("place"))
    return chosen.unionByName(told.reserve.select("doc_id", F.lit("reserve").alias("role"), "place"))


_PROFILE = """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS task_id, CASE WHEN o_orderkey % 11 = 0 THEN 'infrastructure_interrupted' WHEN o_orderkey % 9 = 0 THEN 'success' ELSE 'max_steps' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'second_demo' WHEN o_orderkey % 4 < 3 THEN 'first_success' END AS phase FROM orders),
g AS (SELECT task_id, count_if(status <> 'infrastructure_interrupted' AND coalesce(phase, '') <> 'second_demo') AS first_attempts,
  count_if(status <> 'infrastructure_interrupted' AND coalesce(phase, '') = 'second_demo') AS second_attempts, count_if(status = 'success') AS successes FROM a GROUP BY task_id),
s AS (SELECT *, CASE WHEN successes = 0 THEN CASE WHEN first_attempts < 3 THEN 'first_success' ELSE 'profile_unsolved' END WHEN second_attempts < 2 THEN 'second_demo' ELSE 'done' END AS next FROM g)"""


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _orders(spark, sf).select(
        key.alias("k"), F.col("o_custkey").alias("task_id"), F.when(key % 11 == 0, "infrastructure_interrupted").when(key % 9 == 0, "success").otherwise("max_steps").alias("status"),
        F.when(key % 4 == 0, "second_demo").when(key % 4 < 3, "first_success").alias("phase"), (key % 9 == 0).alias("success"), F.col("o_orderpriority").alias("termination_reason"),
    )


@query(_PROFILE + """
SELECT c_custkey AS task_id, coalesce(first_attempts, 0)::BIGINT AS first_attempts, coalesce(second_attempts, 0)::BIGINT AS second_attempts, coalesce(successes, 0)::BIGINT AS successes,
  coalesce(next, 'first_success') AS next, CASE coalesce(next, 'first_success') WHEN 'first_success' THEN coalesce(first_attempts, 0) + 1 WHEN 'second_demo' THEN second_attempts + 1 END::BIGINT AS attempt
FROM customer LEFT JOIN s ON c_custkey = task_id""")
def profile_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the attempts of customers as tasks: what the profile does next with each, those without attempts included."""
    tasks = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"))
    return scheduling.profile_states(_profiled(spark, sf), "task_id", "status", "phase", tasks=tasks)


@query("""
WITH c AS (SELECT count_if(c_custkey % 2 = 0 OR c_custkey % 3 = 0) AS completed, count(*) AS tasks FROM customer),
o AS (SELECT count_if(o_orderkey % 7 > 0) AS trajectories, count_if(o_orderkey % 7 > 0 AND o_orderstatus = 'F') AS accepted FROM orders),
p AS (SELECT completed::BIGINT AS completed, tasks, trajectories::BIGINT AS trajectories, accepted::BIGINT AS accepted, 6000::BIGINT AS target, round(100.0::DOUBLE * completed / tasks, 6) AS task_pct,
  round(100.0::DOUBLE * accepted / trajectories, 6) AS success_rate, round(100.0::DOUBLE * accepted / 6000, 6) AS target_pct FROM c, o)
SELECT *, 'tasks=' || completed || '/' || tasks || ' (' || printf('%.2f', task_pct) || '%) | accepted=' || accepted || ' | trajectories=' || trajectories || ' | success_rate=' || printf('%.2f', success_rate)
  || '% | target=' || accepted || '/6000 (' || printf('%.2f', target_pct) || '%)' AS line FROM p""")
def collection_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as slots, orders as attempts."""
    own, rows = F.col("c_custkey"), _orders(spark, sf).filter("o_orderkey % 7 > 0")
    slots = table(spark, sf, "customer").select((own % 2 == 0).alias("fulfilled"), (own % 3 == 0).alias("exhausted"))
    out = scheduling.progress(slots, rows, rows.filter("o_orderstatus = 'F'"), 6000)
    return out.withColumns({c: F.round(c, 6) for c in ("task_pct", "success_rate", "target_pct")})


@query(_PROFILE + """, l AS (SELECT max(k) AS k FROM a JOIN s USING (task_id) WHERE next = 'profile_unsolved' AND status <> 'infrastructure_interrupted' GROUP BY task_id)
SELECT a.k, a.task_id, CASE WHEN l.k IS NULL THEN status ELSE 'profile_unsolved' END AS status, l.k IS NULL AND a.k % 9 = 0 AS success, CASE WHEN l.k IS NULL THEN o_orderpriority ELSE 'profile_unsolved' END AS termination_reason
FROM a JOIN orders ON a.k = o_orderkey LEFT JOIN l ON a.k = l.k""")
def unsolved_marks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _profiled(spark, sf)
    states = scheduling.profile_states(rows, "task_id", "status", "phase")
    return scheduling.mark_unsolved(rows, states, "task_id", "k", ["k"]).drop("phase")


@query("""
WITH r AS (SELECT n_nationkey, n_name FROM nation),
t AS (SELECT c_nationkey AS n_nationkey, count(*) AS n, list('c' || c_custkey ORDER BY c_custkey DESC) AS ids FROM customer WHERE c_nationkey % 6 > 0 GROUP BY 1)
SELECT n_nationkey, n_name AS scenario, coalesce(n, 0) AS selected_tasks, array_to_string(coalesce(ids, []), ' ') AS selected_task_ids, sha256(array_to_string(coalesce(ids, []), chr(10))) AS selected_task_list_hash,
  '{"first":3,"second":2}' AS profiling_limits,
  sha256('{"limits":{"first":3,"second":2},"purpose":"profile","scenario":"' || n_name || '","seed":' || n_nationkey || ',"task_ids":[' || coalesce(array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ','), '') || ']}') AS collection_config_hash
FROM r LEFT JOIN t USING (n_nationkey)""")
def run_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as runs over their customers, last key first; some runs have no tasks."""
    key = F.col("c_custkey")
    tasks = table(spark, sf, "customer").filter("c_nationkey % 6 > 0").select(F.col("c_nationkey").alias("n_nationkey"), (-key).alias("position"), F.concat(F.lit("c"), key).alias("task_id"))
    runs = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("scenario"), F.col("n_nationkey").alias("seed"))
    out = lineage.run_manifests(tasks, runs, "n_nationkey", "position", "task_id", "profile", {"second": 2, "first": 3}, most=1 << 30)
    return out.withColumn("selected_task_ids", F.array_join("selected_task_ids", " ")).drop("seed", "purpose")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS state FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 2 = 0""")
def artifact_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders saved once, some of them updated with others that are new."""
    folder = f"{shared_folder(spark).rstrip('/')}/artifacts-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    sinks.save_artifacts(_orders(spark, sf).filter(key % 3 < 2).select("o_orderkey", F.col("o_orderpriority").alias("state")), folder, "o_orderkey")
    later = _orders(spark, sf).filter((key % 3 == 0) | ((key % 3 == 2) & (key % 2 == 0)))
    sinks.save_artifacts(later.select("o_orderkey", F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("state")), folder, "o_orderkey", update=True)
    return sinks.artifacts(spark, folder, "o_orderkey long, state string", "o_orderkey")


# --- scores and reports -----------------------------------------------------------------------------


@query("""
WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS done, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS c, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN 0.25 ELSE 1 END::DOUBLE AS a, (o_orderkey % 8) / 8.0 AS l FROM orders),
y AS (SELECT *, c * a AS s FROM x)
SELECT k, CASE WHEN done THEN round(l, 6) ELSE 0 END AS r_loose, CASE WHEN done THEN round(s, 6) ELSE 0 END AS r_strict, CASE WHEN done AND s = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS r_succ, CASE WHEN done THEN 1.0 ELSE 0.0 END::DOUBLE AS r_finish,
  CASE WHEN done THEN c ELSE 0 END::DOUBLE AS r_category, CASE WHEN done THEN a ELSE 0 END AS r_attribute, CASE WHEN done THEN 1 ELSE 0 END::DOUBLE AS r_option, CASE WHEN done THEN 1 ELSE 0 END::DOUBLE AS r_price,
  CASE WHEN done THEN round(0.75 * s + 0.25 * l, 6) ELSE 0 END AS r_alpha FROM y""")
def episode_scores(spark: SparkSession, sf: str) -> DataFrame:
    key, none = F.col("o_orderkey"), F.lit(None).cast("double")
    attribute = F.when(key % 5 == 1, 0.25).when(key % 5 > 1, 1.0)
    detail = F.struct(F.when(key % 2 == 0, 1.0).otherwise(0.5).alias("r_type"), none.alias("r_category"), attribute.alias("r_att"), none.alias("r_attribute"), F.lit(1.0).alias("r_option"), F.lit(1.0).alias("r_price"))
    rows = _orders(spark, sf).select(key.alias("k"), detail.alias("d"), ((key % 8) / 8).alias("l"), F.when(key % 3 > 0, True).alias("f"))
    out = rewards.score_episodes(rows, "d", "l", "f", 0.75)
    return out.select("k", *(six(c, c) for c in (*rewards.METRICS, "r_alpha")))


@query("""
SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS response_characters FROM conversations GROUP BY conv_id""")
def episode_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as episodes whose responses are the assistant's texts."""
    told = conversations.messages_of(table(spark, sf, "conversations"), "conv_id", "turn")
    answers = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    episodes = told.select("conv_id", F.size("messages").cast("long").alias("turns"), "messages", answers.alias("visible_responses"), F.col("messages").alias("token_trace"))
    return conversations.episode_summaries(episodes)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE printf('%.3f', o_orderkey / 8.0) || 's' END AS seconds,
  printf('%.3f', (o_orderkey % 64) / 64.0) || ' [' || printf('%.3f', (o_orderkey % 64) / 128.0) || ', ' || CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE '1.000' END || ']' AS rate,
  CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE (o_orderkey % 3)::VARCHAR END AS clickables, CASE WHEN o_orderkey % 2 = 0 THEN 'N/A' ELSE 'true' END AS searchable FROM orders""")
def displayed_values(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    shown = available_summary(F.when(key % 3 > 0, F.array_repeat(F.lit("x"), (key % 3).cast("int"))), F.when(key % 2 > 0, True))
    rate = displayed_rate((key % 64) / 64, (key % 64) / 128, F.when(key % 5 > 0, 1.0))
    return _orders(spark, sf).select(key, displayed(F.when(key % 7 > 0, key / 8), 3, "s").alias("seconds"), rate.alias("rate"), shown["clickable_count"].alias("clickables"), shown["has_search_bar"].alias("searchable"))


# --- reports over attempts ----------------------------------------------------------------------------


@query("""
WITH a AS (SELECT o_custkey AS task, o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'max_steps' WHEN o_orderkey % 13 = 0 THEN 'profile_unsolved' ELSE 'success' END AS status,
  [CASE WHEN o_orderkey % 2 = 0 THEN 'Search[x]' ELSE 'click[' || o_custkey % 50 || ']' END, CASE WHEN o_orderkey % 3 = 0 THEN 'search[X]' ELSE 'click[b]' END] AS acts FROM orders),
h AS (SELECT task FROM a GROUP BY task HAVING bool_or(status <> 'success')),
s AS (SELECT task, lower(unnest(acts)) AS said FROM a), c AS (SELECT task, said, count(*) AS n FROM s GROUP BY ALL),
d AS (SELECT task, sum(n)::BIGINT AS action_count, max(n) > 1 AS twice, sum(CASE WHEN said LIKE 'search[%' THEN n ELSE 0 END) AS se, sum(CASE WHEN said LIKE 'click[%' THEN n ELSE 0 END) AS cl, bool_or(contains(said, task::VARCHAR)) AS target_clicked FROM c GROUP BY task)
SELECT a.task, array_to_string(list(status ORDER BY status), ' ') AS outcomes, count_if(status = 'max_steps') AS max_steps_attempts, any_value(twice AND se > 1) AS repeated_search, any_value(twice AND cl > 1) AS repeated_click,
  any_value(action_count) AS action_count, any_value(target_clicked) AS target_clicked, max_by(k % 8, k)::BIGINT AS last_reward FROM a JOIN h USING (task) JOIN d USING (task) GROUP BY a.task""")
def hard_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tasks, their orders as attempts of two actions each."""
    key, task = F.col("o_orderkey"), F.col("o_custkey")
    first = F.when(key % 2 == 0, "Search[x]").otherwise(F.concat(F.lit("click["), (task % 50).cast("string"), F.lit("]")))
    rows = _orders(spark, sf).select(
        task.alias("task"), key.alias("k"), F.when(key % 10 == 0, "max_steps").when(key % 13 == 0, "profile_unsolved").otherwise("success").alias("status"),
        F.array(first, F.when(key % 3 == 0, "search[X]").otherwise("click[b]")).alias("acts"), (key % 8).alias("reward"),
    )
    return attempts.hard_tasks(rows, "task", "status", "acts", "reward", ["k"]).withColumn("outcomes", F.array_join("outcomes", " "))


@query("""
WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'infra' WHEN o_orderkey % 3 = 0 THEN 'successful' ELSE 'genuine_failed' END AS grp, CASE WHEN o_orderkey % 13 = 0 THEN 3540 ELSE o_orderkey % 3000 END::DOUBLE AS wall,
  (o_orderkey % 500) / 8.0 AS api, (o_orderkey % 100)::DOUBLE AS i, (o_orderkey % 70)::DOUBLE AS o FROM orders),
v AS (SELECT grp, 'wall' AS measure, wall AS x FROM a UNION ALL SELECT grp, 'api_total', api FROM a UNION ALL SELECT grp, 'input', i FROM a UNION ALL SELECT grp, 'output', o FROM a UNION ALL SELECT grp, 'total', i + o FROM a
  UNION ALL SELECT grp, 'api_call', (k % 40) / 4.0 FROM a WHERE k % 3 > 0 UNION ALL SELECT grp, 'api_call', (k % 40) / 4.0 + 1 FROM a WHERE k % 3 > 1 UNION ALL SELECT grp, 'environment_step', (k % 20) / 4.0 FROM a WHERE k % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, measure ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY grp, measure) AS n FROM v),
q AS (SELECT grp, measure, any_value(n) AS n, avg(x) AS mean, max(x) AS most, max(x) FILTER (WHERE pos = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(x) FILTER (WHERE pos = round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90,
  max(x) FILTER (WHERE pos = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95 FROM r GROUP BY ALL),
e AS (SELECT * FROM (VALUES ('successful'), ('genuine_failed'), ('infra')) g(grp), (VALUES ('wall'), ('api_total'), ('input'), ('output'), ('total'), ('api_call'), ('environment_step')) m(measure)),
w AS (SELECT grp, CASE WHEN sum(wall) > 0 THEN sum(api) / sum(wall) END AS api_share FROM a GROUP BY grp)
SELECT grp AS "group", measure, coalesce(n, 0)::BIGINT AS n, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, round(most, 6) AS most, round(api_share, 6) AS api_share FROM e LEFT JOIN q USING (grp, measure) LEFT JOIN w USING (grp)""")
def group_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as attempts with latencies and tokens; nothing that a call's list adds multiplies an attempt's own values."""
    key = F.col("o_orderkey")
    at = key % 3000
    done = F.concat(F.lit("2026-01-01T00:"), F.lpad(F.floor(at / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((at % 60).cast("string"), 2, "0"), F.lit("Z"))

    def latencies(size: Column, *values: Column) -> Column:
        return F.slice(F.array(*(F.struct(v.cast("double").alias("latency_s")) for v in values)), 1, size.cast("int"))

    rows = _orders(spark, sf).select(
        F.when(key % 7 == 0, "cancelled").when(key % 3 == 0, "success").otherwise("max_steps").alias("status"), (key % 3 == 0).alias("success"), F.lit("2026-01-01T00:00:00Z").alias("started_at"),
        F.when(key % 13 == 0, "?").otherwise(done).alias("finished_at"), F.lit("2026-01-01T00:59:00Z").alias("saved_at"), ((key % 500) / 8).alias("api_latency_total_s"),
        (key % 100).alias("total_input_tokens"), (key % 70).alias("total_output_tokens"), latencies(key % 3, (key % 40) / 4, (key % 40) / 4 + 1).alias("api_diagnostics"),
        F.when(key % 2 == 0, latencies(F.lit(1), (key % 20) / 4)).alias("environment_diagnostics"),
    )
    out = attempts.group_statistics(rows).withColumnRenamed("max", "most")
    return out.select("group", "measure", "n", *(six(c, c) for c in ("mean", "p50", "p90", "p95", "most", "api_share")))


@query("""
WITH a AS (SELECT o_orderpriority AS run_id, o_orderkey AS key, o_orderkey % 3 AS k, o_orderkey % 4 AS calls, o_orderkey % 11 = 0 AS blind, o_orderkey % 8 < 4 AS blue, o_orderkey % 16 < 8 AS still,
  CASE o_orderkey % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'invalid_action' WHEN 2 THEN 'malformed_action' WHEN 3 THEN 'max_steps' ELSE 'profile_unsolved' END AS status FROM orders),
b AS (SELECT *, status = 'invalid_action' OR key % 9 = 0 AS old, status = 'malformed_action' OR key % 7 = 0 AS ended, calls < 3 AS said FROM a),
c AS (SELECT *, CASE WHEN k = 0 THEN CASE WHEN said THEN 'genuine_malformed_action' ELSE 'unresolved' END WHEN NOT old THEN 'not-invalid-labelled' WHEN blind THEN 'unresolved' WHEN k = 1 THEN 'false_invalid_diagnostic'
  WHEN NOT blue THEN 'genuinely_illegal_click_candidate' WHEN NOT still THEN 'false_invalid_diagnostic' ELSE 'unresolved' END AS class FROM b),
e AS (SELECT run_id, unnest([
  {'c': 'statuses', 'l': status, 'n': 1}, {'c': 'calls', 'l': calls::VARCHAR, 'n': 1}, {'c': 'total_attempts', 'l': NULL, 'n': 1}, {'c': 'total_requests', 'l': NULL, 'n': calls}, {'c': 'retry_total', 'l': NULL, 'n': calls * (key % 2)},
  {'c': 'status_discrepancies', 'l': NULL, 'n': (key % 2 = 0 AND key % 5 > 1)::INT}, {'c': 'classification', 'l': class, 'n': (old OR ended OR key % 4 > 0)::INT}, {'c': 'old_invalid_attempts', 'l': NULL, 'n': old::INT},
  {'c': 'invalid_calls', 'l': calls::VARCHAR, 'n': old::INT}, {'c': 'invalid_steps', 'l': k::VARCHAR, 'n': (old AND k > 0)::INT}, {'c': 'final_invalid_kinds', 'l': 'option/other click', 'n': (old AND k > 0)::INT},
  {'c': 'malformed_visible', 'l': NULL, 'n': ended::INT}, {'c': 'malformed_field_count', 'l': NULL, 'n': key % 4}, {'c': 'click_transitions', 'l': NULL, 'n': (k > 0)::INT},
  {'c': 'pre_true', 'l': NULL, 'n': (NOT blind AND (k = 1 OR k = 2 AND blue))::INT}, {'c': 'pre_false', 'l': NULL, 'n': (NOT blind AND k = 2 AND NOT blue)::INT}, {'c': 'pre_unknown', 'l': NULL, 'n': (blind AND k > 0)::INT},
  {'c': 'post_present', 'l': NULL, 'n': (NOT blind AND k = 2 AND still)::INT}, {'c': 'post_missing', 'l': NULL, 'n': (NOT blind AND (k = 1 OR k = 2 AND NOT still))::INT}, {'c': 'post_unknown', 'l': NULL, 'n': (blind AND k > 0)::INT},
  {'c': 'parser_checked', 'l': NULL, 'n': CASE WHEN said THEN 2 ELSE 0 END}, {'c': 'parser_mismatches', 'l': NULL, 'n': CASE WHEN said AND k = 2 THEN 2 ELSE 0 END},
  {'c': 'action_kinds', 'l': 'option/other click', 'n': (k > 0)::INT}, {'c': 'action_kinds', 'l': 'search', 'n': (k = 2)::INT}, {'c': 'api_statuses', 'l': CASE WHEN key % 10 = 0 THEN '429' ELSE '200' END, 'n': calls},
  {'c': 'api_models', 'l': 'm' || key % 2, 'n': calls}]) AS e FROM c)
SELECT run_id, e.c AS counter, e.l AS label, sum(e.n)::BIGINT AS n FROM e WHERE e.n > 0 GROUP BY ALL""")
def audit_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as stored attempts of old runs: each counter of the audit, by run."""
    key = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    acts = F.when(key % 3 == 0, none).when(key % 3 == 1, F.array(F.lit("click[red]"))).otherwise(F.array(F.lit("search[shoe]"), F.lit("click[blue]")))
    seen = F.array(F.lit("see Red"), F.when(key % 8 < 4, "see blue").otherwise("none"), F.when(key % 16 < 8, "blue").otherwise("gone"))
    call = F.struct(F.when(key % 10 == 0, 429).otherwise(200).alias("http_status"), F.concat(F.lit("m"), key % 2).alias("model"), (key % 2).cast("int").alias("retries"))
    rows = _orders(spark, sf).select(
        F.col("o_orderpriority").alias("run_id"),
        F.when(key % 6 == 0, "success").when(key % 6 == 1, "invalid_action").when(key % 6 == 2, "malformed_action").when(key % 6 == 3, "max_steps").otherwise("profile_unsolved").alias("status"),
        F.when(key % 5 == 0, "unknown").when(key % 5 > 1, "lost").alias("ledger_status"), (key % 2 == 0).alias("legacy"), F.when(key % 7 == 0, "malformed_action").alias("termination_reason"),
        F.when(key % 9 == 0, 1).alias("invalid_action_count"), (key % 4).alias("malformed_action_count"), acts.alias("actions"), F.when(key % 11 > 0, seen).alias("observations"),
        F.when(key % 4 < 3, F.array(F.lit("T\nAction: click[RED]"), F.lit("T\nAction: click[red]"))).otherwise(none).alias("visible_responses"),
        F.array_repeat(call, (key % 4).cast("int")).alias("api_diagnostics"),
    )
    return audit.audit_counters(rows)
