"""The query registry: stable keys to Spark callables, and their DuckDB twins.

Spark ranks and sizes are cast to long, doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklode.functions.hashing import canonical_json_hash, ordered_hash
from tasklode.functions.similarity import sequence_ratio
from tasklode.functions.stats import ratio, total_if_complete, wilson
from tasklode.functions.text import normalize_text, redact, trace_action
from tasklode.operators import attempts as A
from tasklode.operators import audit, conversations, gates, pairs, profiling, rewards, sampling
from tasklode.operators.scheduling import Budgets, task_states
from tasklode.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: White space of Unicode as a class of the twin's expressions.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


# --- sampling ---------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, coalesce(nullif(lang, ''), '<missing>') || '|' || coalesce(nullif(source, ''), '<missing>') AS stratum FROM documents),
c AS (SELECT stratum, count(*) AS n FROM d GROUP BY stratum),
f AS (SELECT stratum, 200::DOUBLE * n / (SELECT count(*) FROM d) AS raw FROM c),
r AS (SELECT stratum, floor(raw) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum) AS rk FROM f),
a AS (SELECT stratum, base + CASE WHEN rk <= 200 - (SELECT sum(floor(raw)) FROM f) THEN 1 ELSE 0 END AS quota FROM r),
h AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('1' || chr(0) || stratum || chr(0) || doc_id::VARCHAR), doc_id) AS p FROM d)
SELECT h.doc_id, h.stratum FROM h JOIN a ON h.stratum = a.stratum WHERE h.p <= a.quota""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, sf, "documents"), 200, "doc_id", ["lang", "source"])


@query("""
WITH p AS (SELECT doc_id, coalesce(nullif(lang, ''), '<missing>') || '|' || coalesce(nullif(source, ''), '<missing>') AS stratum
           FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7' || chr(0) || stratum || chr(0) || doc_id::VARCHAR), doc_id) AS place FROM p)
SELECT doc_id, stratum, place FROM r WHERE place = 1""")
def reserve_queue(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.reserve_queue(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", ["lang", "source"], "7", first_only=True)


@query("""
SELECT p_partkey, p_type AS tag, CASE WHEN p_partkey < 1 + 100 THEN 'test' WHEN p_partkey BETWEEN 117 AND 1000 THEN 'train' END AS split
FROM part WHERE p_partkey < 101 OR p_partkey BETWEEN 117 AND 1000""")
def split_by_tag_and_range(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("tag"))
    return sampling.split_by_range(parts, "p_partkey", {"test": (0, 101), "train": (117, 1001)})


@query("""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
g AS (SELECT i AS step, round_even((SELECT count(*) - 1 FROM documents)::DOUBLE * (i::DOUBLE / 32), 0)::BIGINT AS pos FROM range(1, 32) t(i)),
named AS (SELECT doc_id, n_chars, pos, (pos = n - 1)::INT AS l,
            (pos = round_even((n - 1)::DOUBLE * 0.5::DOUBLE, 0)::BIGINT)::INT AS a, (pos = round_even((n - 1)::DOUBLE * 0.9::DOUBLE, 0)::BIGINT)::INT AS b,
            (pos = round_even((n - 1)::DOUBLE * 0.99::DOUBLE, 0)::BIGINT)::INT AS c,
            (SELECT min(step) FROM g WHERE g.pos = r.pos) AS step FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN l + a + b + c > 0 THEN 0 ELSE 1 END, CASE WHEN l + a + b + c > 0 THEN 0 ELSE coalesce(step, 32) END, n_chars, doc_id) AS rk FROM named),
k AS (SELECT *, (SELECT max(step) FROM o WHERE rk <= 32 AND l + a + b + c = 0) AS stop FROM o WHERE rk <= 32)
SELECT doc_id, n_chars, concat_ws(',', CASE WHEN l = 1 THEN 'longest' END, CASE WHEN a = 1 THEN 'p50' END, CASE WHEN b = 1 THEN 'p90' END, CASE WHEN c = 1 THEN 'p99' END,
  CASE WHEN l + a + b + c = 0 OR step <= stop THEN 'stratified' END) AS roles FROM k""")
def quantile_selection(spark: SparkSession, sf: str) -> DataFrame:
    out = sampling.quantile_selection(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")
    return out.withColumn("roles", F.array_join("roles", ","))


@query("""
WITH e AS (SELECT e.i AS epoch, c_custkey FROM customer, range(0, 2) e(i)),
r AS (SELECT epoch, c_custkey, epoch * (SELECT count(*) FROM customer) + row_number() OVER (PARTITION BY epoch ORDER BY sha256('3' || chr(0) || epoch::VARCHAR || chr(0) || c_custkey::VARCHAR), c_custkey) - 1 AS position FROM e)
SELECT position, epoch, c_custkey FROM r WHERE position < 200""")
def task_schedule_hash(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.task_schedule(table(spark, sf, "customer"), "c_custkey", 200, 2, "3")


@query("""
SELECT b.item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))""")
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out items that some document holds. An item's inner words are whole words of such a document, so
    documents and items join on the item's longest inner word: first only the documents' ids and words, then the
    texts of the hits, and only these pairs are compared. Items without such a word (a fixed set of queries) are
    searched for directly."""
    words = F.split("item", "[ \n]")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    best = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item")).withColumn("word", best)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("word"))
    near = held.join(items.select("word").filter("word IS NOT NULL").distinct(), "word", "left_semi")
    able = near.join(items.filter("word IS NOT NULL"), "word").select("doc_id", "item_id", "item")
    hits = able.join(docs, "doc_id").filter(F.contains("text", "item")).select("item_id")
    short = items.filter("word IS NULL").drop("word")
    return hits.unionByName(short.join(docs, F.contains("text", "item"), "left_semi").select("item_id")).distinct()


@query("""
SELECT conv_id, sha256(string_agg(role, chr(10) ORDER BY turn)) AS roles_sha256 FROM conversations GROUP BY conv_id""")
def ordered_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(ordered_hash("role", "turn").alias("roles_sha256"))


# --- profiles ---------------------------------------------------------------------------------


@query("""
SELECT lang, count(n_chars) AS n, round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) AS p90,
       round(quantile_cont(n_chars::DOUBLE, 0.99), 6) AS p99, round(avg(n_chars), 6) AS mean, max(n_chars)::DOUBLE AS top
FROM documents GROUP BY lang""")
def profile_lengths_linear(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "documents").groupBy("lang").agg(*profiling.linear_summary("n_chars"))
    return out.select("lang", F.col("count").alias("n"), six("p50", "p50"), six("p90", "p90"), six("p99", "p99"), six("mean", "mean"), F.col("max").alias("top"))


@query("""
SELECT event_type, list_sort(list(value))[round_even((count(value) - 1)::DOUBLE * 0.9::DOUBLE, 0)::INT + 1] AS p90, max(value) AS top
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.nearest_ranks(table(spark, sf, "events"), "event_type", "value", {"p90": 0.9, "top": 1.0})


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def top_partkeys(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.most_common(table(spark, sf, "lineitem"), "l_partkey", 20)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def longest_n(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.longest(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 20)


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 512) AS over_512, count(*) FILTER (WHERE n_chars > 2048) AS over_2048,
       count(*) FILTER (WHERE n_chars > 8192) AS over_8192 FROM documents""")
def threshold_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), *profiling.threshold_counts("n_chars", [512, 2048, 8192]))


@query("""
SELECT event_type, count(*) AS n, sum(CASE WHEN json_extract_string(props, '$.k')::INT > 50 THEN 1 ELSE 0 END)::BIGINT AS high FROM events GROUP BY event_type""")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    high = F.get_json_object("props", "$.k").cast("int") > 50
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"))


# --- attempts: task = user, infrastructure = error, success = a purchase above 250 ------------------


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return rows.filter(A.is_genuine("event_type", ("error",))).withColumn("success", (F.col("event_type") == "purchase") & (F.col("value") > 250))


_FIRST = """
WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events WHERE event_type <> 'error'),
o AS (SELECT user_id, count(*) AS attempts, min(CASE WHEN event_type = 'purchase' AND value > 250 THEN o END) AS first_success FROM g GROUP BY user_id)
"""


@query(_FIRST + "SELECT user_id, attempts, first_success FROM o")
def first_success(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_success(_attempts(spark, sf), "user_id", "success", ["ts", "event_id"])


@query(_FIRST + """
SELECT count(*) AS tasks, count(first_success) AS solved, round(count(first_success)::DOUBLE / count(*) * 3000, 6) AS solved_3000,
       round(count(first_success)::DOUBLE / count(*) * 6000, 6) AS solved_6000, round(sum(attempts)::DOUBLE / count(first_success) * 3000, 6) AS attempts_3000,
       round(sum(attempts)::DOUBLE / count(first_success) * 6000, 6) AS attempts_6000 FROM o""")
def cost_projection(spark: SparkSession, sf: str) -> DataFrame:
    out = A.cost_projection(A.success_summary(first_success(spark, sf)), (3000, 6000))
    return out.select("tasks", "solved", *(six(c, c) for c in ("solved_3000", "solved_6000", "attempts_3000", "attempts_6000")))


@query("""
SELECT DISTINCT user_id FROM (SELECT user_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = a AND event_type = b""")
def no_progress_loops(spark: SparkSession, sf: str) -> DataFrame:
    return A.repeats_in_rows(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
WITH c AS (SELECT event_type, count(*)::DOUBLE AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::DOUBLE AS k FROM events GROUP BY event_type),
p AS (SELECT event_type, n, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c),
m AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM p)
SELECT event_type, round(p, 6) AS rate, round(greatest(0.0::DOUBLE, mid - half), 6) AS low, round(least(1.0::DOUBLE, mid + half), 6) AS high FROM m""")
def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n")).withColumn("w", wilson("k", "n"))
    return out.select("event_type", six("w.rate", "rate"), six("w.low", "low"), six("w.high", "high"))


@query("""
WITH r AS (SELECT o_custkey AS task, o_orderkey AS at, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS phase, o_orderpriority AS bought,
    list(n || ' ' || flags ORDER BY n) AS did
  FROM orders JOIN (SELECT l_orderkey, l_returnflag || l_linestatus AS flags, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus) AS n FROM lineitem)
    ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 GROUP BY ALL),
p AS (SELECT CASE WHEN a.phase = b.phase THEN a.phase || '_' || b.phase ELSE 'first_second' END AS pair_type, a.did = b.did AS same, a.bought = b.bought AS same_bought,
    a.did[1] = b.did[1] AS same_search, a.did[2:] = b.did[2:] AS same_options, len(a.did) = len(b.did) AND len(list_intersect(a.did, b.did)) >= 0.8 * len(a.did) AS near
  FROM r a JOIN r b ON a.task = b.task AND a.at > b.at)
SELECT pair_type, count(*) AS pairs, count_if(same AND same_bought)::BIGINT AS exact, count_if(near)::BIGINT AS near, count_if(same)::BIGINT AS equal_normalized_actions,
  count_if(same_search)::BIGINT AS equal_search_queries, count(*) AS equal_clicked_products, count_if(same_options)::BIGINT AS equal_selected_options, count_if(same_bought)::BIGINT AS equal_final_purchase
FROM p GROUP BY pair_type""")
def pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as successes of their customers: the first line, in order of the flags, is searched for, further ones
    are clicked. An action names its place, so the matching blocks of two lists are their equal places, which SQL can count."""
    flags = F.array_sort(F.collect_list(F.concat("l_returnflag", "l_linestatus")))
    said = F.transform(flags, lambda x, i: F.concat(F.when(i == 0, "search[").otherwise("click["), (i + 1).cast("string"), F.lit(" "), x, F.lit("]")))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(said.alias("actions"))
    told = table(spark, sf, "orders").filter("o_orderkey % 5 <> 0").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    phase = F.when(F.col("o_orderkey") % 3 == 0, "second_demo").otherwise("first_success")
    told = told.select("o_custkey", "o_orderkey", phase.alias("phase"), "o_orderpriority", "actions")
    return pairs.pair_statistics(A.with_fingerprint(told, "actions", "o_orderpriority"), "o_custkey", "o_orderkey", "phase", "fingerprint")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT o_orderkey, CASE WHEN place % 2 = 0 THEN 'duplicate_or_missing_sqlite_acceptance' END AS shadow_reason FROM r""")
def shadow_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as a chain: the second repeats the first's id, the third the second's task, and so on, so
    each row's fate hangs on that of the row before."""
    rows = A.ordinals(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])
    key, place = F.col("o_custkey").cast("string"), F.col("ordinal") - 1
    rows = rows.select("o_orderkey", F.concat_ws(" ", key, F.floor(place / 2)).alias("aid"), F.concat_ws(" ", key, F.floor((place + 1) / 2)).alias("tid"))
    return gates.first_wins(rows, "aid", "tid", "o_orderkey", rows.select("aid")).select("o_orderkey", "shadow_reason")


@query("""
WITH x AS (SELECT ts AS t, 1 AS d FROM events UNION ALL SELECT ts + INTERVAL 5 MINUTE, -1 FROM events),
s AS (SELECT t, sum(d) AS d FROM x GROUP BY t)
SELECT max(r)::BIGINT AS peak FROM (SELECT sum(d) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM s)""")
def max_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    return A.most_at_once(table(spark, sf, "events").select("ts", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("until")), "ts", "until")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return A.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).drop("ts")


@query("""
WITH late AS (SELECT * FROM events WHERE event_type = 'purchase' AND value > 250)
SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM late) UNION ALL SELECT event_id, user_id FROM late""")
def overlay_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    base, repair = rows.filter("event_type = 'click'"), rows.filter("event_type = 'purchase' AND value > 250")
    return A.overlay(base, repair, "user_id").select("event_id", "user_id")


@query("""
SELECT c_custkey, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE o_totalprice > 400000) AS large
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey GROUP BY c_custkey""")
def task_outcomes_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are counted before the join, so the join has one row a customer at most."""
    large = table(spark, sf, "orders").filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 400000).alias("large"))
    joined = table(spark, sf, "customer").select("c_custkey").join(large, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("large", F.lit(0)).alias("large"))


# --- conversations ------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.messages_of(table(spark, sf, "conversations"), "conv_id", "turn")


@query("""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id FROM t GROUP BY conv_id HAVING min(n) >= 3 AND bool_and(text IS NOT NULL AND role = CASE WHEN i = 0 THEN 'system' WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)""")
def conversation_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).filter(conversations.problem_of("messages").isNull()).select("conv_id")


def _characters(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """A tokenizer for checks: a token a character, but for the marks of the chat template."""
    spans = [m.span() for m in re.finditer(r"<\|im_(?:start|end)\|>|.", text, re.S)]
    return [{conversations.HEAD: 1, conversations.TAIL: 2}.get(text[a:b], 3) for a, b in spans], spans


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
s AS (SELECT conv_id, max(last) AS last, sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END)::BIGINT AS labelled,
        (sum(CASE WHEN turn <= last THEN 1 + length(role) + 1 + n + 1 + 1 ELSE 0 END) - 1)::BIGINT AS tokens FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN last IS NOT NULL AND tokens <= 4096 THEN tokens END AS tokens, CASE WHEN last IS NOT NULL AND tokens <= 4096 THEN labelled END AS labelled,
       CASE WHEN last IS NULL THEN 'no assistant loss tokens' WHEN tokens > 4096 THEN 'over_context_4096' END AS problem FROM s""")
def assistant_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each conversation up to its last assistant's end, and how many of them are trained."""
    out = conversations.tokenized(_messages(spark, sf), "messages", _characters, 2, 4_096)
    labelled = F.size(F.filter("labels", lambda x: x != -100))
    none = F.col("mask_problem").isNotNull()
    return out.select(
        "conv_id", *(F.when(~none, x.cast("long")).alias(n) for x, n in ((F.size("input_ids"), "tokens"), (labelled, "labelled"))), F.col("mask_problem").alias("problem")
    )


def _tokenizer():
    return _characters


@query("""
WITH t AS (SELECT conv_id, role, length(text) AS n FROM conversations)
SELECT conv_id, sum(1 + length(role) + 1 + n + 1 + 1)::BIGINT + 11 AS rendered_input_tokens,
       sum(1 + length(role) + 1 + n + 1 + 1 - CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END)::BIGINT + 11 AS observation_header_tokens FROM t GROUP BY conv_id""")
def prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the next prompt of each conversation, and of those what no assistant said."""
    return conversations.prompt_profile(_messages(spark, sf), "messages", _tokenizer).drop("messages")


_LEAKY = "CASE WHEN turn % 7 = 3 THEN concat(text, ' \"Reward_Detail\"') ELSE text END"


@query(f"""
WITH t AS (SELECT conv_id, {_LEAKY} AS text FROM conversations)
SELECT DISTINCT conv_id FROM t WHERE contains(lower(text), 'target_asin') OR contains(lower(text), 'instruction_options')
  OR contains(lower(text), 'reward_detail') OR contains(lower(text), 'evaluator_only')""")
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that name something of the evaluator's; turn 3 is made to."""
    rows = table(spark, sf, "conversations").withColumn("text", F.expr(_LEAKY))
    return conversations.messages_of(rows, "conv_id", "turn").filter(conversations.leaks("messages")).select("conv_id")


@query("""
WITH s AS (SELECT o_orderkey AS position, o_custkey AS task FROM orders WHERE o_orderkey < 500 OR o_orderkey % 1000 = 999),
m AS (SELECT o_orderkey AS position, o_custkey AS task FROM orders WHERE o_orderkey < 5000)
SELECT count(*) AS rows, bool_and(s.task IS NOT DISTINCT FROM m.task) AND max(s.position) + 1 = count(*) AS is_prefix FROM s LEFT JOIN m ON s.position = m.position
UNION ALL
SELECT count(*) AS rows, bool_and(s.task IS NOT DISTINCT FROM m.task) AND max(s.position) + 1 = count(*) AS is_prefix FROM (SELECT * FROM s WHERE position < 500) s LEFT JOIN m ON s.position = m.position""")
def ordered_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Saved rows against their manifest: with rows from elsewhere, and only the first."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("task"))
    saved, manifest = rows.filter("position < 500 OR position % 1000 = 999"), rows.filter("position < 5000")
    checked = (rewards.ordered_prefix(s, manifest, "position", "task") for s in (saved, saved.filter("position < 500")))
    return reduce(DataFrame.unionByName, checked)


@query(r"""
WITH t AS (SELECT conv_id, turn, 'search[' || text || '] x' AS a FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(a, '^[^\n]+\[[^\n]+\]') THEN regexp_extract(a, '^([^\n]+)\[([^\n]+)\]', 1) ELSE a END AS name,
       CASE WHEN regexp_matches(a, '^[^\n]+\[[^\n]+\]') THEN regexp_extract(a, '^([^\n]+)\[([^\n]+)\]', 2) END AS argument FROM t""")
def action_trace(spark: SparkSession, sf: str) -> DataFrame:
    traced = trace_action(F.concat(F.lit("search["), F.col("text"), F.lit("] x")))
    return table(spark, sf, "conversations").select("conv_id", "turn", traced.alias("t")).select("conv_id", "turn", F.col("t.action_name").alias("name"), F.col("t.action_argument").alias("argument"))


@query()
def near_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of each two turns of a conversation, by their words."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    told = A.pairs(rows, "conv_id", "turn")
    return told.select("conv_id", F.col("a.turn").alias("later"), F.col("b.turn").alias("earlier"), six(sequence_ratio("a.words", "b.words"), "likeness"))


@query()
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", canonical_json_hash("props").alias("props_sha256"))


# --- gates, duplicates, audit ---------------------------------------------------------------------


_GATE = """CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8192 THEN 'long' ELSE 'kept' END"""


@query(f"SELECT {_GATE} AS reason, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def gate_cascade(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    reason = gates.first_failure(
        [
            ("unlabelled", F.col("labelled").isNull()),
            ("low_quality", F.col("quality") == 0),
            ("toxic", F.col("toxic") == 1),
            ("short", F.col("n_chars") < 200),
            ("long", F.col("n_chars") > 8192),
        ]
    )
    return gates.reason_counts(rows.withColumn("reason", reason), "reason")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority, o_orderkey % 10 <> 0 AS known FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY known, o_custkey ORDER BY o_orderkey) AS place FROM r),
f AS (SELECT CASE WHEN NOT known THEN 'duplicate_or_missing_sqlite_acceptance' WHEN place > 1 THEN 'duplicate_task_id'
    WHEN priority = '1-URGENT' THEN 'wrong_scenario' WHEN status = 'P' THEN 'not_pass_a' WHEN price <= 60000 THEN 'non_success_record'
    WHEN o_orderkey % 11 = 0 THEN 'invalid_terminal' WHEN o_custkey % 7 = 0 THEN 'not_train' WHEN o_orderkey % 13 = 0 THEN 'target_id_exploitation'
    WHEN o_orderkey % 17 = 0 THEN 'expected system, user, assistant' ELSE 'kept' END AS reason FROM k)
SELECT reason, count(*) AS n FROM f GROUP BY reason""")
def freeze_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The freeze cascade over orders as records: an order is accepted work on its customer."""
    rows = table(spark, sf, "orders")
    key, task = F.col("o_orderkey"), F.col("o_custkey")

    def message(role: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit("text").alias("content"))

    turns = [message(r) for r in ("system", "user", "assistant")]
    records = rows.select(
        key.alias("accepted_id"), task.alias("task_id"), key.alias("file"), F.when(F.col("o_orderpriority") == "1-URGENT", "other").otherwise("standard").alias("scenario"),
        F.when(F.col("o_orderstatus") == "P", "B").otherwise("A").alias("pass"), F.lit(True).alias("accepted"), F.when(F.col("o_totalprice") > 60000, 1.0).otherwise(0.0).alias("r_succ"),
        F.lit(1.0).alias("r_finish"), F.lit(True).alias("done"), F.lit("b01").alias("purchase"), F.when(key % 11 == 0, "b02").otherwise("b01").alias("target"),
        F.when(key % 13 == 0, F.array(F.lit("Search[x b01]"))).otherwise(F.array(F.lit("search[x]"))).alias("actions"),
        F.when(key % 17 == 0, F.array(*turns[:2])).otherwise(F.array(*turns)).alias("messages"), F.lit(None).cast("array<string>").alias("visible_responses"),
    )
    known, train = records.filter("accepted_id % 10 <> 0"), records.filter("task_id % 7 <> 0")
    return gates.reason_counts(gates.freeze(records, known, train, "standard"), "reason")


@query(rf"""
WITH h AS (SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g'), ' '))) AS text_sha256 FROM documents)
SELECT min(doc_id) AS doc_id, text_sha256 FROM h GROUP BY text_sha256""")
def normalize_text_dedup(spark: SparkSession, sf: str) -> DataFrame:
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2(normalize_text("text"), 256).alias("text_sha256"))
    return hashed.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://[^\s\x{0B})]+', '<redacted-url>', 'g'),
   '(?i)bearer[\s\x{0B}]+[A-Za-z0-9._-]+', 'Bearer <redacted>', 'g'),
   '(?i)((?:sk|key|token|secret)[-_A-Za-z0-9]*)[\s\x{0B}]*([:=])[\s\x{0B}]*[^\s\x{0B},;]+', '\1\2<redacted>', 'g'),
   '\bsk-[A-Za-z0-9_-]{12,}\b', '<redacted-key>', 'g')) AS clean_sha256 FROM documents""")
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(redact("text"), 256).alias("clean_sha256"))


@query("""
SELECT CASE WHEN d.doc_id IS NULL THEN 'ledger_only' WHEN l.doc_id IS NULL THEN 'artifact_only' ELSE 'both' END AS source, count(*) AS n,
       sum(CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND (CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END) <> l.quality THEN 1 ELSE 0 END)::BIGINT AS conflicts
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def attempt_audit(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("status"))
    ledger = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("status"))
    return audit.against_ledger(artifacts, ledger, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if("status_conflict").alias("conflicts"))


# --- rewards and groups ------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_samp(o_totalprice) OVER w + 0.0001::DOUBLE), 6) AS advantage
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rewards.advantages(rows, "o_custkey", "o_totalprice").select("o_orderkey", six("advantage", "advantage"))


@query("""
SELECT (o_orderkey // 8)::BIGINT AS chunk, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd FROM orders GROUP BY 1""")
def group_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewards.chunks(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 8)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), six(F.avg("o_totalprice"), "mean"), six(F.stddev_samp("o_totalprice"), "sd"))


@query("""
WITH e AS (SELECT (o_orderkey // 8)::BIGINT AS chunk, o_totalprice AS reward, o_orderkey % 9 AS steps, o_orderkey % 5 AS tokens,
   CASE o_orderstatus WHEN 'P' THEN 'invalid_action' WHEN 'F' THEN 'malformed_action' ELSE 'context_limit' END AS status FROM orders),
g AS (SELECT chunk, stddev_samp(reward) AS sd FROM e GROUP BY chunk)
SELECT round(avg(reward), 4) AS reward_mean, round(stddev_samp(reward), 4) AS reward_std, (SELECT round(avg(sd), 4) FROM g) AS group_reward_std,
   (SELECT round(count(*) FILTER (WHERE sd = 0)::DOUBLE / count(*), 6) FROM g) AS zero_variance, round(avg(steps), 6) AS episode_steps,
   round(count(*) FILTER (WHERE status = 'invalid_action')::DOUBLE / count(*), 6) AS invalid_rate,
   round(count(*) FILTER (WHERE status = 'malformed_action')::DOUBLE / count(*), 6) AS malformed_rate,
   round(count(*) FILTER (WHERE status = 'context_limit')::DOUBLE / count(*), 6) AS context_limit_rate,
   sum(tokens)::BIGINT AS generated_tokens, (2 * count(*))::BIGINT AS policy_tokens, round(sum(tokens)::DOUBLE / (count(*) * 0.5::DOUBLE), 6) AS tokens_per_second,
   round(count(*)::DOUBLE / (count(*) * 2.0::DOUBLE) * 3600, 6) AS trajectories_per_hour FROM e""")
def rollout_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Rollout metrics over orders as episodes, eight to a group."""
    status = F.when(F.col("o_orderstatus") == "P", "invalid_action").when(F.col("o_orderstatus") == "F", "malformed_action").otherwise("context_limit")
    rows = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 8).cast("long").alias("chunk"), F.col("o_totalprice").alias("reward"), (F.col("o_orderkey") % 9).alias("steps"),
        (F.col("o_orderkey") % 5).alias("generated_tokens"), status.alias("status"), F.array(F.lit(1), F.lit(0), F.lit(1)).alias("env_mask"),
        F.lit(0.5).alias("generation_time_s"), F.lit(0.25).alias("environment_wait_s"), F.lit(2.0).alias("wall_time_s"),
    )
    out = rewards.rollout_metrics(rows, "reward").crossJoin(F.broadcast(rewards.rollout_rates(rows)))  # one row each
    four = (F.round(c, 4).alias(c) for c in ("reward_mean", "reward_std", "group_reward_std"))
    rates = (six(c, c) for c in ("episode_steps", "invalid_rate", "malformed_rate", "context_limit_rate", "trajectories_per_hour"))
    return out.select(
        *four, six("zero_variance_group_fraction", "zero_variance"), *rates, "generated_tokens", F.col("generated_policy_tokens").alias("policy_tokens"),
        six("generated_tokens_per_second", "tokens_per_second"),
    )


@query("""
WITH e AS (SELECT o_orderpriority AS scenario, o_totalprice / 500000 AS m, o_orderkey % 3 AS f, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS t,
   CASE o_orderstatus WHEN 'P' THEN 'max_steps' ELSE 'context_limit' END AS status FROM orders)
SELECT scenario, count(*) AS episodes, round(avg(m), 6) AS mean_r_loose, count(*) FILTER (WHERE f = 1) AS finish_count, count(*) FILTER (WHERE f = 1) AS success_count,
   count(*) FILTER (WHERE status = 'max_steps') AS max_steps_count, count(*) FILTER (WHERE status = 'context_limit') AS context_limit_count,
   round(avg(t), 6) AS mean_generated_tokens, CASE WHEN count(t) = count(*) THEN sum(t)::BIGINT END AS total_generated_tokens, count(*) = 3000 AS complete,
   round(count(*)::DOUBLE / (count(*) * 2.0::DOUBLE) * 3600, 6) AS trajectories_per_hour FROM e GROUP BY scenario""")
def evaluation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation summaries over orders as episodes; some have no token count, so there is no total."""
    one = F.when(F.col("o_orderkey") % 3 == 1, 1.0).otherwise(0.0)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("scenario"), (F.col("o_totalprice") / 500000).alias("r_loose"), one.alias("r_finish"), one.alias("r_succ"),
        *(F.lit(0.0).alias(m) for m in rewards.METRICS if m not in ("r_loose", "r_finish", "r_succ")), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 4).alias("generated_tokens"),
        F.when(F.col("o_orderstatus") == "P", "max_steps").otherwise("context_limit").alias("status"), F.lit(2.0).alias("wall_time_s"), F.lit(0.5).alias("generation_time_s"),
    )
    out = rewards.evaluation_summary(rows, 3000, ["generated_tokens"], ["scenario"])
    counts = ("finish_count", "success_count", "max_steps_count", "context_limit_count")
    return out.select("scenario", "episodes", *(six(c, c) for c in ("mean_r_loose", "mean_generated_tokens", "trajectories_per_hour")), *counts, "total_generated_tokens", "complete")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, 1 - l_discount AS b,
   CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c, 1 - l_tax AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a * b * c * d, 6) AS r_strict, CASE WHEN a * b * c * d = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r_succ,
       round(0.5::DOUBLE * (a * b * c * d) + 0.5::DOUBLE * ((a + b + c + d) / 4), 6) AS r_alpha FROM c""")
def reward_components(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.struct(
        F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.5).alias("r_category"), F.lit(None).cast("double").alias("r_type"),
        (1 - F.col("l_discount")).alias("r_attribute"), F.lit(None).cast("double").alias("r_att"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("r_option"), (1 - F.col("l_tax")).alias("r_price"),
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", detail.alias("d"))
    d = F.col("d")
    loose = (d["r_category"] + d["r_attribute"] + d["r_option"] + d["r_price"]) / 4
    parts = rewards.components(d, loose, F.lit(True))
    alpha = rewards.combined(parts["r_strict"], parts["r_loose"], 0.5)
    return rows.select("l_orderkey", "l_linenumber", six(parts["r_strict"], "r_strict"), parts["r_succ"].alias("r_succ"), six(alpha, "r_alpha"))


@query("""
WITH j AS (SELECT d.doc_id % 200 AS g, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT g, round(avg(quality), 6) AS mean_quality, CASE WHEN count(quality) = count(*) THEN sum(quality)::BIGINT END AS total_quality, round(count(quality)::DOUBLE / count(*), 6) AS labelled FROM j GROUP BY g""")
def null_aware_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy((F.col("doc_id") % 200).alias("g")).agg(six(F.avg("quality"), "mean_quality"), total_if_complete("quality").alias("total_quality"), six(ratio(F.count("quality"), F.count("*")), "labelled"))


# --- state ---------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT user_id, CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events WHERE event_type <> 'error'),
f AS (SELECT user_id, min(CASE WHEN ok = 1 AND o <= 20 THEN o END) AS first, count(*) AS n FROM g GROUP BY user_id),
r AS (SELECT f.user_id, f.first, f.n, count(g.o) FILTER (WHERE g.o > f.first AND g.o <= f.first + 30) AS used, count(g.o) FILTER (WHERE g.o > f.first AND g.o <= f.first + 30 AND g.ok = 1) AS more
      FROM f JOIN g ON f.user_id = g.user_id GROUP BY f.user_id, f.first, f.n)
SELECT user_id, (CASE WHEN first IS NULL THEN least(n, 20) ELSE first END)::BIGINT AS first_attempts, first IS NOT NULL AS first_success,
       (CASE WHEN first IS NULL THEN 0 ELSE least(3, 1 + more) END)::BIGINT AS accepted, (CASE WHEN first IS NULL THEN 0 ELSE used END)::BIGINT AS used FROM r""")
def budget_fold(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), "accepted").otherwise("failure")
    rows = table(spark, sf, "events").filter("event_type <> 'error'").select("user_id", "event_id", outcome.alias("outcome"))
    out = task_states(rows, "user_id", ["event_id"], "outcome", Budgets(first=20, after=30, accepted=3))
    return out.select("user_id", *(F.col(c).cast("long").alias(c) if c != "first_success" else F.col(c) for c in ("first_attempts", "first_success", "accepted", "used")))


