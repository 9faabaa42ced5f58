import hashlib
import random
import re
import zlib

import pytest
from tasklode.llm import prefix_trie, queries
from tests.llm.shared import needs_testdata

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows, rebuild=True):
    """Brute force: prefixes as tuples, subtrees by looking at every node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role.encode(), digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    if rebuild:
        rest = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        base = {c: c - (abs(c) % 20) * (1 if c >= 0 else -1) for c in own}
        own = {c: own.get(base[c], [])[: rest[c]] + turns[rest[c] :] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, members in nodes.items():
        d = len(prefix)
        below = [p for p in nodes if p[:d] == prefix]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        leaves = sum(all(len(q) <= len(p) for q in below if q[: len(p)] == p) for p in below)
        ends = ",".join(str(c) for c in sorted(members) if len(own[c]) == d)
        parent = min(nodes[prefix[:-1]]) if d else None
        out.add((min(members), d, parent, len(members), sum(len(p) == d + 1 for p in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(df, rebuild=True):
    turns, lengths = prefix_trie.ordered(df)
    if rebuild:
        turns, lengths = prefix_trie.shared_heads(turns, lengths)
    else:
        turns = turns.join(lengths, "c")
    out = prefix_trie.trie(turns, lengths)
    assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in out.dtypes) == prefix_trie.NODES
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talk(rng, c, n):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b b", "c\tc c"])) for t in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [r for c in [*range(0, 90), 200, 345, -3, -20, -41] for r in talk(rng, c, rng.choice([0, 1, 2, 3, 4, 7, 9]))]
    assert nodes_of(spark.createDataFrame(rows, SCHEMA).repartition(5)) == slow(rows)


def test_one_long_conversation_among_copies(spark, monkeypatch):
    """Lengths around powers of two; blocks of turns small enough that sums cross them."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rng = random.Random(4)
    long = [("user", str(rng.randrange(3))) for _ in range(70)]
    rows = [(c, t, *x) for c, n in enumerate([70, 64, 63, 33, 32, 31, 17, 16, 15, 8, 7, 5, 4, 3, 2, 1, 70, 70]) for t, x in enumerate(long[:n])]
    rows += [(100, t, *x) for t, x in enumerate([*long[:40], ("user", "other"), *long[:20]])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes_of(df, rebuild=False) == slow(rows, rebuild=False)
    assert nodes_of(df) == slow(rows)


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [
        (0, None, "user", None), (0, 1, None, "x y"), (0, 1, None, "x y"), (0, 1, "user", "x"), (0, 2, None, None), (1, None, "user", ""), (1, 1, "", "x y"),
        (None, 0, "user", "nobody's"), (2, 5, "user", "Größe 漢字"), (2, 5, "user", "long " * 5_000), (20, 0, "a", "b"), (21, 0, "", ""), (40, 0, None, None), (41, 7, "", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS c", "2 AS pos", "3 AS name", "'x' AS key", "4 AS depth", "5 AS part")
    assert nodes_of(df) == slow(rows) and nodes_of(df, rebuild=False) == slow(rows, rebuild=False)


def test_conversations_without_turns_are_at_the_root(spark):
    """Ids whose own turns all go and whose group has no first conversation."""
    ids = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = nodes_of(spark.createDataFrame(rows, SCHEMA))
    assert got == slow(rows) == {(ids[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())}


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_no_conversations(spark, rows):
    assert nodes_of(spark.createDataFrame(rows, SCHEMA)) == set()


def test_ids_of_one_node_over_many_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(500).selectExpr("id % 2 AS conv_id", "3L AS depth", "id * 7 % 500 - 9 AS c")
        got = {(r.conv_id, r.ends_sha256) for r in prefix_trie._digests(ends.repartition(6)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, hashlib.sha256(",".join(map(str, sorted(i * 7 % 500 - 9 for i in range(k, 500, 2)))).encode()).hexdigest()) for k in (0, 1)}
    assert got == want


@needs_testdata
def test_query_equals_duckdb_and_brute_force(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    df = queries.op13_prefix_trie(spark, path)
    got = {tuple(r) for r in df.collect()}
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op13_prefix_trie']})").fetchall()
    assert got == slow(rows) == set(want)
