"""The operators as registered queries with production parameters, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklode.llm import bpe, fingerprint, html_extract, ngram_join, packing, pieces, prefix_trie, quality, secrets, suffix_dedup, toxicity, url_filter, whitening
from tasklode.session import table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The ids of byte_bpe_50k.json: the same vocabulary, as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
URL_RULES = url_filter.parse_rules(("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, PATTERN)
    return bpe.decode(ids, MULTI_RANKS, PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts linked by four-word shingles at a similarity of 0.85."""
    return ngram_join.link_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: counts of the base kinds, their digest, and all spans."""
    found = secrets.find(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated strings of 200 bytes."""
    return suffix_dedup.measure(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, repetition and verdict of every text."""
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learnt from labels outside fold 0."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whitened on eight components of the covariance of all."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every text, as digests; spans_hash is of the ids' places in the text."""
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, after groups of twenty took over shared heads."""
    return prefix_trie.trie(*prefix_trie.shared_heads(*prefix_trie.ordered(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_secrets": op4_secrets,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprint": op10_fingerprint,
    "op11_whitening": op11_whitening,
    "op12_pieces": op12_pieces,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op7_url_filter": r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN ''
              ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
hosts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM parts),
named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(path, '') AS path
  FROM hosts),
ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' END AS rule
  FROM named)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    # CRC-32 bit by bit over the decimal id's characters
    "op13_prefix_trie": r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY pos) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, c - c % 20 AS base,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
              lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 4 AS h
      FROM own),
rebuilt AS (SELECT h.c, list_concat(coalesce(o.turns[1 : h.h], []), h.turns[h.h + 1 :]) AS turns FROM h LEFT JOIN own o ON o.c = h.base),
p AS (SELECT c, len(turns) AS n, d, turns[1 : d] AS prefix FROM rebuilt, range(0, (SELECT max(len(turns)) + 1 FROM rebuilt)) q(d) WHERE d <= len(turns)),
nodes AS (SELECT prefix, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(n) = any_value(d) AS leaf,
            (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(prefix)[-1].x, ''), '[^\x20\x09-\x0D]+')) AS saved,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
          FROM p GROUP BY prefix),
up AS (SELECT n.prefix[1 : d] AS prefix, sum(leaf::INT) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (WHERE depth = d + 1) AS n_children
       FROM nodes n, range(0, (SELECT max(depth) + 1 FROM nodes)) q(d) WHERE d <= n.depth GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, up.n_children, up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up ON up.prefix = n.prefix LEFT JOIN nodes o ON n.depth > 0 AND o.prefix = n.prefix[1 : n.depth - 1]""",
}
