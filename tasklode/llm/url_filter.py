"""URL filters: a trie over reversed host labels and path segments, the longest match wins.

The trie is shipped to the workers only while it has at most ``MOST_BROADCAST`` rules; a longer
list is joined by the hosts' suffixes instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BROADCAST = 200_000
#: Rule: verdict, host, path. The path starts with a slash.
Rule = tuple[str, str, str]


def parse_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    """'allow org/' or 'block example.org/es/': the host is what stands before the first slash."""
    out = []
    for line in lines:
        verdict, _, rule = line.strip().partition(" ")
        host, slash, path = rule.strip().partition("/")
        if verdict not in ("allow", "block") or not slash or not host:
            raise ValueError(f"no rule: {line!r}")
        out.append((verdict, host.lower(), slash + path))
    return tuple(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[end:] if rest[end : end + 1] == "/" else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, path[: min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))]


class Trie:
    """Nodes by reversed host label, then by whole path segment; a rule ends in a rest that is a
    prefix of what remains of the path (empty if the rule ends with a slash).

    Longer hosts win over shorter ones, then longer paths; of equal rules, block wins.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label is a slash
            *segments, rest = path[1:].split("/")
            for segment in segments:
                node = node.setdefault((segment,), {})
            old = node.setdefault("", {}).get(rest)
            node[""][rest] = ("block" if old and old[0] == "block" else verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._match_path(node.get("/"), path) or best
        return best

    @staticmethod
    def _match_path(node: dict | None, path: str) -> tuple[str, str] | None:
        best, left = None, path[1:]
        while node is not None and path:
            fits = [r for r in node.get("", ()) if left.startswith(r)]
            if fits:
                best = node[""][max(fits, key=len)]
            segment, slash, left = left.partition("/")
            node = node.get((segment,)) if slash else None
        return best


@cache
def _trie(rules: tuple[Rule, ...]) -> Trie:
    return Trie(rules)


def _joined(parts: DataFrame, rules: tuple[Rule, ...], default: str) -> DataFrame:
    """As the trie, by a join on host suffixes; for lists too long to ship."""
    spark = parts.sparkSession
    table = spark.createDataFrame(list(rules), "r_verdict string, r_host string, r_path string").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = parts.select("host", "path").distinct().withColumn("r_host", F.explode(suffixes))
    best = (
        keys.join(table, "r_host")
        .filter(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("r_verdict", F.concat("r_host", "r_path").alias("rule")), F.struct(F.char_length("r_host"), F.char_length("r_path"))).alias("hit"))
    )
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.r_verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    Where no rule fits, the verdict is ``default``. A null url or one without ``://`` has an empty
    host and path. Repeated rows and null ids are kept. Empty in, empty out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(rules) if len(rules) <= most_broadcast else Trie(())
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hits = [trie.match(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    pa.array([h and h[1] for h in hits], pa.string()),
                    pa.array([h[0] if h else default for h in hits], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    if len(rules) > most_broadcast:
        shipped, rules = rules, ()
        return _joined(rows.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string"), shipped, default)
    return rows.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")
