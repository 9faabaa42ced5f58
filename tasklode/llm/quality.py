"""Quality rules with repetition measured by a suffix array over the words of a text.

The texts of a step share one suffix array, in which a word is told apart by its text, so that
suffixes of two texts never share a prefix. Prefix doubling keeps only the suffixes that are not
yet alone; the ranks of its rounds give the longest common prefix of neighbours, and with it the
longest repeat that begins at each word. The union of these spans is what repetition covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklode.llm.common import MIX_A, as_bytes, mix, text_steps, two, words

LEAST_WORDS = 10
REPEAT_WORDS = 5
#: Percent of the words that repeats of REPEAT_WORDS or more may cover.
MOST_COVERED = 20
#: A repeat this long is too long if it is also over LONG_PERCENT of the words.
LONG_REPEAT, LONG_PERCENT = 30, 10

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: A byte that begins a character of a word.
WORD_CHAR = np.ones(256, bool)
WORD_CHAR[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False

_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long"


def longest_repeats(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur elsewhere in its text too."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        keys = mix(hashes ^ mix((owner.astype(np.uint64) + np.uint64(1)) * MIX_A))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # one copy is kept of each doubling

    def ranked(order: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks the sorted suffixes by the place of their group's head; True where a group has one member."""
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(order)))
        rank[order] = np.repeat(base[heads], sizes)
        return np.repeat(sizes == 1, sizes)

    sorted_keys = keys[order]
    alone = ranked(order, np.append(True, sorted_keys[1:] != sorted_keys[:-1]), np.arange(n))
    levels, length = [rank.copy()], 1
    active, places = order[~alone], np.flatnonzero(~alone)
    while len(active):
        after = active + length
        inside = after < n
        after[~inside] = 0
        inside &= owner[after] == owner[active]
        second = np.where(inside, rank[after], -1)
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        alone = ranked(active, new, places)
        levels.append(rank.copy())
        length *= 2
        active, places = active[~alone], places[~alone]
    final = np.empty(n, np.int64)
    final[rank] = np.arange(n)
    # longest common prefixes of neighbours, from the longest power of two down
    a, b = final[:-1].copy(), final[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        here = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[here] = levels[j][a[here]] == levels[j][b[here]]
        common[same] += 1 << j
        a[same] += 1 << j
        b[same] += 1 << j
    out = np.zeros(n, np.int64)
    out[final[:-1]] = common
    np.maximum.at(out, final[1:], common)
    return out


def measure(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and longest_repeat of each text."""
    count = len(texts)
    hashes, _, _, owner = words(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, count) + 1)
    begins = np.append(0, ends[:-1])

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, begins, dtype=np.int64)

    repeat = longest_repeats(hashes, owner)
    change = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(repeat >= REPEAT_WORDS)
    np.add.at(change, at, 1)
    np.add.at(change, at + repeat[at], -1)
    covered = np.cumsum(change[:-1]) > 0
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, owner, repeat)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return (
        np.bincount(owner, minlength=count),
        per_text(WORD_CHAR[data]),
        per_text(SYMBOL[data]),
        np.array([len(x) - len(set(x)) for x in lines], np.int64),
        np.bincount(owner[covered], minlength=count),
        longest,
    )


def _fails(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_COVERED)


def _too_long(n_words, longest_repeat):
    return (longest_repeat >= LONG_REPEAT) & (longest_repeat * 100 > n_words * LONG_PERCENT)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay. A null text is empty, and rejected."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, text_col):
                n_words, *_, repeated, longest = measure(as_bytes(part.column(text_col)))
                yield part.filter(pa.array(~_fails(n_words, repeated) & ~_too_long(n_words, longest)))

    return docs.mapInArrow(rows, docs.schema)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row: base_failed and kept.

    The base fails below LEAST_WORDS words or if repeats of REPEAT_WORDS or more cover over
    MOST_COVERED percent of the words; the longest repeat must not be over both LONG_REPEAT words
    and LONG_PERCENT percent of them. A null or empty text has no words and fails. Repeated rows
    and null ids are kept. Empty in, empty out. Memory grows with the words of the longest text
    times the logarithm of its longest repeat.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch):
                columns = measure(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    measured = two(docs, id_col, text_col).mapInArrow(rows, _SCHEMA)
    failed = _fails(F.col("n_words"), F.col("n_repeat_words"))
    too_long = _too_long(F.col("n_words"), F.col("longest_repeat"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~too_long)
