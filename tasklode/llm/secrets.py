"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of a text.

A rule has a base form, whose leftmost non-overlapping matches are taken, and the form that a match
must have to be kept (its least length). The combined automaton reads each byte once, from the last to
the first, and accepts where a match of a rule begins, with the rules that begin there. So every
begin is known to lead to a match; from the leftmost on, each match is followed to its end by the
automaton of its rule, and begins inside it are passed over. Only the bytes of matches (and the one
after them) are read again, so the work grows with the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tasklode.llm.automata import Dfa, begins, compile_rules, longest, matches_whole
from tasklode.llm.common import as_bytes, text_steps, two, with_column

SPANS = "array<struct<kind: string, start: long, end: long>>"


def nocase(word: str) -> str:
    """``word`` with its letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``kept`` is what a match of ``base`` must look like as a whole.

    ``begins`` is what each match of ``base`` begins with (or at least each kept one, if those that it
    leaves out can't overlap them). It is as long as keeps the automaton small: a counted run in which a
    second match can begin multiplies the states.
    """

    kind: str
    base: str
    kept: str
    begins: str


def _run(kind: str, head: str, run: str, least: int, scanned: int = 1) -> Rule:
    return Rule(kind, f"{head}{run}+", f"{head}{run}{{{least},}}", f"{head}{run}{{{scanned}}}")


_NAMES = "|".join(map(nocase, ("password", "passwd", "secret", "token"))) + f"|{nocase('api')}_?{nocase('key')}"
#: The kinds of the contract, in its order.
BASE_RULES = (
    _run("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8),
    _run("access", "AKIA", "[A-Z0-9]", 12),
    _run("hex", "", "[0-9a-f]", 32, 32),
)
#: Public formats of further credentials.
MORE_RULES = (
    _run("forge", "gh[pousr]_", "[A-Za-z0-9]", 36),
    _run("maps", "AIza", "[A-Za-z0-9_-]", 35),
    _run("chat", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    _run("pay", "[sr]k_live_", "[A-Za-z0-9]", 16),
    _run("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 10),
    Rule("pem", *["-----BEGIN [A-Z ]*PRIVATE KEY-----"] * 3),
)
RULES = BASE_RULES + MORE_RULES


@lru_cache(4)
def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """The combined automaton, and each rule's base and kept form; once per worker."""
    return (
        compile_rules([r.begins for r in rules], anywhere=True, backwards=True),
        [compile_rules([r.base], anywhere=False) for r in rules],
        [compile_rules([r.kept], anywhere=False) for r in rules],
    )


def scan(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule's index, end) in bytes, by start, then rule."""
    combined, base, kept = automata(rules)
    done, codes = [0] * len(rules), {}
    out = []
    for at, bits in reversed(begins(combined, data)):
        for i in range(bits.bit_length()):
            if bits >> i & 1 and at >= done[i]:
                if i not in codes:
                    codes[i] = data.translate(base[i].classes)
                done[i] = longest(base[i], codes[i], at)
                if matches_whole(kept[i], data[at : done[i]]):
                    out.append((at, i, done[i]))
    return sorted(out)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points; a match's ends are never inside a character."""
    place, at, chars = {}, 0, 0
    for b in sorted({x for a, _, e in spans for x in (a, e)}):
        chars += len(data[at:b].decode("utf-8", "replace"))
        place[b], at = chars, b
    return [(place[a], i, place[e]) for a, i, e in spans]


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: kind, start and end in code points, by start, then rule.

    A null or empty text has no spans. Repeated rows and null ids are kept. Empty in, empty out.
    Spans of two kinds can overlap, those of one can't; a very long text takes as many steps as bytes.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch):
                found = []
                for data in as_bytes(part.column("text")):
                    spans = scan(data, rules)
                    found.append([{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in in_code_points(data, spans)] if spans else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return two(docs, id_col, text_col).mapInArrow(rows, f"doc_id long, spans {SPANS}")


def masked(text: str | None, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> str | None:
    """The text with each run of overlapping or touching spans replaced by ``mark``."""
    data = (text or "").encode()
    pieces, at = [], 0
    for a, _, b in scan(data, rules):
        if a > at or not pieces:
            pieces += [data[at:a], mark.encode()]
        at = max(at, b)
    return b"".join([*pieces, data[at:]]).decode("utf-8", "replace") if pieces else text


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in their text masked; all columns stay, a null text stays null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, text_col):
                texts = [masked(t, rules, mark) for t in part.column(text_col).to_pylist()]
                yield with_column(part, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(rows, docs.schema)
