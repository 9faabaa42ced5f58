"""SentencePiece encoding and decoding that keeps every piece's place in the source.

A text is normalised by the model's own rules: at each position the longest prefix that the compiled
character map knows is replaced (found for all positions at once by walking the map's double array),
white space is escaped, and each byte of the result records where in the source its character began.
The normalised text is cut where no piece of the vocabulary can reach across, equal stretches of a step
are encoded once, and the lengths of the pieces, summed up, are looked up in the record: that gives each
piece's bytes in the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from tasklode.llm.common import STEP_BYTES, text_steps, two

SPACE = "▁"
_SPACE = np.frombuffer(SPACE.encode(), np.uint8)
_NORMAL, _USER_DEFINED, _BYTE = 1, 4, 6
#: Stretches that a worker remembers, and the longest of them in code points.
MOST_KNOWN, LONGEST_KNOWN = 1 << 18, 64


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``data`` one after the other, and the number of each byte's stretch."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    return data[np.arange(len(owner)) - (begins - starts)[owner]], owner


class CharMap:
    """A compiled character map: a double array over UTF-8 bytes, whose values are places of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.strings = np.frombuffer(blob, np.uint8, len(blob) - 4 - size, 4 + size)
        self.ends = np.flatnonzero(self.strings == 0)

    def _offset(self, units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 512) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length in bytes of the longest known prefix at each start (0: none), and its replacement's place."""
        sizes, values = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = np.arange(len(starts))
        node = np.full(len(starts), self._offset(self.units[:1])[0], np.int64)
        depth = 0
        while len(at):
            inside = starts[at] + depth < len(data)
            at, node = at[inside], node[inside]
            byte = data[starts[at] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            fits = (unit & 0x800000FF) == byte
            at, node, unit = at[fits], node[fits], unit[fits]
            node = node ^ self._offset(unit)
            depth += 1
            leaf = (unit >> 8 & 1).astype(bool)
            sizes[at[leaf]] = depth
            values[at[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return sizes, values

    def replacement_sizes(self, values: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, values)] - values


@dataclass(frozen=True)
class Rules:
    """How a model normalises; ``frozen_`` matches its user-defined pieces, which stay as they are."""

    chars: CharMap | None
    prefix: bool
    squeeze: bool
    escape: bool
    frozen_: re.Pattern | None

    @property
    def plain(self) -> bool:
        """Whether a text's parts can be normalised one after the other."""
        return self.chars is None and not self.squeeze and self.frozen_ is None


def _frozen(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Bytes (start, end) of the user-defined pieces of a text, in order."""
    out, done, at = [], 0, 0
    for m in pattern.finditer(text):
        at += len(text[done : m.start()].encode())
        size = len(m.group().encode())
        out.append((at, at + size))
        done, at = m.end(), at + size
    return out


def _visited(starts: np.ndarray, sizes: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which starts a walk from the first reaches, when ``wide`` ones step over those that follow."""
    keep, reach = np.ones(len(starts), bool), -1
    for i in wide.tolist():
        if starts[i] < reach:
            continue
        reach = int(starts[i] + sizes[i])
        keep[i + 1 : int(np.searchsorted(starts, reach))] = False
    return keep


def normalise(text: str, rules: Rules, first: bool = True) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its bytes, and its end, where in the source its character begins.

    ``first`` is false for a later part of a text (of plain rules): no prefix is added there.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    none = np.zeros(1, np.int64)
    if not len(data):
        return "", none
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(np.append(starts, len(data)))
    source, out_sizes, out_starts = data, sizes, starts
    if rules.chars is not None or rules.frozen_ is not None:
        found, values = rules.chars.longest(data, starts) if rules.chars is not None else (np.zeros(len(starts), np.int64),) * 2
        found = found.copy()
        kept = found == 0
        sizes = np.where(kept, sizes, found)
        for a, b in _frozen(text, rules.frozen_) if rules.frozen_ is not None else ():
            at = int(np.searchsorted(starts, a))
            # a match counts only if the walk stands there; it then wins over the map
            sizes[at], kept[at] = b - a, True
        wide = np.flatnonzero(sizes > np.diff(np.append(starts, len(data))))
        keep = _visited(starts, sizes, wide)
        starts, sizes, kept, values = starts[keep], sizes[keep], kept[keep], values[keep]
        out_starts, out_sizes = starts.copy(), sizes.copy()
        if not kept.all():
            source = np.concatenate((data, rules.chars.strings))
            out_starts[~kept] = values[~kept] + len(data)
            out_sizes[~kept] = rules.chars.replacement_sizes(values[~kept])
    raw, owner = (data, np.repeat(np.arange(len(starts)), sizes)) if source is data and len(starts) and out_starts is starts else gather(source, out_starts, out_sizes)
    origin = starts[owner]
    blank = raw == 0x20
    end, lead = len(data), 0
    if rules.squeeze:
        # single spaces before all else are passed over, then white space after white space
        ones = np.flatnonzero(~((out_sizes == 1) & (source[np.minimum(out_starts, len(source) - 1)] == 0x20)))
        if not len(ones):
            return "", none
        lead = int(starts[ones[0]])
        number = np.arange(len(raw))
        last_solid = np.maximum.accumulate(np.where(blank, -1, number))
        heading = last_solid < (np.cumsum(out_sizes) - out_sizes)[owner]
        drop = blank & heading & np.append(True, blank[:-1])
        raw, origin, blank = raw[~drop], origin[~drop], blank[~drop]
    if rules.escape:
        widths = np.where(blank, 3, 1)
        origin = np.repeat(origin, widths)
        wide = np.repeat(raw, widths)
        at = (np.cumsum(widths) - widths)[blank]
        for k in range(3):
            wide[at + k] = _SPACE[k]
        raw = wide
    if rules.prefix and first:
        head = _SPACE if rules.escape else np.frombuffer(b" ", np.uint8)
        raw, origin = np.concatenate((head, raw)), np.concatenate((np.full(len(head), lead), origin))
    if rules.squeeze:
        tail = SPACE.encode() if rules.escape else b" "
        flat, size = raw.tobytes(), len(raw)
        while size >= len(tail) and flat[size - len(tail) : size] == tail:
            size -= len(tail)
            end = int(origin[size])
        raw, origin = raw[:size], origin[:size]
    return raw.tobytes().decode(), np.append(origin, end)


class Encoder:
    """A model with its normalisation apart, so that a piece's place is known."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.treat_whitespace_as_suffix:
            raise ValueError("white space after words isn't supported")
        frozen_ = sorted((p.piece for p in proto.pieces if p.type == _USER_DEFINED), key=len, reverse=True)
        self.rules = Rules(
            CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None,
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces,
            re.compile("|".join(map(re.escape, frozen_))) if frozen_ else None,
        )
        self.bytes = trainer.byte_fallback
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
        self.cuts = trainer.model_type == trainer.BPE and self.bytes and spec.escape_whitespaces and not inner
        self.sizes = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in proto.pieces])
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.spaces = np.array([p.piece.count(SPACE) for p in proto.pieces])
        self.known: dict[str, dict[str, bytes]] = {}

    def stretches(self, text: str) -> list[str]:
        """Parts of a normalised text that are encoded apart: no piece has white space behind other characters."""
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text) if self.cuts else [text] if text else []

    def ids_of(self, stretches: list[str], head: str = "") -> np.ndarray:
        """Ids of all stretches, one after the other; each of them begins with ``head``, which isn't repeated there."""
        known = self.known.setdefault(head, {})
        if len(known) > MOST_KNOWN:
            known.clear()
        new = [s for s in set(stretches) if s not in known]
        found = self.own.encode([head + s for s in new], num_threads=1)
        packed = np.fromiter(chain.from_iterable(found), np.int32).tobytes()
        ends = np.cumsum([4 * len(x) for x in found]).tolist()
        known.update(zip(new, (packed[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        ids = np.frombuffer(b"".join(map(known.__getitem__, stretches)), np.int32)
        for s in new:
            if len(s) > LONGEST_KNOWN:
                del known[s]
        return ids

    def ids_and_sizes(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the bytes of normalised text that each stands for."""
        if self.bytes:
            ids = self.ids_of(stretches)
            return ids, self.sizes[ids]
        pieces = [p.encode() for s in stretches for p in self.own.encode(s, return_type=str)]
        ids = list(chain.from_iterable(map(self.own.encode, stretches)))
        return np.array(ids, np.int32), np.array([len(p) for p in pieces], np.int64)

    def parts(self, text: str) -> Iterator[str]:
        """``text`` in parts of about a step's size that give the ids of the whole; one part if the rules don't allow a cut."""
        start = 0
        while self.cuts and self.rules.plain and len(text) - start > STEP_BYTES:
            m = re.compile(rf"[^ {SPACE}](?= )").search(text, start + STEP_BYTES)
            if not m:
                break
            yield text[start : m.end()]
            start = m.end()
        yield text[start:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end of each in its own text's bytes, and the number of ids of each text."""
        if self.cuts and self.rules.plain and self.rules.prefix and not any(SPACE in x for x in texts):
            return self._encode_plain(texts)
        return self._encode_by_record(texts)

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where only spaces change, each to the one mark, the record is their number: a piece's marks are a byte each in the source,
        the first one none. What begins or ends within a character goes back to where that begins."""
        found, stretches, size = [], [], 0
        for text in texts:
            for k, part in enumerate(self.parts(text)):
                part = part[1:] if k else part
                if "  " in part or part[:1] == " ":
                    stretches += [x[1:] for x in self.stretches(SPACE + part.replace(" ", SPACE))]
                elif part or k:
                    stretches += part.split(" ")
                size += len(part)
                if size > STEP_BYTES:
                    found.append(self.ids_of(stretches, SPACE))
                    stretches, size = [], 0
        ids = np.concatenate([*found, self.ids_of(stretches, SPACE)])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        upto = np.cumsum([len(x.encode()) for x in texts]) if texts else np.zeros(0, np.int64)
        there = np.array([bool(x) for x in texts], bool)
        # one byte more for each text so far, the mark before it
        marked = upto + np.cumsum(there)
        sizes = self.sizes[ids] - 2 * self.spaces[ids]
        ends = np.cumsum(sizes)
        counts = np.diff(np.append(0, np.searchsorted(ends, marked, "right")))
        counts[~there] = 0
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = np.append(0, upto[:-1]) if len(texts) else upto
        shift = np.cumsum(there)[owner]
        stops, begins = ends - shift, np.maximum(ends - sizes - shift, starts[owner])
        data = np.append(data, np.uint8(0))
        for _ in range(3):
            stops, begins = (x - ((data[x] & 0xC0) == 0x80) for x in (stops, begins))
        return ids, begins - starts[owner], stops - starts[owner], counts

    def _encode_by_record(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = [(i, k > 0, part) for i, text in enumerate(texts) for k, part in enumerate(self.parts(text))]
        made = [normalise(part, self.rules, not later) for _, later, part in parts]
        cut = [self.stretches(norm) for norm, _ in made]
        ids, sizes = self.ids_and_sizes(list(chain.from_iterable(cut)))
        ends = np.cumsum(sizes)
        places = np.array([len(origin) - 1 for _, origin in made], np.int64)
        upto = np.searchsorted(ends, np.cumsum(places), "right")  # ids of the parts so far
        counts = np.diff(np.append(0, upto))
        owner = np.repeat(np.arange(len(parts)), counts)
        base, before, shift = np.zeros(len(parts), np.int64), 0, 0
        table = []
        for k, ((_, later, part), (_, origin)) in enumerate(zip(parts, made, strict=True)):
            shift = shift if later else 0
            base[k] = before
            before += len(origin)
            table.append(origin + shift)
            shift += len(part.encode())
        table = np.concatenate(table) if table else np.zeros(0, np.int64)
        first = (np.cumsum(places) - places)[owner]
        begins = table[ends - sizes - first + base[owner]]
        stops = table[ends - first + base[owner]]
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, [i for i, _, _ in parts], counts)
        return ids, begins, stops, total


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """Once per worker."""
    return Encoder(path)


def _ints(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _with_end(values: np.ndarray, counts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``values`` with one more at the end of each text."""
    return np.insert(values, np.cumsum(counts), last)


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, begins, ends): the ids of each whole text as the library gives them, with each id's bytes in the text.

    One row per input row; null texts are empty, null ids are kept, equal rows give equal rows and an empty table
    gives an empty one. ``end`` adds the end id, which stands for no bytes at the text's end. Of the bytes that stand
    for one character the last has its place and those before begin and end where it begins. Long texts are encoded
    in parts, if the model allows that without a change of ids (those without a map, like the given one, do).
    ``decoded`` adds a column of that name as ``decode`` does, in the same pass.
    """
    names = ["doc_id", "ids", "begins", "ends"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in text_steps(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids, begins, ends, counts = enc.encode(texts)
                if end:
                    sizes = np.array([len(x.encode()) for x in texts], np.int64)
                    ids, begins, ends = (_with_end(v, counts, last) for v, last in ((ids, enc.model.eos_id()), (begins, sizes), (ends, sizes)))
                    counts = counts + 1
                columns = [part.column("doc_id"), *(_ints(v, counts) for v in (ids, begins, ends))]
                if decoded:
                    upto = np.append(0, np.cumsum(counts)).tolist()
                    columns.append(pa.array([enc.model.decode(ids[a:b].tolist()) for a, b in zip(upto, upto[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "decoded"][: len(columns)])

    return two(docs, id_col, text_col).mapInArrow(rows, ENCODED + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (in place of one of that name): the library's text of the ids. Null ids give null."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path).model
        for batch in batches:
            out = [None if x is None else model.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded string")
