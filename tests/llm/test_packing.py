import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tasklode.llm import packing, queries
from tests.llm.shared import AWKWARD, DOCS, docs
from tokenizers import Tokenizer


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_needs_no_more_sequences_than_best_fit_over_pieces(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 64), rnd.randint(1, 12), 64, 33]) for _ in range(rnd.choice([1, 40, 500]))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    runs = packing.plan(counts, 64)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        for j in range(n):
            held[first + j].append((offset, length))
            ranks[length].append(rank + j)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) <= brute_best_fit(lengths, 64)


def test_plan_does_not_grow_with_the_counts():
    counts = {n: 1 + n % 7 for n in range(1, 2049)}
    small, large = packing.plan(counts, 2048), packing.plan({n: c * 10_000 for n, c in counts.items()}, 2048)
    assert len(large) < 3 * len(small) < 100_000


def test_blocks_of_ranks():
    counts = {n: 1 + n * 37 % 900 for n in range(1, 65)}
    runs = packing.plan(counts, 64)
    width = packing.widths(runs, counts)
    placed = packing.by_block(runs, width)
    assert len(runs) <= len(placed) <= 2 * len(runs)
    for length, n in counts.items():
        for rank in range(0, n, 7):
            hits = [r for r in placed if r[0] == length and r[1] == rank // width[length] and r[2] <= rank < r[2] + r[3]]
            assert len(hits) == 1


def test_pieces_and_places(spark):
    rows = [*AWKWARD, *((100 + i, "same text") for i in range(300))]
    out = packing.pack(docs(spark, rows), queries.RANKS, P.PATTERN).toPandas()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        want += [(-1 if d is None else d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = out.fillna({"doc_id": -1})
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).to_numpy().tolist())) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all() and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= brute_best_fit(out.length, 2048)


def test_added_tokens_inside_texts(spark):
    mark = "<|endoftext|>"
    rows = list(enumerate([f"a {mark} b", mark, f"{mark}{mark}", f"one \n{mark}\n two  {mark}", "<|endoftext|", f"<{mark}>", f"{'word ' * 3_000}{mark}" * 3]))
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for d, t in rows:
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want[d] = [(b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = defaultdict(list)
    for r in packing.pack(docs(spark, rows), queries.RANKS, P.PATTERN).orderBy("doc_id", "piece").collect():
        got[r.doc_id].append((r.length, r.ids_crc32))
    assert got == want and own.encode(rows[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_a_plan_too_long_to_ship_is_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_RUNS", 0)
    rows = [(None, "same text")] * 200 + [(i, "word " * (i % 30)) for i in range(200)]
    out = packing.pack(docs(spark, rows), queries.RANKS, P.PATTERN, capacity=64).toPandas()
    assert len(out) == 400 and out.groupby("sequence_id").length.sum().max() <= 64
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all()


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), queries.RANKS, P.PATTERN).count() == 0
