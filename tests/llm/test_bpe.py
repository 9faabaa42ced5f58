import hashlib

import public_tokenizers as P
import pytest
from tasklode.llm import bpe, queries
from tests.llm.shared import AWKWARD, DOCS, docs

MIXED = "Don't stop   the\n\n  tests, é漢字 123456 we'll-see\t\t'revenue' " * 400


def expected(rows):
    enc = bpe.encoding(queries.MULTI_RANKS, P.PATTERN)
    return sorted((d if d is not None else -1, bpe.packed(enc.encode_ordinary(t or ""))) for d, t in rows)


@pytest.mark.parametrize(("size", "overlap"), [(65_536, 2_048), (1_000, 64), (97, 40), (64, 16)])
def test_chunks_give_the_ids_of_the_whole_text(spark, size, overlap):
    rows = [*AWKWARD, (20, MIXED), (20, MIXED), (21, MIXED[7:])]
    out = bpe.encode(docs(spark, rows), queries.MULTI_RANKS, P.PATTERN, size=size, overlap=overlap).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in out) == expected(rows)


def test_decode_restores_the_bytes(spark):
    out = bpe.decode(bpe.encode(docs(spark), queries.MULTI_RANKS, P.PATTERN), queries.MULTI_RANKS, P.PATTERN).collect()
    assert sorted(hashlib.sha256(bytes(r.decoded)).hexdigest() for r in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in AWKWARD)


def test_neighbours_that_share_no_boundary():
    assert bpe.stitch([([], [3, 9]), ([4, 9], [])], 10) == [9]
    assert bpe.stitch([([], [3]), ([4], [])], 10) is None
    assert bpe.stitch([([], [])], 10) == []


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], DOCS), queries.MULTI_RANKS, P.PATTERN).count() == 0
