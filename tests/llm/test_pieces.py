import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tasklode.llm import pieces, queries
from tests.llm.shared import AWKWARD, DOCS, docs, needs_testdata

MODEL = queries.PIECES
ROWS = [*AWKWARD, (20, "  a  b "), (21, "▁x ▁▁ y▁"), (22, "</s> <unk> <0x0A> <s>"), (23, "a\x00b​ �\r\n"), (24, "x " * 400_000 + "漢" * 900)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def slow(library, text):
    """(id, begin, end) as the library has them, with the end id."""
    found = [(p.id, p.begin, p.end) for p in library.encode_as_proto(text or "").pieces]
    size = len((text or "").encode())
    return [*found, (library.eos_id(), size, size)]


def test_ids_and_places_are_the_librarys(spark, library):
    out = pieces.encode(docs(spark, ROWS), MODEL).collect()
    got = sorted(((r.doc_id is not None, r.doc_id or 0), list(zip(r.ids, r.begins, r.ends, strict=True))) for r in out)
    want = sorted(((d is not None, d or 0), slow(library, t)) for d, t in ROWS)
    assert got == want


def test_random_texts_in_steps(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ▁漢\n é𐍈.1  ") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for texts in (texts, [t.replace("▁", "") for t in texts]):
        _held(library, texts)


def _held(library, texts):
    ids, begins, ends, counts = pieces.Encoder(MODEL).encode(texts)
    found = list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))
    at = np.append(0, np.cumsum(counts))
    assert [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [slow(library, t)[:-1] for t in texts]


def test_parts_of_a_long_text(library, monkeypatch):
    monkeypatch.setattr(pieces, "STEP_BYTES", 50)
    enc = pieces.Encoder(MODEL)
    text = "Größe über  çà 漢字 \U0001f600 don't\t12345\n ▁ x " * 40 + "tail" * 30
    assert len(list(enc.parts(text))) > 20
    _held(library, ["first", text, ""])
    _held(library, ["first", text, "", text])


def test_known_stretches_are_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KNOWN", 3)
    enc = pieces.Encoder(MODEL)
    for k in range(9):
        text = f"new words {k} each time " + "y" * 200
        assert enc.encode([text])[0].tolist() == library.encode(text) and not any(len(s) > pieces.LONGEST_KNOWN for k in enc.known.values() for s in k)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize(("prefix", "escape", "squeeze"), [(True, True, True), (False, True, False), (True, False, True), (False, True, True)])
def test_map_and_alignment_are_the_librarys(rule, prefix, escape, squeeze):
    """Longest prefixes through compiled maps, over characters that contract, expand, vanish or combine."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=squeeze)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    chars = pieces.CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
    rules, rng = pieces.Rules(chars, prefix, squeeze, escape, None), random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice("ab  　​¨ｶﾞﾊﾟéé①ﬁǺ漢𐍈\t\n▁ Ｘß가가") for _ in range(rng.randrange(14)))
        got, origin = pieces.normalise(text, rules)
        data = np.frombuffer(got.encode(), np.uint8)
        chars_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        places = [len(text.encode()[:x].decode(errors="ignore")) for x in origin[chars_at].tolist()]
        assert (got, places) == tuple(library.normalize(text, with_offsets=True))


def test_models_with_a_map_and_own_pieces(tmp_path, library):
    """The given pieces under other rules: a map, squeezed white space and user-defined pieces."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    proto.normalizer_spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    proto.pieces.add(piece="[ﬁx]", type=4, score=0)
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    other, enc = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Encoder(str(path))
    assert not enc.rules.plain
    for text in ("  ﬁne  [ﬁx] ① ｶﾞ [ﬁx]x ", "", "   ", "[ﬁx]", "a　[ﬁx]​"):
        ids, begins, ends, _ = enc.encode([text])
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == slow(other, text)[:-1]


def test_decode_is_the_librarys(spark, library):
    want = sorted((d if d is not None else -1, library.decode(library.encode(t or "", add_eos=True))) for d, t in ROWS)
    kept = pieces.encode(docs(spark, ROWS), MODEL).selectExpr("*", "'x' AS decoded")
    for out in (pieces.decode(kept, MODEL), pieces.encode(docs(spark, ROWS), MODEL, decoded=True)):
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded) for r in out.collect()) == want
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).first().decoded is None


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], DOCS), MODEL).count() == 0


@needs_testdata
def test_query_over_the_given_texts(spark, library):
    path = "/root/testdata/sf0.001"
    given = pd.read_parquet(f"{path}/documents.parquet", columns=["doc_id", "text"])
    want = []
    for d, t in zip(given["doc_id"], given["text"], strict=True):
        ids = library.encode(t or "", add_eos=True)
        text = library.decode(ids).encode()
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert sorted(tuple(r)[:4] for r in queries.op12_pieces(spark, path).collect()) == sorted(want)


def test_places_cover_the_text():
    """Pieces follow each other without gaps."""
    text = " Größe  漢字 x\n"
    _, begins, ends, _ = pieces.Encoder(P.path("piece_bpe_32k.model")).encode([text])
    assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()
