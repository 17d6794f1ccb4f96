"""The SentencePiece encoder against its library: ids, spans, decoded texts, and character maps."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from rankforge.llm.piece_model import Normaliser, PieceModel
from rankforge.llm.sentence_pieces import encode_pieces, piece_digest

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
SHARDS = ["a", "b", " ", "  ", "▁", "the", "é", "é", "日本", "😀", "\n", "\t", "ﬁ", "①", "\xa0", "　", "<s>", "</s>", "<0x0A>", "x" * 20, "Ω", "�", "​", "\r\n", "123", "²."]


def texts(n, seed=1):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(SHARDS) for _ in range(rnd.randrange(0, 30))) for _ in range(n)]
    point = lambda: rnd.choice([rnd.randrange(32, 127), rnd.randrange(1, 0xD800), rnd.randrange(0xE000, 0x110000)])
    return made + ["".join(chr(point()) for _ in range(rnd.randrange(0, 20))) for _ in range(n)] + ["", " ", "▁", "a" * 5000, "日" * 3000, " " * 999]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_spans_and_decoding_equal_the_library(library):
    model = PieceModel(PATH)
    for t in texts(1500):
        ids, begins, ends = model.encode(t)
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids)
        raw = t.encode()
        assert [raw[b:e].decode("utf-8", "replace") for b, e in zip(begins, ends)] == [p.surface for p in library.encode(t, return_type="proto").pieces]
        assert not ids or (begins[0] == 0 and ends[-1] == len(raw) and begins[1:] == ends[:-1])
    rnd = random.Random(2)
    for _ in range(3000):
        ids = [rnd.randrange(0, 300) if rnd.random() < 0.6 else rnd.randrange(32000) for _ in range(rnd.randrange(0, 12))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_equal_the_library(rule, squeeze):
    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    own = Normaliser(proto.normalizer_spec, [])
    for t in texts(700, 5):
        made, source = own.normalise(t)
        assert made.decode() == n.normalize(t)
        assert len(source) == len(made) + 1 and source == sorted(source) and source[-1] <= len(t.encode())


@pytest.mark.parametrize("fallback", [True, False])
def test_model_with_a_character_map_and_user_symbols(library, fallback):
    """Another normalisation, user-defined symbols and unknown characters, in the same vocabulary."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    other = sentencepiece_model_pb2.ModelProto()
    other.ParseFromString(n.serialized_model_proto())
    proto.normalizer_spec.CopyFrom(other.normalizer_spec)
    proto.trainer_spec.byte_fallback = fallback
    if not fallback:
        del proto.pieces[3:259]
    proto.pieces.add(piece="<0x", score=0.0, type=4)
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = PieceModel.from_proto(proto)
    for t in texts(300, 9):
        ids, begins, ends = model.encode(t)
        assert ids == lib.encode(t)
        raw = t.encode()
        assert [raw[b:e].decode("utf-8", "replace") for b, e in zip(begins, ends)] == [p.surface for p in lib.encode(t, return_type="proto").pieces]
        assert model.decode(ids) == lib.decode(ids)


def test_operator_and_digest(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(60, 4))] + [(None, "null id"), (3, None), (3, None), (4, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("_id"), F.lit("x").alias("ids"), F.lit("y").alias("_text"), F.lit("z").alias("decoded"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())))
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in piece_digest(df, PATH).collect()], key=lambda r: (r[0] is None, r[0] or 0, r[2])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    made = {r.doc_id: r for r in encode_pieces(df.where("doc_id < 100 AND doc_id <> 3 AND doc_id <> 4"), PATH, end=False).collect()}
    for i, t in rows:
        if i is not None and i < 100 and i not in (3, 4):
            assert list(made[i].ids) == library.encode(t) and made[i].decoded == library.decode(library.encode(t))
            raw = t.encode()
            assert [raw[b:e].decode("utf-8", "replace") for b, e in zip(made[i].begins, made[i].ends)] == [p.surface for p in library.encode(t, return_type="proto").pieces]
    assert piece_digest(df.where("false"), PATH).collect() == []
