"""Encoding against the library, by texts made of pieces, odd characters and long runs."""

import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from tallyframe.llm import pieces, queries  # noqa: E402

PATH = tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", " ", "  ", "▁", "\n", "\t", "\r", "é", "́", "😀", "中", "e", "th", " the", "ing", "\x00", "<0x0A>", "<s>", "\xa0",
       "​", "ﬁ", "ab", "aa", "1", "'", "\x85", "\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(PATH)


def test_random_texts(vocab, library):
    rnd, encoder = random.Random(11), pieces.Encoder(vocab)
    own = list(vocab.pieces)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rnd.choice(own).replace("▁", rnd.choice([" ", "▁", ""])) for _ in range(rnd.randint(1, 8))) for _ in range(4000)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t), t
        assert pieces.spell(vocab, ids) == library.decode(ids), t


def test_any_ids_decode_like_the_library(vocab, library):
    rnd = random.Random(5)
    for _ in range(2000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(300) for _ in range(rnd.randint(0, 9))]
        assert pieces.spell(vocab, ids) == library.decode(ids), ids


def test_long_parts_and_full_memory(vocab, library, monkeypatch):
    text = "x" * 50_000 + " " * 3_000 + "aé" * 20_000 + "\U0001f600" * 500
    assert pieces.Encoder(vocab).encode(text) == library.encode(text)
    monkeypatch.setattr(pieces, "MEMO", 3)
    encoder = pieces.Encoder(vocab)
    for t in ("one two three four five", "six seven one two", "one"):
        assert encoder.encode(t) == library.encode(t)


def test_every_prefix_has_its_own_last_token(vocab):
    encoder = pieces.Encoder(vocab)
    part = "▁internationalisation"
    last = encoder.last_tokens(part)
    assert [last[k] for k in range(1, len(part) + 1)] == [encoder.merged(part[:k])[-1] for k in range(1, len(part) + 1)]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "m"))


def test_frames(spark, vocab, library):
    data = [(1, None, "i"), (2, "", "i"), (3, "two words", "i"), (3, "two words", "i"), (None, "naïve\n", "i")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(docs, vocab), vocab)
    want = [(i, library.encode(t or ""), t or "") for i, t, _ in data]
    assert sorted(map(str, [(r.doc_id, r.ids, r.text) for r in got.collect()])) == sorted(map(str, want))
    assert pieces.encode(docs.limit(0), vocab).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), vocab).first().text is None


def test_query_matches_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = queries.op11_sentencepiece(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)
