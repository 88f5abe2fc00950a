"""Encoding and decoding equal the library on whole texts."""

import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from cuesheet.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(spark, library, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pieces.decode(pieces.encode(docs, PATH, packed=True), PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == want and bytes(r.packed) == np.array(want, "<u4").tobytes() and r.decoded == library.decode(want)


def test_odd_texts(spark, library):
    texts = [
        None, "", " ", "   ", "a", " a", "a ", "a  b", "▁", "a▁b ▁ c", "\n", "line\nbreak \n\n two", "\ttab nbsp　wide", "naïve café é",
        "日本語 中文字", "emoji 👩‍👩‍👧 🇩🇪", "\x00 nul \x01", "<s> </s> <unk> <0x41>", "1234567890 3.14", "x" * 5000, " " * 3000, "word " * 4000, "word " * 4000, "a퟿z",
    ]
    check(spark, library, texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, library, seed):
    draw = random.Random(seed)
    letters = "abcdeéßл語 ▁ \n\t.,!0123'\"-" + chr(0x1F600)
    check(spark, library, ["".join(draw.choice(letters) for _ in range(draw.randint(0, 300))) for _ in range(200)])


def test_small_blocks_and_long_texts(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 50)
    monkeypatch.setattr(pieces, "BLOCK_ROWS", 3)
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma-ray", "über", "x1", ""]
    check(spark, library, [" ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 5, 400]))) for _ in range(100)])


def test_each_different_word_is_segmented_once(spark):
    docs = spark.createDataFrame([("a b b a",), ("b c",), ("a",)] * 50, "text string")
    words = pieces.block_words(docs, 8)
    chunks = [w for r in words.collect() for w in pieces.cells_of(r.chunks)[0].decode().split(" ")]
    blocks = words.select("block").distinct().count()
    assert set(chunks) == {"▁a", "▁b", "▁c"} and len(chunks) <= 3 * blocks


def test_other_columns_and_copies_are_kept(spark, library):
    docs = spark.createDataFrame([(1, "a b", "x", [9], {"k": 1}), (1, "a b", "x", [9], {"k": 1}), (None, None, None, None, None)], "block long, text string, given string, ids array<int>, places map<string,int>")
    got = pieces.encode(docs, PATH, keep_text=True)
    assert got.columns == ["block", "text", "given", "places", "ids"]
    rows = got.orderBy(F.col("block").desc_nulls_last()).collect()
    assert [(r.block, r.text, r.given, r.places, r.ids) for r in rows] == [(1, "a b", "x", {"k": 1}, library.encode("a b", add_bos=True, add_eos=True))] * 2 + [(None, None, None, None, [1, 2])]
    only = pieces.encode(docs.select("text"), PATH)
    assert only.columns == ["ids"] and only.count() == 3
    assert pieces.encode(docs.where("false"), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).orderBy("decoded").collect()[0].decoded is None


def test_models_that_cross_words_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    pieces.check_model(proto.SerializeToString())
    proto.pieces[500].piece = "a▁b"
    with pytest.raises(ValueError):
        pieces.check_model(proto.SerializeToString())
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.check_model(proto.SerializeToString())
