import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return piece_codec.PieceCodec(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


CASES = ["", " ", "  a  b ", "\n\n", "a\tb", "▁x ▁", "é" * 50, "😀 中文 \x00", "the" * 2000, " " * 5000, "1234567890.", "Thndedble, ererea.\nThe"]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(pair, text):
    codec, library = pair
    ids = library.encode(text) + [library.eos_id()]
    assert codec.encode(text) == ids
    assert codec.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py() == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abtheing \n▁.,é1"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_equals_the_library_on_any_text(text):
    codec, library = piece_codec.codec(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert codec.encode(text) == library.encode(text) + [2]


def test_decoding_equals_the_library_on_any_ids(pair):
    codec, library = pair
    rnd = random.Random(5)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(260)]) for _ in range(rnd.randint(0, 12))]
        assert codec.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py() == library.decode(ids), ids


def test_backtracking_equals_plain_merging(pair):
    codec, _ = pair
    rnd = random.Random(6)
    for _ in range(3000):
        word = "".join(rnd.choice("thereainsouncgl") for _ in range(rnd.randint(1, 18)))
        assert codec.known(word) == codec.merged(word)


def test_tables(spark, pair):
    _, library = pair
    docs = spark.createDataFrame([(1, "The thndedble", "x"), (1, "The thndedble", "x"), (2, None, "y"), (None, "", None)], "doc_id bigint, text string, ids string")
    rows = piece_codec.decode(piece_codec.encode(docs, PATH), PATH).select("doc_id", "ids", "decoded").collect()
    want = library.encode("The thndedble") + [2]
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in rows] == [(1, want, "The thndedble")] * 2 + [(2, [2], ""), (None, [2], "")]
    assert piece_codec.encode(docs.limit(0), PATH).collect() == []
    clash = docs.withColumn("both", docs["doc_id"])
    once = piece_codec.encode_and_decode(clash, PATH).select("doc_id", "ids", "decoded", "both").collect()
    assert [tuple(r)[:3] for r in once] == [tuple(r) for r in rows] and once[0]["both"] == 1


def test_query(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r["doc_id"]: r for r in piece_codec.query(spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(doc["text"]) + [2]
        r = got[doc["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
