"""Ids and texts against the tokenizers library."""

import random
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plinth.llm.bpe import BpeCodec, Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as f:
        return Vocabulary(f.read()), Tokenizer.from_file(PATH)


def encode(v, text):
    out = array("i")
    out.frombytes(v.encode(text))
    return list(out)


def texts():
    rng = random.Random(1)
    signs = "ab é\n\t 1٣ '\x00\x1c\x85\xa0　​😀ñ'sß.<|endoftext|>\r"
    yield from ("", " ", "<|endoftext|> <|endoftext|>a<|endo", "a" * 3000, "!" * 5000, "ab" * 3000 + "é" * 900, " " * 700 + "x", "don't we'll I'M")
    for _ in range(2000):
        yield "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
    for _ in range(40):
        yield "".join(rng.choice("thesingre") for _ in range(rng.randint(250, 800)))


def test_whole_texts(pair):
    v, library = pair
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(v, text) == ids
        assert v.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_any_ids_decode_alike(pair):
    v, library = pair
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 20))]
        assert v.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert v.decode([15496, 999_999]) == v.decode([15496])


def test_columns(spark, pair):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", None), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    codec = BpeCodec(spark, PATH)
    out = df.select("doc_id", codec.encode(F.col("text")).alias("coded")).withColumn("back", codec.decode(F.col("coded"))).collect()
    want = {1: (pair[1].encode("Hello there").ids, "Hello there"), 2: ([], ""), 3: ([], "")}
    assert len(out) == 4 and all((r.coded, r.back) == want[r.doc_id] for r in out)
    assert df.limit(0).select(codec.encode(F.col("text"))).collect() == []
