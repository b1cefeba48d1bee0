import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelens.llm.encode import Encoder, load_vocabulary, merge_bytes, token_count, token_ids, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path(), "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def ids(encoder, text):
    b = encoder.encode(text)
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


def slow_merge(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_against_plain_merging(encoder):
    rnd = random.Random(1)
    for _ in range(3000):
        word = bytes(rnd.choice(b"abetn 1\xc3\xa9\xe2\x80") for _ in range(rnd.randint(1, 24)))
        assert merge_bytes(word, encoder.ranks) == slow_merge(word, encoder.ranks)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z9 \n\t'sé漢１　 –​😀don'tll"), max_size=60))
def test_texts_against_the_library(encoder, library, text):
    assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_long_runs(encoder, library):
    for text in ("a" * 20_000, " " * 5_000 + "x", "ab" * 9_999, "<|endoftext|>", "　" * 400, "日本語" * 3000):
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_cache_that_is_full_changes_nothing(encoder, library):
    small = Encoder(open(vocabulary_path(), "rb").read())
    small.words.most = small.stretches.most = 3
    text = "one two three four five six one two " * 5
    assert ids(small, text) == library.encode(text, add_special_tokens=False).ids and len(small.words) <= 3


def test_columns(spark, encoder):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "Hello world"), (4, "Hello world")], "doc_id bigint, text string")
    v = load_vocabulary(spark)
    got = df.select("doc_id", token_ids(F.col("text"), v).alias("ids"), token_count(F.col("text"), v).alias("n")).collect()
    assert [(r["doc_id"], len(r["ids"]), r["n"]) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 2, 2), (4, 2, 2)]
    assert df.limit(0).select(token_ids(F.col("text"), v)).count() == 0
