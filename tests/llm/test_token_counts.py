import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quirion.llm.queries import byte_bpe
from quirion.llm.token_counts import MergeCounter, count_tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return MergeCounter(public_tokenizers.path("byte_bpe_50k.json"))


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


HARD = ["", " ", "  a", "a  b   ", "\n\n x", "it's we'll I'M", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000,
        " \x1c\x1d\x85\xa0\u2003\u3000 a", "\u65e5\u672c\u8a9e", "\U0001F642\U0001F643 \xe9", "12\xb34\xbd\u0663", "\u200b \ufeff", "a\u0558b \ua7ce1"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(library, counter, text):
    assert counter.count(text) == expected(library, text)


def test_random_texts(library, counter):
    rng = random.Random(7)
    pool = "abcdefgh  \n\t'.,!ésñßçœ0123 \x1f\xa0漢字🙂<|endoftext|>"
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert counter.count(text) == expected(library, text), repr(text)


def test_operator(spark, library):
    rows = [(1, "Hello world, hello!", 5), (2, None, 5), (3, "", None), (3, "", None), (None, "it is", 1), (4, "word " * 600, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = sorted(map(tuple, count_tokens(docs, byte_bpe).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := expected(library, t or ""), n > 512) for i, t, _ in rows), key=str)
    assert found == want
    assert count_tokens(docs.limit(0), byte_bpe).count() == 0
