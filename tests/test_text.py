import random

import pytest
from pyspark.sql import functions as F

from quirion.functions import text as T

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0   　"


def test_strip_and_word_count_equal_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SPACES + "ab​﻿.") for _ in range(rng.randrange(12))) for _ in range(2000)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip("t").alias("s"), T.word_count("t").alias("n"), T.is_blank("t").alias("b")).collect()
    for r in rows:
        if r.t is None:
            assert r.s is None and r.b
        else:
            assert (r.s, r.n, r.b) == (r.t.strip(), len(r.t.split()), not r.t.strip()), repr(r.t)


@pytest.mark.parametrize("text", ["ABC", "1ª VARA", "Nº 10", "ÉÇ 1", "123", "", "Ab", "ǅA", "A-B", "ß", "ΣΑ"])
def test_is_upper_equals_python(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_upper("t")).first()[0] == text.isupper()


def test_joined_keeps_order(spark):
    row = spark.range(1).select(T.joined(F.expr("array(named_struct('x', 'a'), named_struct('x', 'b'))"), "x", "--").alias("j")).first()
    assert row.j == "a--b"
