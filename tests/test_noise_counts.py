"""The noise test from counts: the same as tokens one by one, without a list of characters."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import fixed
from sieveline.functions import scoring as S
from sieveline.functions import text as X
from sieveline.plans.queries import QUERIES

STOPS = {*fixed.STOP_CHARS, *fixed.STOP_WORDS}
PARTS = [*"aistAIS  \t\n\x85\xa0　é的了没字İſ😀", " the ", " of ", " A ", " 的 ", "ing", "..", "{"]


def by_token(text, least, ratio):
    chars = [c for c in text if c != " "]
    words = [w.lower() for w in "".join(" " if c in X.BLANKS else c for c in text).split(" ") if w]
    every = chars + words
    return len(chars) < least and len(words) < least or not every or sum(t in STOPS for t in every) / len(every) > ratio or any(p in text for p in fixed.PLACEHOLDERS)


@pytest.mark.parametrize(("least", "ratio"), [(5, 0.8), (60, 0.05), (1, 0.5), (3, 0.3)])
def test_equals_tokens_one_by_one(spark, least, ratio):
    draw = random.Random(7)
    texts = ["", " ", "的的的的的的", *["".join(draw.choice(PARTS) for _ in range(draw.randint(0, draw.choice([4, 30, 150])))) for _ in range(800)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.x for r in rows.select("i", S.is_noise(F.col("t"), least, ratio).alias("x")).orderBy("i").collect()]
    assert got == [by_token(t, least, ratio) for t in texts]


@pytest.mark.parametrize("name", ["noise_examples", "noise_ratio"])
def test_no_list_of_characters(spark, name):
    """Words are cut once and looked up in a set; characters are counted in the text."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove(split") == 1 and plan.count("split(") == 1
    assert "INSET" in plan and "array_contains" not in plan


def test_both_tests_read_one_count(spark):
    """noise_flags cuts and counts a text once for its two tests."""
    plan = QUERIES["noise_flags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("translate(") == 1
