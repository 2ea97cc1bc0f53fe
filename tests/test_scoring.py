"""Branches of the scores that the tables don't reach."""

import math

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scoring as S
from sieveline.functions import text as X


def values(spark, rows, column, schema="t string"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(("n", "score"), [(4, 0.05), (5, 0.1), (9, 0.1), (10, 0.2), (14, 0.2), (15, 0.3), (19, 0.3), (20, 0.4), (29, 0.4), (30, 0.5), (49, 0.5), (50, 0.7), (99, 0.7), (100, 0.8), (199, 0.8), (200, 1.0), (2000, 1.0), (2001, 0.8), (5000, 0.8), (5001, 0.5)])
def test_length_bands(spark, n, score):
    dims = S.additive_dimensions(F.col("t"), F.lit("general"), S.LONG)
    assert values(spark, ["x" * n], dims["length"]) == [score]


def test_short_circuits(spark):
    total, dims = S.additive_score(F.col("t"), F.lit("general"), S.LONG)
    texts = ["hello", "hi!!", "嗯嗯", "", "....", "aaaa", "早上好"]
    assert values(spark, texts, total) == [0.3, 0.3, 0.2, 0.2, 0.25, 0.2, 0.3]
    assert values(spark, texts[:5], dims["length"]) == [0.1, 0.1, 0.2, 0.2, 0.3]


def test_hedges_and_openings(spark):
    dims = S.additive_dimensions(F.col("t"), F.lit("general"), S.LONG)
    assert values(spark, ["plain", "maybe", "maybe likely", "maybe likely sorry", "Sure"], dims["destructive"]) == [1.0, 0.5, 0.5, 0.2, 1.0]
    assert values(spark, ["history of it", "Hi there\nyou", "好的，我来帮你", "let me see", "plain"], dims["template"]) == [0.2, 1.0, 1.0, 0.2, 1.0]
    short = S.additive_dimensions(F.col("t"), F.lit("general"), S.SHORT)
    assert values(spark, ["好的，我来帮你", "let me see"], short["template"]) == [0.4, 0.4]


def test_metadata_is_not_clamped(spark):
    total, _ = S.additive_score(F.col("t"), F.lit("user/preferences"), S.LONG)
    (x,) = values(spark, ["def f code " + "https://a.b x@y `c` 1 2 3 4 5 " * 10], total)
    assert x == pytest.approx(0.1 + 0.2 + 0.1 + 0.3 + 0.25 + 0.05 * 1.5)


def test_multiplicative(spark):
    score = S.multiplicative_score(F.col("t"), F.col("k"), F.col("m"))
    rows = [("Some Knowledge API text that is long enough", "knowledge", True), ("有人提到类似的方案", "noise", False), ("的的的的的的", "other", False)]
    got = values(spark, rows, score, "t string, k string, m boolean")
    assert got[0] == 1.0
    assert got[1] == pytest.approx(0.3 * 0.5 * 0.8 * 0.6)
    assert got[2] == pytest.approx(0.5 * 0.8 * 0.7)


def test_noise(spark):
    texts = ["", "a b", "the of and is to in it", "a sentence about something concrete", "fill in {name}", "more..."]
    assert values(spark, texts, S.is_noise(F.col("t"))) == [True, True, False, False, True, True]


def test_layers_and_estimates(spark):
    t = F.col("t")
    assert values(spark, ["　one two. three", "no stop", " . x"], X.abstract(t)) == ["one two", "no stop", ""]
    assert values(spark, ["1\n2\n3\n4\n5\n6", "x" * 9000], F.char_length(X.overview(t))) == [9, 8000]
    assert values(spark, ["abcde"], X.token_estimate(t, t, t)) == [3]
    assert values(spark, ["x" * 100, "x" * 101], F.char_length(X.preview(t))) == [100, 103]


def test_tokens(spark):
    t = F.col("t")
    assert values(spark, ["Où est_il 北京大学 x1?"], X.word_tokens(t)) == [["où", "est_il", "北京大学", "x1"]]
    assert values(spark, ["a,b\tC", "", "!!"], X.char_tokens(t)) == [["a", "b", "\t", "C"], [], []]
    assert values(spark, ["  A b　B "], X.blank_tokens(t)) == [["a", "b", "b"]]


def test_parsers(spark):
    t = F.col("t")
    assert values(spark, ["0.7 good", "none", "10", ".5"], X.parsed_score(t)) == [0.7, 0.5, 1.0, 0.5]
    assert values(spark, ["go [2, 0, 9]", "no"], X.parsed_order(t, F.lit(3))) == [[2, 0], [0, 1, 2]]
    assert values(spark, ["是 10 分", "部分 是", "否 85 分", "否 10 分"], X.parsed_verdict(t)) == ["success", "partial", "success", "fail"]


def test_cosine_of_zero(spark):
    from sieveline.functions.vectors import cosine

    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] is None
    assert math.isclose(got[1], 0.96)


def test_fixed_values_as_literals():
    """Some of the values that results depend on, written out: the DuckDB equivalents import them, so they can't notice a slip."""
    from sieveline.functions import fixed
    from sieveline.operators import learn, lexical

    assert fixed.WEIGHTS_LONG == (0.10, 0.20, 0.10, 0.30, 0.25, 0.05) and fixed.WEIGHTS_SHORT == (0.20, 0.15, 0.20, 0.20, 0.15, 0.10)
    assert (lexical.K1, lexical.B, lexical.EPSILON) == (1.5, 0.75, 0.25)
    assert fixed.TYPE_FACTOR == {"code": 1.2, "knowledge": 1.2, "event": 0.9, "conversation": 0.9, "noise": 0.3}
    assert (learn.RATE, learn.LOWEST, learn.HIGHEST, learn.CAREFUL_RATE, learn.LEAST_FACTOR, learn.MOST_FACTOR, learn.WARM_UP) == (0.1, 0.1, 2.0, 0.05, 0.8, 1.2, 10)
    assert fixed.HEDGES_SHORT[6:10] == ("sorry", "cannot", "unable", "don't know") and len(fixed.HEDGES_LONG) == 81 and len(fixed.STOP_WORDS) == 145
    assert [path for path, _ in fixed.ROUTES] == ["/user/preferences", "/agent/skills", "/resources/projects", "/agent/memories"]
