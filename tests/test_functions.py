"""Edge cases of scalar functions and of similarity."""

import math

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import scores, similarity
from quillmesh.functions import text as X


def one(spark, kind, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_name_key(spark):
    got = one(spark, "string", [None, "", "  ", "Peña  josé", "PE?A JOSE", "josé peña", "A\tB", "A B", "Ünal Straße", "o'neil 3rd", "Éva"], X.name_key)
    assert got == ["", "", "", "JOSE PENA", "JOSE PENA", "JOSE PENA", "AB", "AB", "STRASSE UNAL", "ONEIL RD", "EVA"]
    assert one(spark, "string", ["zeta alfa"], lambda c: X.name_key(c, False)) == ["ZETA ALFA"]


def test_spaces_and_names(spark):
    assert one(spark, "string", [None, "  a  \t b\n"], X.squeeze_space) == [None, "a b"]
    assert one(spark, "string", [None, "A.B/C|D  E", " (x) a"], X.clean_name) == [None, "ABCD E", "(x) a"]
    assert one(spark, "string", ["a (x) b (y)"], lambda c: X.clean_name(c, True)) == ["a b"]
    rows = spark.createDataFrame([(None, None, None), ("a", None, "c"), (" a", "b", "c ")], "a string, b string, c string")
    assert [r.x for r in rows.select(X.join_names(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == ["", "a  c", "a b c"]


def test_numbers(spark):
    assert one(spark, "string", [None, "12.0", "5d", " 1e2 ", "nan", ".5", "1_0", "", "0x1"], X.to_number) == [None, 12.0, None, 100.0, None, 0.5, None, None, None]
    assert one(spark, "string", [None, "S/E", "12.0", "12.5", "007", "x"], X.to_key) == [None, None, 12, None, 7, None]
    assert one(spark, "string", ["12 años 3 meses", "12 AÑOS", "7", "5 meses", None, ""], X.age_years) == [12, 12, 7, None, None, None]
    assert one(spark, "string", ["0012", "1e5", "nan", "18339.1945", "0.0", None, " a ", "-0.001", "2.50"], X.format_value) == ["12", "100000", "nan", "18339.19", "0", "", "a", "0", "2.5"]
    assert [str(d) if d else None for d in one(spark, "string", ["31/12/2020", "2020-02-30", "2020-02-03", "x", None], X.parse_date)] == ["2020-12-31", None, "2020-02-03", None, None]


def test_small_texts(spark):
    assert one(spark, "string", ["Año  Ingreso (x)", "__A"], X.snake_case) == ["a_o_ingreso_x", "a"]
    assert one(spark, "string", ["a b  c"], X.visible_spaces) == ["a␣b--c"]
    assert one(spark, "string", [None, "", " a  b "], X.token_count) == [0, 0, 2]
    assert one(spark, "string", ["NA", "x", None, ""], X.na_to_null) == [None, "x", None, None]


@pytest.mark.parametrize("a, b, want", [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("", "", 0.0), ("a", "", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("JONES", "JOHNSON", 0.832381)])
def test_jaro_winkler(a, b, want):
    assert similarity.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)


def test_similarities(spark):
    rows = spark.createDataFrame([("", ""), ("ab", "ac"), (None, "x")], "a string, b string")
    got = rows.select(similarity.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"), similarity.jaro_winkler_similarity("a", "b").alias("j")).collect()
    assert [r.l for r in got] == [1.0, 0.5, None] and got[2].j is None
    assert one(spark, "array<float>", [[3.0, 4.0]], lambda c: similarity.dot(c, c)) == [25.0]


def test_scores(spark):
    assert one(spark, "double", [700.0, -700.0, 0.0], scores.sigmoid) == pytest.approx([1.0, math.exp(-700), 0.5])
    assert one(spark, "double", [0.5, 0.0, 1.0], scores.bernoulli_entropy) == pytest.approx([1.0, 0.0, 0.0], abs=1e-9)
    assert one(spark, "double", [0.2], scores.margin) == pytest.approx([0.08])
    assert one(spark, "double", [-700.0], lambda z: scores.weighted_bce(z, F.lit(1.0), 8.0)) == pytest.approx([5600.0])
