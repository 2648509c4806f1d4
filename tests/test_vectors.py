import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.functions import vectors as V
from cadenza.functions.names import ARTISTS

floats = st.floats(-100, 100, allow_nan=False)


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(floats, floats), min_size=1, max_size=8))
def test_against_numpy(spark, pairs):
    a, b = np.array([x for x, _ in pairs]), np.array([y for _, y in pairs])
    got = one(spark, "a array<double>, b array<double>", (a.tolist(), b.tolist()), V.dot("a", "b").alias("d"), V.l2norm("a").alias("u"), V.cosine("a", "b").alias("c"), V.blend("a", "b", 0.6).alias("m"))
    assert got.d == pytest.approx(float(a @ b), abs=1e-6)
    assert got.m == pytest.approx((0.6 * a + 0.4 * b).tolist(), abs=1e-9)
    n = float(np.sqrt(a @ a))
    if n > 1e-3:
        assert got.u == pytest.approx((a / n).tolist(), abs=1e-9)
    if n > 1e-3 and (b @ b) > 1e-6:
        assert got.c == pytest.approx(float(a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-9)


def test_edges(spark):
    row = ([0.0, 0.0], [1.0, 2.0], None, [0.1, 0.3, 0.7])
    got = one(spark, "z array<double>, v array<double>, n array<double>, w array<double>", row, V.l2norm("z").alias("z"), V.cosine("z", "v").alias("cz"), V.cosine("z", "v", True).alias("cc"), V.l2norm("n").alias("n"), V.cosine("w", "w").alias("same"), V.format_vector("w").alias("f"))
    assert got.z == [0.0, 0.0] and got.cz is None and math.isnan(got.cc) and got.n is None
    assert got.same == 1.0 and got.f == "[0.100000,0.300000,0.700000]"


def test_format_vector_rounds_as_printf(spark):
    """A tie in binary goes to the even digit; one that only the shortest decimal has is none."""
    values = [-0.0703125, 0.0703125, 0.0234375, 0.1234565, -1e-9, -0.0, 1e15 + 0.3, 1e23]
    rows = spark.createDataFrame([(1, values), (2, [1.0, None, 2.0]), (3, []), (4, None)], "n int, v array<double>")
    got = {r.n: r.f for r in rows.select("n", V.format_vector("v").alias("f")).collect()}
    assert got[1] == "[-0.070312,0.070312,0.023438,0.123456,-0.000000,-0.000000,1000000000000000.250000,99999999999999991611392.000000]"
    assert (got[2], got[3], got[4]) == ("[1.000000,2.000000]", "[]", None)


def test_mean_and_centroid(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 3.0]), ("a", None), ("b", None)], "k string, embedding array<double>")
    assert {r.k: r.embedding for r in V.vector_mean(rows, ["k"], "embedding").collect()} == {"a": [0.5, 1.5]}
    c = {r.k: r.centroid for r in V.centroid(rows, ["k"], "embedding").collect()}
    assert c["a"] == pytest.approx([math.sqrt(0.5)] * 2) and "b" not in c


def test_text(spark):
    got = one(spark, "a string, b string, c string", (" a/b:c? ", "x/y/15 - 1000 Doves.MP3", None), T.sanitize(F.col("a")).alias("a"), T.stem(F.col("b")).alias("s"), T.extension(F.col("b")).alias("e"), T.unnumbered(T.stem(F.col("b"))).alias("u"), T.sanitize(F.col("c")).alias("c"))
    assert got.a == "a_b_c_" and (got.s, got.e, got.u, got.c) == ("15 - 1000 Doves", ".mp3", "1000 Doves", "")
    for name in ("5 - X", "105 - X"):
        assert one(spark, "n string", (name,), T.unnumbered(F.col("n")).alias("u")).u == ""


def test_dictionary(spark):
    credit = "Ed Sheeran feat. Meek Mill & A Boogie Wit da Hoodie"
    assert one(spark, "c string", (credit,), T.dictionary_names(F.col("c"), ARTISTS).alias("n")).n == ["Ed Sheeran"]
    assert one(spark, "c string", ("Asia, Adele",), T.dictionary_names(F.col("c"), ["Adele", "sia"]).alias("n")).n == ["Adele", "sia"]
    assert one(spark, "c string", ("Asia, Adele",), T.dictionary_names(F.col("c"), ["Adele", "sia"], "exact").alias("n")).n == ["Adele"]


def test_hash_uniform(spark):
    rows = spark.range(2000).select(V.hash_uniform(F.concat(F.lit("u"), F.col("id").cast("string")), F.lit(7)).alias("u"))
    values = [r.u for r in rows.collect()]
    assert all(0 <= v < 1 for v in values) and abs(np.mean(values) - 0.5) < 0.03
    assert values == [r.u for r in rows.repartition(7).orderBy(rows.u).select("u").collect()] or sorted(values) == sorted(r.u for r in rows.repartition(7).collect())
