import pytest
from pyspark.sql import functions as F

from claimloom.functions import normalize


def _one(spark, f, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in frame.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_phone(spark):
    good = ["+91-9876500011", "9876500011", "098765 00011", "+91 98765 00011", "0091 98765 00011", "9112345678", " +91 (0) 98765 00011"]
    assert _one(spark, normalize.phone, good) == ["+919876500011"] * 5 + ["+919112345678", "+919876500011"]
    assert _one(spark, normalize.phone, ["12345", "", None, "phone", "+47 22 12 34 56", "0000000000", "+9876500011", "+65 812 4567", "+65 81234 56789", "0044 20 7946", "8123 4567"]) == [None] * 11
    abroad = ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+65 8123 4567", "0065 8123 4567", "+1 (212) 555-0147", "0049 030 901820", "+971 50 123 4567", "+61 412 345 678"]
    assert _one(spark, normalize.phone, abroad) == ["+442079460958"] * 2 + ["+6581234567"] * 2 + ["+12125550147", "+4930901820", "+971501234567", "+61412345678"]


def test_address(spark):
    same = ["12 Lake View Road, Coimbatore", "12, lake view rd. coimbatore", "Coimbatore, 12 Lake View Road"]
    assert _one(spark, normalize.address, same) == ["12 coimbatore lake road view"] * 3
    assert _one(spark, normalize.address, ["---", None, "No 5 St St"]) == ["", None, "5 number street street"]


def test_shop(spark):
    assert _one(spark, normalize.shop, ["SpeedFix Auto Works", "SPEEDFIX AUTO WORKS PVT LTD"]) == ["speedfix auto works"] * 2
    a, b, c, d, e = _one(spark, normalize.shop, ["Sharma & Sons Garage", "Sharma and Sons Garage", "X Pvt. Ltd.", "Lincoln Motors", "Ltd"])
    assert a == b == "sharma garage" and c == "x pvt" and d == "l oln motors" and e == ""


def test_masked(spark):
    assert _one(spark, normalize.masked, ["+919876500011", "ab", "abcd", "abcde", ""]) == ["+9*********11", "**", "****", "ab*de", ""]


@pytest.mark.parametrize("ratio, burst, low, high", [(5.0, 1.0, 0.9, 1.0), (1.0, 0.0, 0.0, 0.0), (3.0, 0.5, 0.5, 0.5)])
def test_suspiciousness(spark, ratio, burst, low, high):
    got = spark.range(1).select(normalize.suspiciousness(F.lit(ratio), F.lit(burst)).alias("x")).first().x
    assert low <= got <= high


def test_scalars(spark):
    r = spark.range(1).select(normalize.per_entity(F.lit(12), F.lit(1)).alias("a"), normalize.per_entity(F.lit(3), F.lit(0)).alias("b"), normalize.idf_weight(F.lit(0)).alias("c"), normalize.idf_weight(F.lit(1)).alias("d"), normalize.idf_weight(F.lit(9)).alias("e")).first()
    assert r.a == 12 and r.b == 0 and r.c == 0 and r.d > r.e > 0
    hints = spark.createDataFrame([(0.75,), (0.74,), (0.4,), (0.1,)], "s double").select(normalize.decision_hint(F.col("s")).alias("h")).collect()
    assert [h.h for h in hints] == ["FLAG", "REVIEW", "REVIEW", "CLEAR"]
