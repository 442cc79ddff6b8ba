"""Scalar functions on hand-made rows."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.urls import UrlRule
from tessera.operators import features, rank


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_strip_is_idempotent_and_null_is_empty(spark):
    assert one(spark, T.strip(F.col("a")), a=" a\t\n &nbsp; b  ") == "a b"
    assert one(spark, T.strip(T.strip(F.col("a"))), a=" a\t\n b ") == "a b"
    assert one(spark, T.strip(F.col("a").cast("string")), a=None) == ""
    assert one(spark, T.strip(F.col("a"), pipes=True), a="a | b") == "a b"


def test_absolute_urls(spark):
    base = "https://h.example/a/b?q=1"
    wanted = {
        "//o.example/x": "https://o.example/x",
        "/c": "https://h.example/c",
        "c": "https://h.example/a/c",
        "http://o.example/": "http://o.example/",
        "http://localhost/p": "https://h.example//p",
        "": "",
    }
    for href, out in wanted.items():
        assert one(spark, U.absolute(F.col("h"), F.col("b")), h=href, b=base) == out
        again = one(spark, U.absolute(F.col("h"), F.col("b")), h=out, b=base)
        assert again == out


def test_rewrite_rules(spark):
    first = [UrlRule("(a)(b)", "$2$1")]
    assert one(spark, U.rewrite(F.col("u"), first), u="xabab") == "xbaab"
    assert one(spark, U.rewrite(F.col("u"), [UrlRule("ab", "", replace_all=True, recursive=True)]), u="aabbc") == "c"
    chain = [UrlRule("x", "y"), UrlRule("y", "z")]
    assert one(spark, U.rewrite(F.col("u"), chain), u="x") == "y"
    assert one(spark, U.rewrite(F.col("u"), [UrlRule("x", "y", go_on=True), UrlRule("y", "z")]), u="x") == "z"
    assert one(spark, U.rewrite(F.col("u"), [UrlRule("x", "y", export_only=True)]), u="x") == "x"


def test_filters(spark):
    assert one(spark, U.passes(F.col("u")), u="a") is True
    assert one(spark, U.passes(F.col("u"), ("B",)), u="abc") is True
    assert one(spark, U.passes(F.col("u"), (), ("a",)), u="abc") is False
    assert one(spark, U.passes(F.col("u").cast("string"), ("a",)), u=None) is False


def test_comparison_is_antisymmetric(spark):
    rows = spark.createDataFrame([(float(a), float(b)) for a in (-2, 0, 1, 8, 9) for b in (-2, 0, 1, 8, 9)], "a double, b double")
    bad = rows.where(rank.compare(F.col("a"), F.col("b")) != -rank.compare(F.col("b"), F.col("a")))
    assert bad.count() == 0
    assert rows.where("a = 8 and b = 9").select(rank.compare(F.col("a"), F.col("b"))).first()[0] == 0


def test_fixed_point_saturates(spark):
    assert one(spark, features.fixed_point(F.col("a")), a=1e12) == features.INT_MAX
    assert one(spark, features.fixed_point(F.col("a").cast("double")), a=None) == 0
    assert one(spark, features.ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) == 0


def test_stems(spark):
    assert one(spark, T.has_stem(F.col("q"), F.col("t")), q="running cats", t="a cat sat") is True
    assert one(spark, T.has_stem(F.col("q"), F.col("t")), q="dogs", t="a cat sat") is False
