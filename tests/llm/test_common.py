"""What the corpus operators share."""

from pyspark.sql import functions as F

from lapidary.llm import common


def test_words(spark):
    rows = [(None,), ("",), (" \t\n\x0b\x0c\r",), ("a\xa0b c",), (" a  b\n",)]
    df = spark.createDataFrame(rows, "t string").select(common.word_count(F.col("t")).alias("n"), common.word_list(F.col("t")).alias("w"))
    assert [(r.n, list(r.w)) for r in df.collect()] == [(0, []), (0, []), (0, []), (2, ["a\xa0b", "c"]), (2, ["a", "b"])]


def test_staged_tables_are_read_back_and_released(spark):
    df = common.stage(spark.range(10).withColumn("g", F.col("id") % 2), "t", ["g"])
    assert df.count() == 10 and df.columns == ["id", "g"]
    assert common.stage(spark.range(0), "t").count() == 0
    assert common.release(spark) >= 2 and common.release(spark) == 0


def test_small_tables_only_are_hinted(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.small(spark.range(5), 5)) and not hinted(common.small(spark.range(6), 5))


def test_fresh_names():
    assert common.fresh("a", ["A", "_a"]) == "__a" and common.fresh("b", ["a"]) == "b"
