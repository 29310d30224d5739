"""Stylesheets are read by all cores."""

from pyspark.sql import functions as F

from quiltlens.operators import tokens as H


def test_stylesheets_of_one_split_are_read_by_all_cores(spark):
    css = spark.range(0, 64, 1, 1).select(F.lit("s").alias("site"), F.lit("a { Padding: 4; margin: 2em; gap: auto; color: #abc; --token-x: rgb(1, 2, 3); --token-y: red; border-radius: 0 }").alias("css"))
    out = H.mine_css_tokens(css)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "RoundRobinPartitioning" in plan
    assert {tuple(r) for r in out.collect()} == {("s", "spacing", "4px", 64), ("s", "spacing", "2em", 64), ("s", "color", "#010203", 64)}
