"""Text metrics are read from a value once, however often a filter or branch uses them."""

from pyspark.sql import functions as F

from quiltlens.operators import tokens as H


def test_units_are_worked_out_once(spark):
    df = spark.createDataFrame(
        [("24px", "16px"), ("1.5", "16px"), (" 150% ", ""), ("2REM", "1rem"), ("0.02em", "50px"), ("-0.8px", "16px"), ("normal", "16px"), ("var(--x)", "16px"), ("", "16px"), (None, "16px"), ("24px", None), ("0", "16px"), ("-0.0001em", "16px")],
        "value string, size string")
    got = df.select(H.line_height_percent(F.col("value"), F.col("size")).alias("l"), H.letter_spacing_rem(F.col("value"), F.col("size")).alias("t"))
    assert [tuple(r) for r in got.collect()] == [
        ("150%", "1.5rem"), ("150%", "0.094rem"), ("150%", None), ("200%", "2rem"), ("2%", "0.063rem"), (None, "-0.05rem"), (None, "0rem"), (None, None), (None, None),
        (None, None), (None, "1.5rem"), (None, "0rem"), (None, "0rem")]
    for column in (H.line_height_percent, H.letter_spacing_rem):
        plan = df.select(column(F.col("value"), F.col("size")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract") <= 4, plan  # the px number stands in two branches that exclude each other
