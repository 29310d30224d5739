"""The quality classifier learns from every labelled row."""

from pyspark.sql import functions as F

from quiltlens.llm import ftrl


def test_every_labelled_row_is_learned_from(spark):
    n = 26_000
    rows = spark.range(n).select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("label"))
    slots, counts = ftrl.features([f"w{i}".encode() for i in range(n)])
    assert (counts == 1).all()
    assert (ftrl.fit(rows)[slots[0]] != 0).all()


def test_texts_move_once_whatever_the_size_of_the_labels(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = docs.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 4 / 2).cast("int").alias("quality"))
    labels = labels.unionByName(labels.withColumn("quality", F.lit(1)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = []
    try:
        for size in ("-1", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            rows = ftrl.training_rows(docs, labels)
            assert rows.rdd.getNumPartitions() == 2  # 3,600 labelled rows of 7,200 that are not held out
            plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("Exchange") == 1 and "Broadcast" not in plan
            got.append({(r.id, r.text, r.label) for r in rows.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = docs.join(labels.groupBy("doc_id").agg(F.min("quality")), "doc_id").filter(~ftrl.held_out("doc_id")).collect()
    assert got[0] == got[1] == {tuple(r) for r in want}
