from pyspark.sql import functions as F

from topiclake.llm.sampling import least_rows


def test_least_rows(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    expected = [r.id for r in df.orderBy("h").limit(40).collect()]
    for parts in (1, 7):
        assert [r.id for r in least_rows(df.repartition(parts), F.col("h"), 40).collect()] == expected
    # Copies count once, however many there are.
    copies = df.limit(30).crossJoin(spark.range(200).select(F.col("id").alias("c")))
    assert least_rows(copies, F.col("h"), 25).select("h").distinct().count() == 25
    assert least_rows(copies, F.col("h"), 100).count() == 30
    assert least_rows(df.filter("id < 0"), F.col("h"), 5).count() == 0
