"""Values and helpers of the test modules."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def eval_col(spark, values, fn, dtype="string"):
    """Apply a Column function to literal values, return the results in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]
