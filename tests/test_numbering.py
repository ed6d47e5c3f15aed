"""Distributed numbering and ordered per-key operators under skew."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailspark.operators.numbering import add_group_position, add_sequence
from mailspark.operators.running import running_sums, with_previous


def _skewed(spark, n=20000):
    # a third of all rows share one key
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 10007).alias("t"),
        (F.col("id") % 5).alias("v"),
    )


def test_add_sequence_is_a_rank(spark):
    df = _skewed(spark)
    out = add_sequence(df, ["t", "id"], "seq", num_partitions=16)
    want = df.withColumn("seq2", F.row_number().over(Window.orderBy("t", "id")))
    j = out.join(want, "id")
    assert out.count() == 20000 and j.filter(F.col("seq") != F.col("seq2")).count() == 0


def test_group_position_with_hot_key(spark):
    df = _skewed(spark)
    out = add_group_position(df, ["k"], ["t", "id"], "pos", num_partitions=16)
    want = df.withColumn("pos2", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")))
    assert out.join(want, "id").filter(F.col("pos") != F.col("pos2")).count() == 0


def test_running_sums_and_previous(spark):
    df = _skewed(spark)
    out = running_sums(df, ["k"], ["t", "id"], {"run_v": F.col("v"), "run_n": F.lit(1).cast("long")}, num_partitions=16)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("rv"), F.count(F.lit(1)).over(w).alias("rn"))
    j = out.join(want, "id")
    assert j.filter((F.col("run_v") != F.col("rv")) | (F.col("run_n") != F.col("rn"))).count() == 0
    prev = with_previous(df, ["k"], ["t", "id"], {"pv": "v"}, num_partitions=16)
    want2 = df.select("id", F.lag("v").over(Window.partitionBy("k").orderBy("t", "id")).alias("pv2"))
    assert prev.join(want2, "id").filter(~F.col("pv").eqNullSafe(F.col("pv2"))).count() == 0
