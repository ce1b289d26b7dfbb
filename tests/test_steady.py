"""Means on a threshold do not depend on the order in which their rows were summed."""
from pyspark.sql import functions as F

from rebuff.functions.expressions import steady
from rebuff.operators import inference as I


def test_means_on_the_threshold(spark):
    noisy = [0.5 + 2 ** -53 * 4, 0.5 - 2 ** -54, 0.5]
    units = spark.createDataFrame([(1.0 + 2 ** -52, noisy[0]), (1.0, noisy[1]), (1.0, noisy[2]), (3.0, 0.6), (2.0, 0.7)], "x double, y double")
    r = I.auc_mann_whitney(units.withColumn("x", steady("x")), "x", steady("y") > 0.5).first()
    assert (r.n_pos, r.n_neg, r.auc, r.u) == (2, 3, 1.0, 6.0)
    assert units.select(steady("x").alias("x")).where(F.col("x") < 2).distinct().count() == 1
