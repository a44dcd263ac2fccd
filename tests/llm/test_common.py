"""What the operators share: the folder for tables, and joins on hot keys."""

import pytest
from pyspark.sql import functions as F

from paperloom.llm import common


class Unset:
    """A session of another master and without spark.checkpoint.dir."""

    def __init__(self, master, application):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId = master, application

    def getConf(self):
        return self

    def get(self, name, default=None):
        return default


def test_folder_without_the_setting():
    one, other = Unset("local[2]", "app-1"), Unset("local[2]", "app-2")
    assert common.shared_dir(one) == common.shared_dir(one) != common.shared_dir(other)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Unset("spark://far:7077", "app-3"))


@pytest.mark.parametrize("hot_rows", [5, 1000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_is_a_join_whatever_the_names(spark, hot_rows, how):
    left = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("__parts"), F.lit("x").alias("__deal"), F.lit(1).alias("count"))
    right = spark.createDataFrame([(-1, "hot", "y"), (1, "one", "y"), (99, "none", "y")], "k long, name string, _deal string")
    key = lambda df: sorted(map(str, df.collect()))
    got = common.hot_join(left, right, ["k"], how, hot_rows)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns and key(got) == key(want)
