from yieldloom.functions.columns import rounded
from yieldloom.operators import retrieval
from yieldloom.session import clean, own_folder
from tests.conftest import rows


def test_ties_go_up_whatever_the_order_of_summing(spark):
    t = spark.createDataFrame([(89.97843749999999,), (89.9784375,), (89.9784374,), (None,)], "x double")
    assert [r.x for r in t.select(rounded("x", 6).alias("x")).collect()] == [89.978438, 89.978438, 89.978437, None]


def test_own_folder_is_new_and_removed(spark):
    a, b = own_folder(spark, "t"), own_folder(spark, "t")
    spark.range(3).write.parquet(a)
    assert a != b and spark.read.parquet(a).count() == 3
    clean(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(a)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_merged_scores_that_differ_by_noise_rank_by_id(spark):
    t = spark.createDataFrame([("q", 2, 0.3 + 1e-15), ("q", 1, 0.3), ("q", 3, 0.4), ("q", 3, 0.1)], "g string, id int, score double")
    assert rows(retrieval.merge(t, "g", 2), "rank", "id") == [(1, 3), (2, 1)]
