import time

from pyspark.sql import functions as F

from shelfspark.llm import common


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    """They are gone without a collection of garbage, and the setting is as it was."""
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    counted = spark.range(100_000, numPartitions=4).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    out = common.written(counted.join(counted.withColumnRenamed("n", "m").hint("merge"), "k"), "test-common")
    assert spark.conf.get(common.CLEANUP, None) == setting
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.where("n = 100 and m = 100").count() == 1000
    common.discard(out)
