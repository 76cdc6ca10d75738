import glob
import time

from pyspark.sql import functions as F

from tessera.llm.common import CLEANUP, written


def shuffle_files(spark):
    top = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for f in glob.glob(f"{d}/*/shuffle_*")}


def test_shuffle_files_go_when_the_table_is_written(spark):
    rows = spark.range(5000).select((F.col("id") % 50).alias("k"), "id")
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    setting, before = spark.conf.get(CLEANUP, None), shuffle_files(spark)
    sums.write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before  # the place is right
    before = shuffle_files(spark)
    got = written(sums.join(rows.groupBy("k").count(), "k").repartition(3), "sums")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP, None) == setting
    assert {x.k: (x.s, x["count"]) for x in got.collect()} == {k: (sum(range(k, 5000, 50)), 100) for k in range(50)}
    assert {x.k: x.s for x in sums.collect()} == {k: sum(range(k, 5000, 50)) for k in range(50)}  # can be used again
