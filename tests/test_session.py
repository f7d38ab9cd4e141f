import os

from rivaq import session


def test_written_tables_go(spark):
    with session.scratch(spark):
        a, b = session.saved(spark.range(5), "a"), session.saved(spark.range(3), "b")
        paths = [a._rivaq_path, b._rivaq_path]
        assert a.count() == 5 and all(map(os.path.isdir, paths))
        session.discard(a, None, spark.range(1))
        assert [os.path.isdir(p) for p in paths] == [False, True]
    assert not any(map(os.path.isdir, paths))


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    many, shuffled = spark.range(0, 100, 1, cores + 3), spark.range(0, 100, 1, 1).groupBy("id").count()
    assert session.spread(many) is many and session.spread(shuffled) is shuffled
