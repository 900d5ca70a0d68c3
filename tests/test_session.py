"""Session helpers: the shared checkpoint folder."""

from assetlens.session import checkpoint_dir, drop_shared, shared_table


def test_checkpoint_dir_is_stable(spark):
    a = checkpoint_dir(spark)
    b = checkpoint_dir(spark)
    assert a == b and a


def test_shared_table_reads_back(spark):
    df = shared_table(spark.range(3), "three")
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2]
    assert shared_table(spark.range(0), "none").count() == 0


def test_drop_shared_deletes_the_files(spark):
    df = shared_table(spark.range(3), "gone")
    drop_shared(df)
    path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
