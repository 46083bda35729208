"""The shared folder's name."""

from quillspark.session import qualified


def test_folders_without_a_scheme_get_that_of_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020")
        assert qualified(spark, "/user/x/ckpt") == "hdfs://name:8020/user/x/ckpt"
        assert qualified(spark, "file:///a") == "file:///a" and qualified(spark, "s3a://b/c") == "s3a://b/c"
    finally:
        conf.set("fs.defaultFS", before)
    assert qualified(spark, "/tmp/a") == "/tmp/a"
