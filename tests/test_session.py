"""Lineage cuts go to the folder named by spark.checkpoint.dir."""

from tableprep.session import cut_lineage, ensure_checkpoint_dir


def test_checkpoint_dir_comes_from_session_conf(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    got = ensure_checkpoint_dir(spark)
    assert got.replace("file:", "").startswith(configured.replace("file:", ""))


def test_cut_lineage_is_reliable_checkpoint(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    out = cut_lineage(df)
    assert out.count() == 100
    assert "LogicalRDD" in out._jdf.queryExecution().logical().toString()
