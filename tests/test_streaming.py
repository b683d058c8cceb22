"""Stateless cleaning and a fitted stage applied to a parquet stream."""

import os
import tempfile

from pyspark.sql import functions as F

from tableprep.functions.text import clean_text
from tableprep.streaming import score as ST

from conftest import SF_SMALL



def run_to_memory(stream, query_name, checkpoint, mode="append"):
    """Drive a stream to completion into an in-memory table."""
    q = (stream.writeStream.format("memory").queryName(query_name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_clean_text_stream_matches_batch(spark):
    path = os.path.join(SF_SMALL, "documents.parquet")
    batch = spark.read.parquet(path)
    stream = ST.read_parquet_stream(spark, path, batch.schema)
    out = ST.clean_text_stream(stream, "text").select("doc_id", "text_clean")
    run_to_memory(out, "docs_clean_stream", tempfile.mkdtemp(prefix="stream-ckpt-", dir="/tmp"))
    got = spark.sql("SELECT * FROM docs_clean_stream")
    expect = batch.select("doc_id", clean_text("text").alias("text_clean"))
    assert got.count() == expect.count()
    assert got.exceptAll(expect).count() == 0


def test_fitted_encoder_on_stream(spark):
    from tableprep.operators import encode as E
    path = os.path.join(SF_SMALL, "orders.parquet")
    batch = spark.read.parquet(path)
    model = E.TargetEncoder(["o_orderpriority"], "o_totalprice").fit(batch)
    stream = ST.read_parquet_stream(spark, path, batch.schema)
    out = ST.score_stream(model, stream).select("o_orderkey", "o_orderpriority_te")
    run_to_memory(out, "orders_te_stream", tempfile.mkdtemp(prefix="stream-ckpt-", dir="/tmp"))
    got = spark.sql("SELECT * FROM orders_te_stream")
    expect = model.transform(batch).select("o_orderkey", "o_orderpriority_te")
    assert got.exceptAll(expect).count() == 0 and got.count() == batch.count()


def test_event_counts_stream(spark):
    path = os.path.join(SF_SMALL, "events.parquet")
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = ST.read_parquet_stream(spark, path, spark.read.parquet(path).schema) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    out = ST.event_counts_stream(stream, "ts", "1 hour", "1000 days")
    run_to_memory(out, "event_counts_stream", tempfile.mkdtemp(prefix="stream-ckpt-", dir="/tmp"), "complete")
    got = spark.sql("SELECT sum(n) FROM event_counts_stream").first()[0]
    assert got == batch.count()
