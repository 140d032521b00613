import uuid

from reelsift.session import shared_dir
from reelsift.streaming.greedy_stream import greedy_stream


def test_late_rows_are_dropped_and_state_lives_on(spark, tmp_path):
    """Two files, one micro-batch each: the second meets the first one's buffer, and its late row is dropped."""
    schema = "k string, n long, v double"
    held = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(held)
    spark.conf.set(held, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, rows in enumerate(([("a", 1, 0.0), ("a", 5, 10.0), ("a", 5, 15.0), ("b", 1, 0.0)], [("a", 3, 99.0), ("a", 6, 0.5), ("a", 7, 20.0), ("b", 2, 50.0)])):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            chosen = greedy_stream(stream, "k", "n", "v", lambda v, b: min(abs(v - h) for h in b) >= 1, 10, late="late")
            at = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}" if not i else at
            q = chosen.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(held, before)
    rows = spark.read.schema(f"{schema}, late boolean").parquet(f"{at}/rows").collect()
    assert sorted((r.k, r.n) for r in rows if not r.late) == [("a", 1), ("a", 5), ("a", 5), ("a", 7), ("b", 1), ("b", 2)]
    assert [(r.k, r.n) for r in rows if r.late] == [("a", 3)]  # it is dropped, and said to be
