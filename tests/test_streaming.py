from prismveil.streaming.desanitizer import desanitize_stream

SCHEMA = "stream_id string, seq bigint, delta string, is_end boolean, tokens map<string,string>"


def test_stream_restores_out_of_order_chunks_over_micro_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [
        [("s", 0, "hi [EM", False, {"[EMAIL_0]": "a@b.de"}), ("s", 2, "]! [x", True, None), ("u", 0, "plain", False, None)],
        [("s", 1, "AIL_0", False, None)],
        [("u", 1, " [EMAIL_0]", True, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = (
            desanitize_stream(spark.readStream.schema(SCHEMA).parquet(source))
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    got = sorted((r.stream_id, r.seq, r.text) for r in spark.read.parquet(out).collect())
    assert got == [("s", 0, "hi "), ("s", 1, ""), ("s", 2, "a@b.de! [x"), ("u", 0, "plain"), ("u", 1, " [EMAIL_0]")]
