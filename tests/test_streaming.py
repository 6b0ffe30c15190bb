from tessera.session import table
from tessera.streaming.windows import event_counts

SF = "/root/testdata/sf0.001"


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = table(spark, SF, "events")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["start"], r["event_type"])
    got = sorted(spark.table("counts").collect(), key=key)
    want = sorted(event_counts(events).collect(), key=key)
    assert [(key(r), r["n"], round(r["total"], 6)) for r in got] == [(key(r), r["n"], round(r["total"], 6)) for r in want]
