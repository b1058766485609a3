import tempfile

from loomery.streaming import activity


def test_ingest_stream_has_every_event_once(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    top = tempfile.mkdtemp(prefix="stream-")
    events.union(events.limit(50)).repartition(3).write.parquet(f"{top}/in")
    stream = activity.source(spark, f"{top}/in", events.schema)
    query = activity.ingest(stream, f"{top}/out", f"{top}/state", "event_id")
    assert query.awaitTermination(60)
    out = activity.latest(spark.read.parquet(f"{top}/out"), "event_id", "ts")
    assert out.count() == events.count()
