"""Results delivered by count and by time, from a stream that goes on after a pause."""

from nearfield import working
from nearfield.plans import catalogue
from nearfield.streaming import delivery


def test_batches_by_count_and_by_time_survive_a_restart(spark):
    own = delivery.with_store(spark)
    folder, out, checkpoint = (working.fresh(spark, n) for n in ("results", "batches", "state"))

    def come(run, items):
        own.createDataFrame([(run, i) for i in items], "run string, item long").coalesce(1).write.mode("append").parquet(folder)

    def seen():
        return sorted((r.run, r.batch, list(r["items"]), r.done, r.reason) for r in own.read.parquet(out).collect())

    come("a", [3, 1, 2, 9, 8, 7, 5, None])
    come("b", range(5))
    come(None, [4])
    stream = own.readStream.schema("run string, item long").parquet(folder)
    batches = delivery.delivered(stream, "run", "item", rows=5, wait_ms=500)
    delivery.drained(batches, out, checkpoint, 12)
    assert seen() == [("a", 0, [1, 2, 3, 5, 7], 5, "count"), ("a", 1, [8, 9], 7, "time"), ("b", 0, [0, 1, 2, 3, 4], 5, "count")]
    come("a", range(20, 26))
    come("b", [6])
    # the query is started again on the state of the first one
    delivery.drained(delivery.delivered(stream, "run", "item", rows=5, wait_ms=500), out, checkpoint, 19)
    assert seen()[2:] == [("a", 2, [20, 21, 22, 23, 24], 12, "count"), ("a", 3, [25], 13, "time"), ("b", 0, [0, 1, 2, 3, 4], 5, "count"), ("b", 1, [6], 6, "time")]


def test_delivery_of_events_is_whole(spark):
    got = catalogue.QUERIES["delivered_in_time"](spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert got.selectExpr("sum(n)").first()[0] == events and got.where("reason = 'count' and n <> 500").count() == 0
