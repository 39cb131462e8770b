"""Streams give the results of the batch operators, in any split into batches."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gatherline.functions.text import iso_time
from gatherline.operators import flow, latest, orders, rollup, routes, wait
from gatherline.plans import twin
from gatherline.plans.catalog import Data
from gatherline.sources import tables, venue
from gatherline.streaming import buckets, delivery, orders as order_streams, readings, routing


def rows_of(df, *fields):
    return sorted(map(repr, df.select(*fields).collect()))


def batches(df, splits):
    """JSON message batches of a readings table, cut at the given ties."""
    fields = [c for c in df.columns if c not in ("time", "tie")]
    sent = df.withColumn("timestamp", iso_time(F.col("time"))).select(
        F.to_json(F.struct("timestamp", *fields)).alias("value"), "tie", F.col("tie").alias("arrival")
    )
    edges = [0, *splits, 10**9]
    return [sent.where((F.col("tie") >= a) & (F.col("tie") < b)) for a, b in zip(edges, edges[1:])]


@pytest.fixture(scope="module")
def small(spark):
    """The readings of the first hours of the sample, enough for sixty runs."""
    whole = Data(spark, "/root/testdata/sf0.001")
    return whole.crowd.where("tie < 300").cache(), whole.queues.where("tie < 300").cache()


def parsed(batch, topic):
    from gatherline.sources import messages

    return messages.parse(batch, topic)


@pytest.mark.parametrize("splits", [[], [3, 120, 121]])
def test_crowd_batches(spark, folder, small, splits):
    crowd, _ = small
    job = readings.CrowdStream(spark, folder)
    parts = batches(crowd, splits)
    for n, batch in enumerate(parts):
        job.process(parsed(batch, venue.CROWD_TOPIC), n)
    fields = ["run", "time", "zone", "current_density", "predicted_density", "congestion_risk", "recommended_route", "avoid_zones"]
    streamed = tables.read_table(spark, f"{folder}/flow_predictions")
    assert rows_of(streamed, *fields) == rows_of(flow.forecast_history(crowd), *fields)
    state = ["zone", "last_updated", "density", "congestion_level"]
    assert rows_of(job.zones.read(len(parts) - 1), *state) == rows_of(twin.zones(crowd), *state)
    assert tables.read_table(spark, f"{folder}/crowd_readings").count() == crowd.count()


def test_repeated_batch_changes_nothing(spark, folder, small):
    crowd, _ = small
    job = readings.CrowdStream(spark, folder)
    for n, batch in enumerate(batches(crowd, [150])):
        for _ in range(2 if n else 1):
            job.process(parsed(batch, venue.CROWD_TOPIC), n)
    assert tables.read_table(spark, f"{folder}/crowd_readings").count() == crowd.count()
    fields = ["run", "zone", "predicted_density"]
    assert rows_of(tables.read_table(spark, f"{folder}/flow_predictions"), *fields) == rows_of(flow.forecast_history(crowd), *fields)


@pytest.mark.parametrize("splits", [[], [2, 3, 40, 200]])
def test_queue_batches(spark, folder, small, splits):
    _, queues = small
    job = readings.QueueStream(spark, folder)
    parts = batches(queues, splits)
    for n, batch in enumerate(parts):
        job.process(parsed(batch, venue.QUEUE_TOPIC), n)
    fields = ["tie", "stand_id", "predicted_wait_5min", "predicted_wait_10min", "halftime_spike_expected", "recommendation"]
    assert rows_of(tables.read_table(spark, f"{folder}/wait_predictions"), *fields) == rows_of(wait.wait_forecasts(queues), *fields)
    state = ["stand_id", "stand_name", "last_updated", "queue_length", "is_open", "predicted_wait_5min", "halftime_spike_expected"]
    assert rows_of(job.stands.read(len(parts) - 1), *state) == rows_of(twin.stands(queues), *state)


def test_order_by_event_time_or_arrival(spark, folder, small):
    _, queues = small
    older, newer = batches(queues, [150])
    states = {}
    for order_by in (readings.ARRIVAL, readings.EVENT_TIME):
        job = readings.QueueStream(spark, f"{folder}/{order_by}", order_by)
        for n, batch in enumerate((newer, older)):
            job.process(parsed(batch, venue.QUEUE_TOPIC), n)
        states[order_by] = rows_of(job.stands.read(1), "stand_id", "last_updated")
        assert tables.read_table(spark, f"{folder}/{order_by}/queue_readings").count() == queues.count()
    assert states[readings.EVENT_TIME] == rows_of(latest.stand_state(queues), "stand_id", "last_updated")
    assert states[readings.ARRIVAL] == rows_of(latest.stand_state(queues.where("tie < 150")), "stand_id", "last_updated")


def test_bad_messages_are_set_aside_and_stream_restarts(spark, folder, small):
    """A stream stopped after the first file goes on with the second one."""
    crowd, _ = small
    job = readings.CrowdStream(spark, f"{folder}/out")
    source = f"{folder}/in"

    def run():
        stream = spark.readStream.schema("value string, tie long, arrival long").json(source)
        job.start(stream).awaitTermination()

    first, second = batches(crowd, [150])
    first.coalesce(1).write.mode("append").json(source)
    run()
    bad = spark.createDataFrame([("{oops", 1, 1)], "value string, tie long, arrival long")
    second.union(bad).coalesce(1).write.mode("append").json(source)
    run()
    fields = ["run", "zone", "predicted_density"]
    assert rows_of(tables.read_table(spark, f"{folder}/out/flow_predictions"), *fields) == rows_of(flow.forecast_history(crowd), *fields)
    assert [r.reasons for r in spark.read.json(f"{folder}/out/quarantine").collect()] == [["unreadable"]]


def test_late_readings_and_closed_buckets(spark, folder):
    def t(hour, minute):
        return datetime(2024, 1, 1, hour, minute, tzinfo=timezone.utc)

    schema = "time timestamp, zone string, density double, headcount int, flow_rate double"
    parts = [
        [(t(12, 0), "Gate-East", 0.2, 10, 1.0), (t(12, 1), "Gate-East", 0.4, 20, 1.0)],
        [(t(12, 30), "Gate-East", 0.6, 30, 1.0), (t(12, 1), "Gate-East", 0.6, 50, 1.0)],  # still in time
        [(t(12, 0), "Gate-East", 0.9, 99, 1.0), (t(12, 45), "Gate-East", 0.6, 30, 1.0)],  # too late
        [(t(13, 30), "Gate-East", 0.6, 30, 1.0)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = buckets.start(buckets.crowd_bucket_stream(stream), f"{folder}/out", f"{folder}/ckpt", {"availableNow": True})
        query.awaitTermination()
    got = {r.bucket: (r.avg_density, r.max_headcount) for r in spark.read.parquet(f"{folder}/out").collect()}
    naive = lambda h, m: datetime(2024, 1, 1, h, m)
    assert got == {naive(12, 0): (0.2, 10), naive(12, 1): (0.5, 50), naive(12, 30): (0.6, 30), naive(12, 45): (0.6, 30)}


def test_refresh_leaves_the_newest_bucket_out(spark, small):
    crowd, _ = small
    rows = rollup.crowd_buckets(crowd)
    now = datetime(2024, 1, 5, 0, 0, tzinfo=timezone.utc)
    kept = rollup.refreshed_only(rows, now).agg(F.max("bucket")).first()[0]
    assert kept <= datetime(2024, 1, 4, 23, 58)


def test_routing_stream(spark, folder):
    rows = [(venue.ALERTS_TOPIC, "k", '{"zone": "Gate-East"}'), (venue.INTELLIGENCE_TOPIC, "wait:C4", "{}")]
    spark.createDataFrame(rows, "topic string, key string, value string").write.json(f"{folder}/in")
    stream = spark.readStream.schema("topic string, key string, value string").json(f"{folder}/in")
    routing.start(stream, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    got = sorted((r.room, r.type) for r in spark.read.json(f"{folder}/out").collect())
    assert got == [("ops", "alert"), ("ops", "wait_intelligence"), ("zone:Gate-East", "alert")]


def test_order(spark, folder):
    """The worked example: price, wait, walk and delivery time of one order."""
    at = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    queue = spark.createDataFrame([(at, 1, "C4", "Hot Dogs & Snacks", 4, True)], "time timestamp, tie long, stand_id string, stand_name string, queue_length int, is_open boolean")
    closed = queue.withColumns({"stand_id": F.lit("B2"), "is_open": F.lit(False)})
    calm = spark.createDataFrame([(at, "Gate-East", 0.0)], "snapshot timestamp, zone string, density double")
    items = [("Nachos", 2, 8.50), ("Cola", 1, 3.25)]
    asked = [(at, 10, "D-14", "c4", items, None), (at, 11, "D-14", "ZZ99", items, None), (at, 12, "D-14", "B2", items, None), (at, 13, "D-14", "C4", [], None)]
    requests = spark.createDataFrame(
        asked,
        "placed_at timestamp, tie long, seat_id string, stand_id string, items array<struct<name:string,quantity:int,price:double>>, special_instructions string",
    )
    job = order_streams.OrderStream(
        spark,
        folder,
        lambda: wait.wait_forecasts(queue.unionByName(closed)),
        lambda: routes.density_maps(calm, ["snapshot"]),
        "1 hour",
    )
    for _ in range(2):
        job.process(requests, 0)
    (order,) = tables.read_table(spark, f"{folder}/fan_orders").collect()
    assert (order.total_price, order.queue_wait_minutes, order.walk_minutes, order.delivery_eta_minutes) == (20.25, 16.35, 0.5, 17.85)
    assert (order.status, order.zone, order.stand_name) == ("placed", "Lower-Stands", "Hot Dogs & Snacks")
    assert order.delivery_eta_timestamp == datetime(2024, 1, 1, 12, 17, 51)
    reasons = {r.tie: r.reason for r in spark.read.json(f"{folder}/rejected").collect()}
    assert reasons == {11: "stand not found", 12: "stand closed", 13: "no items"}
    (sent,) = spark.read.json(f"{folder}/messages").collect()
    assert sent.key == "order:D-14"
    history = orders.order_history(tables.read_table(spark, f"{folder}/fan_orders"), "D-14", status="placed")
    assert history.count() == 1 and orders.order_history(history, "D-14", status="delivered").count() == 0


STATE = ["stand_id", "stand_name", "last_updated", "queue_length", "is_open", "predicted_wait_5min", "halftime_spike_expected"]


def kafka(df, first, last, partitions=3):
    """Messages with ties from first to last as Kafka's columns."""
    sent = batches(df, [])[0].where(F.col("tie").between(first, last))
    times = df.select(F.col("tie").alias("t"), F.col("time").alias("timestamp"))
    from gatherline.sources import messages

    return messages.kafka_rows(
        sent.join(times, F.col("tie") == F.col("t")).select(
            F.lit("topic").alias("topic"), F.lit("k").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
            (F.col("tie") % partitions).cast("int").alias("partition"), F.floor(F.col("tie") / partitions).alias("offset"), "timestamp",
        )
    )


def test_repeated_and_replayed_messages(spark, folder, small):
    """A message twice in a batch, and batches that overlap or come again, leave one row per stand and message."""
    _, queues = small
    job = readings.QueueStream(spark, folder, offsets=True)
    first = kafka(queues, 0, 119)
    parts = [first.union(first), kafka(queues, 60, 179), kafka(queues, 200, 299), kafka(queues, 200, 299)]
    for n, batch in enumerate(parts):
        for _ in range(2 if n == 1 else 1):  # one attempt is tried again
            job.process(parsed(batch, venue.QUEUE_TOPIC), n)
    arrived = queues.where("tie < 180 OR tie >= 200")
    assert rows_of(job.stands.read(3), *STATE) == rows_of(twin.stands(arrived), *STATE)
    assert tables.read_table(spark, f"{folder}/queue_readings").count() == arrived.count() == 280
    fields = ["time", "stand_id", "predicted_wait_5min", "recommendation"]
    assert rows_of(tables.read_table(spark, f"{folder}/wait_predictions"), *fields) == rows_of(wait.wait_forecasts(arrived), *fields)
    found = job.ledger.deliveries().collect()
    assert {r.batch_id: 0 for r in found} == {0: 0, 1: 0, 2: 0}
    assert sum(r.missing for r in found) == 20 and all(r.missing == 0 for r in found if r.batch_id < 2)


def test_ledger_of_new_partitions_and_unnumbered_messages(spark, folder):
    ledger = delivery.Ledger(spark, folder)
    number = lambda p, o: (p << 44) + o
    frame = lambda ties: spark.createDataFrame([(t,) for t in ties], "tie long")
    takes = []
    for n, ties in enumerate([[number(0, 5), number(0, 6), None], [], [number(0, 6), number(0, 9), number(7, 0), None]]):
        admitted = ledger.admit(frame(ties), n)
        takes.append(sorted(r.tie if r.tie is not None else -1 for r in admitted.collect()))
        ledger.record(admitted, n)
    assert takes == [[-1, 5, 6], [], [-1, 9, number(7, 0)]]
    found = {(r.batch_id, r.partition): (r.expected_offset, r.taken, r.missing) for r in ledger.deliveries().collect()}
    assert found == {(0, 0): (5, 2, 0), (2, 0): (7, 1, 2), (2, 7): (0, 1, 0)}


def test_copies_within_a_time_are_dropped_in_the_state_store(spark, folder, small):
    """Copies in later batches go, also after a restart; readings that are late by their own time stay."""
    _, queues = small
    times = queues.select("tie", (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("tie"))).alias("received"))
    sent = batches(queues, [])[0].join(times, "tie")
    job = readings.QueueStream(spark, f"{folder}/out")
    for part in ("tie >= 150 AND tie < 200", "tie < 150 AND tie >= 100 OR tie >= 180 AND tie < 220", "tie >= 100 AND tie < 220"):
        sent.where(part).coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema("value string, tie long, arrival long, received timestamp").json(f"{folder}/in")
        job.start(stream, within="1 hour").awaitTermination()
    kept = tables.read_table(spark, f"{folder}/out/queue_readings")
    assert sorted(r.tie for r in kept.collect()) == [r.tie for r in queues.where("tie BETWEEN 100 AND 219").orderBy("tie").collect()]
