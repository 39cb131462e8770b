"""Crowd and queue streams: raw tables, live state, forecasts, alerts, messages.

Each stream is one ``foreachBatch`` job. What has to survive between batches (the
last readings, the smoothed densities, the live state) is a few dozen rows and is
kept in versioned snapshots: batch n reads version n-1 and writes version n, and
everything else it writes goes to a folder of its own number, so that a batch
repeated after a failure replaces its first attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import iso_time
from ..operators import alerts, flow, latest, wait
from ..operators.ordering import numbered
from ..schemas import STAND_STATE_COLUMNS, ZONE_STATE_COLUMNS
from ..sources import messages, tables, venue
from ..sources.tables import Snapshots, append_batch
from .delivery import Ledger, once, once_within

ZONE_STATE = (
    "zone string, last_updated timestamp, density double, headcount int, flow_rate double, "
    "direction string, congestion_level string, position long"
)
STAND_STATE = (
    "stand_id string, stand_name string, zone string, last_updated timestamp, queue_length int, "
    "wait_minutes double, capacity_pct double, is_open boolean, predicted_wait_5min double, "
    "predicted_wait_10min double, halftime_spike_expected boolean, tie long"
)

EVENT_TIME = "event_time"
ARRIVAL = "arrival"


def _start(stream: DataFrame, process, checkpoint: str, trigger: dict, within: str | None) -> StreamingQuery:
    stream = once_within(stream, within) if within else stream
    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _delivered(parsed: DataFrame, n: int, ledger: Ledger | None, process) -> None:
    """One copy of each message of batch ``n``, without those of earlier batches if there is a ledger."""
    rows = once(parsed)
    rows = (ledger.admit(rows, n) if ledger else rows).persist()
    try:
        process(rows, n)
        if ledger:
            ledger.record(rows, n)
    finally:
        rows.unpersist()


def _inside(order_by: str) -> list[str]:
    """The order of readings inside a batch."""
    return ["arrival", "tie"] if order_by == ARRIVAL else ["time", "tie"]


class CrowdStream:
    """Crowd messages to ``crowd_readings``, ``zones``, ``flow_predictions``, ``alerts``
    and ``messages`` under ``root``.

    ``order_by`` decides the order of readings inside a batch, by which runs count them, and
    which reading of a zone is its state: the last to arrive (even if older), or the last by
    event time, which repeats on replays. Batches follow each other in either case.
    ``offsets``: the messages' numbers are those of a source with offsets (see
    :func:`~gatherline.sources.messages.kafka_rows`); what an earlier batch took is not taken again.
    """

    def __init__(self, spark: SparkSession, root: str, order_by: str = ARRIVAL, offsets: bool = False):
        self.root, self.order_by = root, order_by
        self.ledger = Ledger(spark, f"{root}/ledger/crowd") if offsets else None
        self.zones = Snapshots(spark, f"{root}/zones", ZONE_STATE)
        self.recent = Snapshots(spark, f"{root}/recent", "index long, time timestamp, zone string, density double")
        self.smoothed = Snapshots(spark, f"{root}/smoothed", "zone string, smoothed double")

    def start(self, stream: DataFrame, trigger: dict | None = None, within: str | None = None) -> StreamingQuery:
        """``within``: drop copies of messages that come so long after each other (needs ``received``)."""
        parsed = messages.parse(stream, venue.CROWD_TOPIC)
        return _start(parsed, self.process, f"{self.root}/_checkpoint/crowd", trigger or {"availableNow": True}, within)

    def process(self, parsed: DataFrame, batch_id: int) -> None:
        _delivered(parsed, batch_id, self.ledger, self._process)

    def _process(self, parsed: DataFrame, n: int) -> None:
        readings = messages.accepted(parsed)
        append_batch(readings, f"{self.root}/crowd_readings", n)
        messages.quarantined(parsed).write.mode("overwrite").json(f"{self.root}/quarantine/batch={n}")

        recent = self.recent.read(n - 1)
        before = recent.agg(F.max("index")).first()[0] or 0
        fields = ["time", *ZONE_STATE_COLUMNS[:-1]]
        order = _inside(self.order_by)
        rows, last = numbered(readings.select("zone", *fields, *[c for c in order if c != "time"]), order, start=before)

        covered = recent.unionByName(rows.select("index", "time", "zone", "density"))
        runs = flow.flow_forecasts(
            covered, last, first_run=before // flow.RUN_EVERY + 1, start=self.smoothed.read(n - 1)
        ).persist()
        append_batch(runs.drop("smoothed"), f"{self.root}/flow_predictions", n)
        critical = alerts.critical_crowd_alerts(runs.withColumn("tie", F.col("run")))
        append_batch(
            tables.with_alert_defaults(critical, "source_order", "tie", "zone"), f"{self.root}/alerts/kind=crowd", n
        )
        sent = runs.withColumn("generated_at", iso_time(F.col("time"))).drop("time", "smoothed", "run")
        messages.predictions_as_messages(sent, None).write.mode("overwrite").json(f"{self.root}/messages/kind=flow/batch={n}")

        # A row per zone, made once of all runs.
        newest = flow.latest_run_per_zone(runs).persist()
        self.smoothed.write(latest.merge_state(self.smoothed.read(n - 1), newest.select("zone", "smoothed"), "zone"), n)
        # After a run the last KEPT readings stay buffered, plus those since.
        first_kept = last // flow.RUN_EVERY * flow.RUN_EVERY - flow.KEPT
        self.recent.write(covered.where(F.col("index") > first_kept), n)
        self.zones.write(self._state(rows, fields, newest, n), n)
        newest.unpersist()
        runs.unpersist()

    def _state(self, rows: DataFrame, fields: list[str], newest: DataFrame, n: int) -> DataFrame:
        order = ["index"] if self.order_by == ARRIVAL else ["time", "index"]
        seen = latest.zone_state(rows.withColumn("position", F.col("index")), order)
        position = latest.latest_per_key(rows, ["zone"], ["index"], order).withColumnRenamed("index", "position")
        fresh = seen.join(position, "zone").select("zone", "last_updated", *ZONE_STATE_COLUMNS, "position")
        old = self.zones.read(n - 1)
        if self.order_by == EVENT_TIME:
            both = old.unionByName(fresh)
            rest = [c for c in fresh.columns if c != "zone"]
            state = latest.latest_per_key(both, ["zone"], rest, ["last_updated", "position"])
        else:
            state = latest.merge_state(old, fresh, "zone")
        # A run overwrites the band of the zones it covers, until their next reading.
        banded = state.join(newest.select("zone", "fired_at", "congestion_risk"), "zone", "left")
        return banded.withColumn(
            "congestion_level",
            F.when(F.col("fired_at") >= F.col("position"), F.col("congestion_risk")).otherwise(
                F.col("congestion_level")
            ),
        ).drop("fired_at", "congestion_risk")


class QueueStream:
    """Queue messages to ``queue_readings``, ``stands``, ``wait_predictions``, ``alerts``
    and ``messages`` under ``root``; one forecast per message. Arguments as of :class:`CrowdStream`."""

    def __init__(self, spark: SparkSession, root: str, order_by: str = ARRIVAL, offsets: bool = False):
        self.root, self.order_by = root, order_by
        self.ledger = Ledger(spark, f"{root}/ledger/queues") if offsets else None
        self.stands = Snapshots(spark, f"{root}/stands", STAND_STATE)
        self.recent = Snapshots(
            spark, f"{root}/recent_queues", "stand_id string, time timestamp, tie long, queue_length int, place int"
        )

    def start(self, stream: DataFrame, trigger: dict | None = None, within: str | None = None) -> StreamingQuery:
        """``within``: drop copies of messages that come so long after each other (needs ``received``)."""
        parsed = messages.parse(stream, venue.QUEUE_TOPIC)
        return _start(parsed, self.process, f"{self.root}/_checkpoint/queues", trigger or {"availableNow": True}, within)

    def process(self, parsed: DataFrame, batch_id: int) -> None:
        _delivered(parsed, batch_id, self.ledger, self._process)

    def _process(self, parsed: DataFrame, n: int) -> None:
        readings = messages.accepted(parsed)
        append_batch(readings, f"{self.root}/queue_readings", n)
        messages.quarantined(parsed).write.mode("overwrite").json(f"{self.root}/quarantine_queues/batch={n}")

        # The two last readings of a stand come before the batch, whatever their time.
        carried = self.recent.read(n - 1).withColumn("_fresh", F.lit(0))
        inside = _inside(self.order_by)
        extra = [c for c in inside if c == "arrival"]
        fresh = readings.select("stand_id", "stand_name", "time", "tie", "queue_length", *extra).withColumns(
            {"_fresh": F.lit(1), "place": F.lit(0)}
        )
        both = fresh.unionByName(carried, allowMissingColumns=True)
        order = ["_fresh", "place", *inside]
        rates = wait.arrival_rates(both, order=tuple(order)).where("_fresh = 1").drop("_fresh", "place", *extra)
        forecasts = wait.forecasts(rates).persist()
        append_batch(forecasts, f"{self.root}/wait_predictions", n)
        spikes = alerts.spike_alerts(forecasts)
        append_batch(tables.with_alert_defaults(spikes, "source_order", "tie"), f"{self.root}/alerts/kind=queue", n)
        sent = forecasts.withColumn("generated_at", iso_time(F.col("time"))).drop("time", "tie", "queue_length")
        messages.predictions_as_messages(None, sent).write.mode("overwrite").json(
            f"{self.root}/messages/kind=wait/batch={n}"
        )

        self.recent.write(self._tail(both, order), n)
        self.stands.write(self._state(readings, forecasts, n), n)
        forecasts.unpersist()

    @staticmethod
    def _tail(rows: DataFrame, order: list[str]) -> DataFrame:
        """The two last rows of each stand: two maxima, each combined on the map side."""
        place = F.struct(*order)
        fields = ["time", "tie", "queue_length"]
        last = latest.latest_per_key(rows.withColumn("_at", place), ["stand_id"], [*fields, "_at"], order)
        ends = last.select("stand_id", F.col("_at").alias("_end"))  # a row per stand
        earlier = rows.join(F.broadcast(ends), "stand_id").where(place < F.col("_end"))
        second = latest.latest_per_key(earlier, ["stand_id"], fields, order)
        return last.select("stand_id", *fields, F.lit(1).alias("place")).unionByName(
            second.select("stand_id", *fields, F.lit(0).alias("place"))
        )

    def _state(self, readings: DataFrame, forecasts: DataFrame, n: int) -> DataFrame:
        fields = ["stand_name", "zone", "time", *STAND_STATE_COLUMNS, "tie"]
        seen = latest.latest_per_key(readings, ["stand_id"], fields, _inside(self.order_by)).withColumnRenamed("time", "last_updated")
        expected = ["predicted_wait_5min", "predicted_wait_10min", "halftime_spike_expected"]
        predicted = forecasts.join(F.broadcast(seen.select("stand_id", "tie")), ["stand_id", "tie"]).select("stand_id", *expected)
        old = self.stands.read(n - 1)
        if n == 0:
            seed = venue.stands(readings.sparkSession).select("stand_id", "stand_name", "zone")
            old = seed.select(
                "stand_id", "stand_name", "zone",
                F.lit(None).cast("timestamp").alias("last_updated"),
                F.lit(0).alias("queue_length"), F.lit(0.0).alias("wait_minutes"), F.lit(0.0).alias("capacity_pct"),
                F.lit(True).alias("is_open"),
                F.lit(None).cast("double").alias("predicted_wait_5min"),
                F.lit(None).cast("double").alias("predicted_wait_10min"),
                F.lit(False).alias("halftime_spike_expected"),
                F.lit(None).cast("long").alias("tie"),
            )
        if self.order_by == EVENT_TIME:
            known = old.select("stand_id", F.col("last_updated").alias("_t"), F.col("tie").alias("_i"))
            newer = F.col("_t").isNull() | (F.struct("last_updated", "tie") > F.struct("_t", "_i"))
            seen = seen.join(known, "stand_id", "left").where(newer).drop("_t", "_i")
        # Name and zone of a known stand stay as they are.
        names = old.select("stand_id", F.col("stand_name").alias("_name"), F.col("zone").alias("_zone"))
        keep = old.select("stand_id", *expected)
        updated = (
            seen.join(names, "stand_id", "left")
            .withColumns({"stand_name": F.coalesce("_name", "stand_name"), "zone": F.coalesce("_zone", "zone")})
            .drop("_name", "_zone")
            .join(keep, "stand_id", "left")
        )
        merged = latest.merge_state(old, updated.select(*old.columns), "stand_id")
        return latest.update_existing(merged, predicted, "stand_id", expected).select(*old.columns)
