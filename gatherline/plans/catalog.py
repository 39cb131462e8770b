"""Every operator as a query over the sample tables, for checks and benchmarks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crowd as crowd_f
from ..functions import queueing, text
from ..functions.numbers import round_half_up
from ..functions.times import at
from ..operators import alerts, egress, flow, heatmap, latest, orders, rollup, routes, snapshot, wait
from ..operators.ordering import numbered
from ..session import scratch_path, use_utc
from ..sources import adapters, messages, tables, venue
from ..streaming import buckets as bucket_streams
from ..streaming import keyed as keyed_streams
from ..streaming import orders as order_streams
from ..streaming import readings as reading_streams
from ..streaming import refresh as refresh_streams
from ..streaming import routing as routing_streams
from . import answers, twin

BUCKET = "10 minutes"
TICK = "1 hour"
AS_OF = datetime(2024, 1, 29, 12, 0, 0)

_CATALOG: dict = {}


class Data:
    """The sample tables as readings and orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = adapters.table(self.spark, self.sf_dir, name)
        return self._tables[name]

    @property
    def crowd(self) -> DataFrame:
        return adapters.crowd(self.table("events"))

    @property
    def queues(self) -> DataFrame:
        return adapters.queues(self.table("events"))

    @property
    def ble(self) -> DataFrame:
        return adapters.ble(self.table("events"))

    @property
    def cctv(self) -> DataFrame:
        return adapters.cctv(self.table("events"))

    @property
    def requests(self) -> DataFrame:
        return adapters.order_requests(self.table("events"))

    @property
    def orders(self) -> DataFrame:
        return adapters.stored_orders(self.table("orders"), self.table("lineitem"), self.table("part"))

    @property
    def order_heads(self) -> DataFrame:
        """Stored orders without their items: the optimizer drops the line tables
        only if nothing of them is asked for, so this does not join them at all."""
        none = self.table("lineitem").where("false")
        return adapters.stored_orders(self.table("orders"), none, self.table("part")).drop("items")

    @property
    def alerts(self) -> DataFrame:
        """Sensor and spike alerts with ids; every third source reading is resolved."""
        found = alerts.union([
            alerts.sensor_alerts(self.queues, self.crowd, self.cctv),
            alerts.spike_alerts(wait.wait_forecasts(self.queues)),
        ])
        severity = F.coalesce("severity", F.when(F.col("category") == "queue", "warning").otherwise("critical"))
        return found.select(
            "time",
            text.uuid_from(F.col("source_order"), F.col("tie")).alias("alert_id"),
            severity.alias("severity"),
            "category",
            "zone",
            "stand_id",
            "message",
            (F.col("tie") % 3 == 0).alias("resolved"),
        )


def query(fn):
    """Register a function of :class:`Data` as a query of its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(fn(Data(spark, sf_dir)))

    run.__doc__ = fn.__doc__
    _CATALOG[fn.__name__] = run
    return fn


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps without zone, so that every client reads the same values."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def catalog() -> dict:
    return dict(_CATALOG)


def _joined(column, separator: str = ","):
    return F.array_join(column, separator)


# --- sources and sinks ------------------------------------------------------


def crowd_messages_with_faults(d: Data) -> DataFrame:
    """Crowd readings as JSON, some cut short, out of range or without a zone."""
    tie = F.col("tie")
    faulty = (
        d.crowd.withColumn("density", F.when(tie % 19 == 1, F.col("density") + 1.5).otherwise(F.col("density")))
        .withColumn("zone", F.when(tie % 23 != 2, F.col("zone")))
        .withColumn("timestamp", F.when(tie % 29 == 3, "not a time").otherwise(text.iso_time(F.col("time"))))
    )
    value = F.to_json(F.struct("sensor_id", "zone", "timestamp", "density", "headcount", "flow_rate", "direction"))
    return faulty.select("tie", F.when(tie % 17 == 0, F.substring(value, 1, 20)).otherwise(value).alias("value"))


@query
def s1_parse_crowd(d):
    return messages.accepted(messages.parse(crowd_messages_with_faults(d), venue.CROWD_TOPIC))


@query
def s2_parse_ble(d):
    sent = d.ble.withColumn("timestamp", F.concat(text.iso_time(F.col("time")), F.lit("Z")))
    value = F.to_json(F.struct("beacon_id", "location_label", "zone", "timestamp", "active_devices", "rssi_avg", "dwell_time_avg"))
    return messages.accepted(messages.parse(sent.select("tie", value.alias("value")), venue.BLE_TOPIC))


@query
def s2_parse_cctv(d):
    sent = d.cctv.withColumn("timestamp", text.iso_time(F.col("time")))
    value = F.to_json(
        F.struct("camera_id", "zone", "timestamp", "headcount_estimate", "motion_intensity", "anomaly_detected", "anomaly_type")
    )
    return messages.accepted(messages.parse(sent.select("tie", value.alias("value")), venue.CCTV_TOPIC))


@query
def s3_timestamps(d):
    iso = text.iso_time(F.col("time"))
    form = F.col("tie") % 4
    written = (
        F.when(form == 0, F.concat(iso, F.lit("Z")))
        .when(form == 1, F.concat(iso, F.lit("+02:00")))
        .when(form == 2, iso)
        .otherwise(F.concat(F.lit("at "), iso))
    )
    return d.crowd.select("tie", text.parse_time(written).alias("time"))


@query
def s4_quarantine(d):
    bad = messages.quarantined(messages.parse(crowd_messages_with_faults(d), venue.CROWD_TOPIC))
    return bad.select("tie", _joined("reasons", "; ").alias("reasons"))


def _written(d: Data, df: DataFrame, name: str, time: str = "time") -> DataFrame:
    path = scratch_path(d.spark, name)
    tables.append(df, path, time)
    return tables.read_table(d.spark, path)


@query
def s5_append_crowd(d):
    return _written(d, d.crowd, "crowd_readings")


@query
def s6_append_queue(d):
    return _written(d, d.queues, "queue_readings")


@query
def s7_append_wait_predictions(d):
    columns = [
        "time", "tie", "stand_id", "stand_name", "predicted_wait_5min", "predicted_wait_10min",
        "arrival_rate_lambda", "service_rate_mu", "server_count", "utilization_rho", "halftime_spike_expected",
    ]
    return _written(d, wait.wait_forecasts(d.queues).select(*columns), "wait_predictions").drop("date")


@query
def s8_append_flow_predictions(d):
    rows = flow.forecast_history(d.crowd).select(
        "time", "run", "zone", "predicted_density", "recommended_route", "congestion_risk", "avoid_zones"
    )
    back = _written(d, rows, "flow_predictions").drop("date")
    return back.withColumn("avoid_zones", _joined("avoid_zones"))


@query
def s9_append_alerts(d):
    found = alerts.sensor_alerts(d.queues, d.crowd, d.cctv).withColumn("severity", F.lit("warning"))
    return _written(d, tables.with_alert_defaults(found, "source_order", "tie"), "alerts").drop("date")


def placed(d: Data) -> tuple[DataFrame, DataFrame]:
    forecasts = wait.wait_forecasts(d.queues)
    cold = wait.default_forecast(venue.stands(d.spark))
    densities = routes.snapshot_densities(d.crowd, BUCKET)
    return orders.place_orders(d.requests, forecasts, cold, densities, BUCKET, d.order_heads)


@query
def s10_append_orders(d):
    accepted, _ = placed(d)
    back = _written(d, accepted, "fan_orders", "placed_at")
    return back.select(
        "tie", "order_id", "seat_id", "stand_id", "stand_name", "zone", "status", "total_price", "placed_at", "date",
        text.items_to_json(F.col("items")).isNotNull().alias("has_items"),
    )


@query
def s11_zone_state(d):
    return latest.zone_state(d.crowd)


@query
def s12_stand_state(d):
    return latest.stand_state(d.queues)


@query
def s13_seeded_stands(d):
    """Only half the stands have readings; the others exist with zero state."""
    return latest.stand_state(d.queues.where(F.col("stand_id").isin("C4", "B2", "A7", "B5")))


def _field(name: str):
    return F.get_json_object("value", f"$.{name}")


@query
def s14_publish_predictions(d):
    wait_rows = wait.wait_forecasts(d.queues).select("tie", "stand_id", "predicted_wait_5min", "halftime_spike_expected")
    sent = messages.predictions_as_messages(None, wait_rows)
    return sent.select(
        "topic",
        "key",
        _field("tie").cast("long").alias("tie"),
        _field("predicted_wait_5min").cast("double").alias("predicted_wait_5min"),
        _field("halftime_spike_expected").cast("boolean").alias("halftime_spike_expected"),
    )


@query
def s14_publish_orders(d):
    accepted, _ = placed(d)
    sent = messages.orders_as_messages(accepted.select("seat_id", "tie", "total_price", "status"))
    return sent.select(
        "topic", "key", _field("tie").cast("long").alias("tie"),
        _field("total_price").cast("double").alias("total_price"), _field("status").alias("status"),
    )


def _read(sent: DataFrame, fields: str) -> DataFrame:
    """Messages with the fields of their payloads, each parsed once. ``fields``: names and types."""
    payload = F.try_parse_json("value")
    types = [f.split() for f in fields.split(", ")]
    rows = sent.select("topic", "key", payload.alias("p"))
    return rows.select("topic", "key", *[F.try_variant_get("p", f"$.{name}", kind).alias(name) for name, kind in types])


@query
def s14_flow_payloads(d):
    """Every field of every published flow forecast."""
    sent = messages.predictions_as_messages(flow.forecast_history(d.crowd).drop("smoothed", "time"), None)
    rows = _read(
        sent,
        "run bigint, zone string, current_density double, predicted_density double, congestion_risk string, "
        "recommended_route string, avoid_zones array<string>",
    )
    return rows.withColumn("avoid_zones", _joined("avoid_zones"))


@query
def s14_wait_payloads(d):
    """Every field of every published wait forecast."""
    rows = wait.wait_forecasts(d.queues).withColumn("generated_at", text.iso_time(F.col("time"))).drop("time")
    return _read(
        messages.predictions_as_messages(None, rows),
        "tie bigint, stand_id string, stand_name string, queue_length int, current_wait_min double, predicted_wait_5min double, "
        "predicted_wait_10min double, arrival_rate_lambda double, utilization_rho double, service_rate_mu double, "
        "server_count int, halftime_spike_expected boolean, recommendation string, generated_at string",
    )


def _with_items(orders_: DataFrame) -> DataFrame:
    """A row per item of each order, with the order's own fields."""
    rest = [c for c in orders_.columns if c != "items"]
    each = orders_.select(*rest, F.posexplode("items").alias("place", "item"))
    return each.select(*rest, "place", *[F.col(f"item.{c}").alias(f"item_{c}") for c in ("name", "quantity", "price")])


_ORDER_COLUMNS = [
    "order_id", "seat_id", "stand_id", "stand_name", "zone", "status", "queue_wait_minutes", "walk_minutes",
    "delivery_eta_minutes", "delivery_eta_timestamp", "placed_at", "total_price", "special_instructions", "updated_at",
]


@query
def s10_stored_orders(d):
    """Placed orders as they are stored: all fifteen columns, a row per item."""
    accepted, _ = placed(d)
    return _with_items(_written(d, accepted, "fan_orders", "placed_at").select(*_ORDER_COLUMNS, "items"))


@query
def s14_order_payloads(d):
    """Every field of every published order, a row per item."""
    accepted, _ = placed(d)
    stamped = accepted.withColumns({c: text.iso_time(F.col(c)) for c in ("placed_at", "delivery_eta_timestamp", "updated_at")})
    rows = _read(
        messages.orders_as_messages(stamped),
        "tie bigint, order_id string, seat_id string, stand_id string, stand_name string, zone string, status string, "
        "queue_wait_minutes double, walk_minutes double, delivery_eta_minutes double, delivery_eta_timestamp string, "
        "placed_at string, total_price double, updated_at string, items array<struct<name:string,quantity:int,price:double>>",
    )
    return _with_items(rows)


@query
def t5_order_history(d):
    """The newest orders of every seat, all columns, with their items."""
    accepted, _ = placed(d)
    kept = orders.order_histories(accepted, 20)
    return _with_items(kept.select("place_in_history", *_ORDER_COLUMNS, "items"))


@query
def s15_publish_readings(d):
    sent = messages.readings_as_messages(d.crowd, venue.CROWD_TOPIC).unionByName(
        messages.readings_as_messages(d.queues, venue.QUEUE_TOPIC)
    )
    return sent.select("topic", "key", _field("sensor_id").alias("sensor_id"), _field("timestamp").alias("timestamp"))


def _flat_snapshot(rows: DataFrame) -> DataFrame:
    names = ["crowd_sensors", "queue_sensors", "ble_beacons", "cctv_cameras"]
    return rows.select(
        "time",
        "total_attendance",
        "venue_congestion_level",
        *[F.size(n).alias(n) for n in names],
        F.size("alerts").alias("alert_count"),
        _joined("alerts", "|").alias("alerts"),
    )


def _readings(d: Data) -> dict[str, DataFrame]:
    return {"crowd": d.crowd, "queue": d.queues, "ble": d.ble, "cctv": d.cctv}


@query
def s16_snapshot(d):
    return _flat_snapshot(snapshot.snapshot_at(_readings(d), AS_OF))


@query
def s17_snapshots(d):
    return _flat_snapshot(snapshot.snapshots_per_tick(_readings(d), TICK))


#: What snapshots list of a sensor, beside its name and time: list, texts and flags, numbers.
_LISTED = {
    "crowd": ("crowd_sensors", ["zone", "direction"], ["density", "headcount", "flow_rate"]),
    "queue": ("queue_sensors", ["stand_id", "stand_name", "zone", "is_open"], ["queue_length", "wait_minutes", "capacity_pct"]),
    "ble": ("ble_beacons", ["location_label", "zone"], ["active_devices", "rssi_avg", "dwell_time_avg"]),
    "cctv": ("cctv_cameras", ["zone", "anomaly_detected", "anomaly_type"], ["headcount_estimate", "motion_intensity"]),
}


def sensor_rows(snapshots: DataFrame) -> DataFrame:
    """A row per sensor that a snapshot lists, with all its fields."""
    parts = []
    for kind, (name, texts, numbers) in _LISTED.items():
        sensor, _ = snapshot.sensor_fields(kind)
        each = snapshots.select(F.col("time").alias("tick"), F.inline(name))
        values = [F.col(c).cast("double") for c in numbers] + [F.lit(None).cast("double")] * (3 - len(numbers))
        parts.append(each.select(
            "tick", F.lit(kind).alias("kind"), F.col(sensor).alias("sensor"), "time",
            F.concat_ws("|", *[F.col(c).cast("string") for c in texts]).alias("words"),
            *[v.alias(f"value_{i}") for i, v in enumerate(values, 1)],
        ))
    return alerts.union(parts)


@query
def s16_sensor_rows(d):
    """All fields of all sensors in the snapshot at one time."""
    return sensor_rows(snapshot.snapshot_at(_readings(d), AS_OF))


@query
def s17_sensor_rows(d):
    """All fields of all sensors in the snapshots of all ticks."""
    return sensor_rows(snapshot.snapshots_per_tick(_readings(d), TICK))


# --- projections and filters -------------------------------------------------


@query
def p1_zone_readings(d):
    return latest.one_zone(d.crowd, "Concourse-A").select("tie", "time", "sensor_id", "density", "headcount")


@query
def p2_stand_lookup(d):
    return latest.one_stand(latest.stand_state(d.queues), "c4")


@query
def p3_zone_lookup(d):
    return latest.one_zone(latest.zone_state(d.crowd), "Gate-East")


@query
def p4_anomalies(d):
    return latest.anomalies(d.cctv).select("tie", "time", "camera_id", "zone", "anomaly_type")


@query
def p5_open_stands(d):
    unknown = d.queues.withColumn("is_open", F.when(F.col("tie") % 7 != 0, F.col("is_open")))
    return latest.open_stands(unknown).select("tie", "stand_id", "is_open")


@query
def p6_unresolved_alerts(d):
    return alerts.unresolved(d.alerts).select("time", "alert_id", "severity", "category", "message")


@query
def p7_seat_orders(d):
    found = orders.order_history(d.orders, "U1", 100, "delivered")
    return found.select("order_id", "placed_at", "stand_id", "status", F.size("items").alias("item_count"))


@query
def p8_recent_buckets(d):
    raw = rollup.readings_for_history(d.crowd, AS_OF, 1440, BUCKET)
    return rollup.history(rollup.crowd_buckets(raw, BUCKET), "zone", "Gate-North", AS_OF, 1440)


@query
def p9_gate_buckets(d):
    raw = rollup.readings_for_history(d.crowd, AS_OF, 1440, BUCKET)
    return rollup.crowd_buckets(raw, BUCKET).where(
        F.col("zone").startswith("Gate-") & (F.col("bucket") > at(AS_OF) - F.expr("INTERVAL '1 day'"))
    )


@query
def p10_bands(d):
    rows = rollup.crowd_buckets(d.crowd, BUCKET)
    return rows.groupBy("zone", crowd_f.congestion_band(F.col("avg_density")).alias("band")).agg(
        F.count("*").alias("buckets")
    )


@query
def p11_recommendations(d):
    return wait.wait_forecasts(d.queues).select("tie", "stand_id", "recommendation")


@query
def p12_sensor_alerts(d):
    return alerts.sensor_alerts(d.queues, d.crowd, d.cctv).drop("severity")


@query
def p13_critical_alerts(d):
    found = alerts.critical_crowd_alerts(flow.forecast_history(d.crowd))
    return found.select("time", "severity", "category", "zone", "message")


@query
def p14_spike_alerts(d):
    found = alerts.spike_alerts(wait.wait_forecasts(d.queues))
    return found.select("tie", "time", "severity", "category", "stand_id", "message")


@query
def p15_blocked(d):
    rows = rollup.crowd_buckets(d.crowd, BUCKET)
    return rows.where(crowd_f.is_blocked(F.col("avg_density"))).select("bucket", "zone", "avg_density")


@query
def p16_avoid_zones(d):
    return flow.forecast_history(d.crowd).select("run", "zone", _joined("avoid_zones").alias("avoid_zones"))


@query
def p17_seat_zones(d):
    seats = d.requests.select("tie", "seat_id", F.lower("seat_id").alias("typed"))
    return seats.select("tie", "seat_id", crowd_f.seat_zone(F.col("typed")).alias("zone"))


@query
def p18_fan_zones(d):
    return orders.with_fan_zone(d.requests.select("tie", "seat_id"), d.order_heads)


@query
def p19_wait_answer(d):
    return answers.wait_answer(d.queues)


@query
def p20_order_status(d):
    status = F.when(F.col("tie") % 5 == 0, "lost").when(F.col("tie") % 5 == 1, "cancelled").otherwise("placed")
    return d.requests.select("tie", messages.valid_status(status).alias("valid"))


# --- joins --------------------------------------------------------------------


def _heat(d: Data) -> DataFrame:
    """The heatmap, with one zone's state withheld to show a stand-only zone."""
    zones = twin.zones(d.crowd, d.ble, d.cctv).where("zone <> 'Concourse-B'")
    return heatmap.heatmap(zones, twin.stands(d.queues))


def _flat_heat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "zone", "density", "headcount", "flow_rate", "congestion_level", "anomaly_active", "last_updated",
        "stand_only", "is_critical", _joined(F.transform("stands", lambda s: s["stand_id"])).alias("stands"),
    )


@query
def j1_heatmap_zones(d):
    return _flat_heat(_heat(d))


@query
def j1_venue_heatmap(d):
    return _flat_heat(answers.venue_heatmap(d.crowd, d.queues, d.ble, d.cctv))


@query
def j1_heatmap_stands(d):
    return heatmap.stand_rows(heatmap.heatmap(latest.zone_state(d.crowd).withColumn("anomaly_active", F.lit(False)), twin.stands(d.queues)))


@query
def j2_gate_density(d):
    return answers.gate_densities(d.crowd, BUCKET, "30 minutes")


def stands_per_tick(d: Data) -> DataFrame:
    forecasts = wait.wait_forecasts(d.queues)
    state = latest.state_per_tick(d.queues, "stand_id", ["stand_name", "zone", "queue_length", "wait_minutes", "is_open"], TICK)
    expected = latest.state_per_tick(forecasts, "stand_id", twin.STAND_FORECAST, TICK)
    return state.join(expected, ["stand_id", "tick"], "left")


def _nearby_requests(d: Data) -> DataFrame:
    return d.requests.select("tie", "seat_id", F.window("placed_at", TICK)["end"].alias("tick"))


def _tick_densities(d: Data) -> DataFrame:
    return routes.snapshot_densities(d.crowd, TICK).withColumn(
        "tick", F.col("snapshot") + F.expr(f"INTERVAL '{TICK}'")
    )


@query
def j3_nearby(d):
    found = orders.nearby_stands(_nearby_requests(d), stands_per_tick(d), _tick_densities(d), 3, d.order_heads)
    return found.withColumn("path", _joined("path", " > "))


@query
def j4_order_checks(d):
    return orders.checked(d.requests).select("tie", "stand_id", "stand_name", _joined("reasons", "; ").alias("reasons"))


@query
def j5_state_at_order(d):
    known = d.requests.where("stand_id <> 'ZZ99'").select("placed_at", "tie", "seat_id", "stand_id")
    history = wait.wait_forecasts(d.queues)
    found = orders.with_state_at(known, history, ["queue_length", "predicted_wait_5min", "is_open"])
    return found.select(*known.columns, "state.*")


@query
def j6_exit_plans(d):
    rows = answers.exit_plans(d.crowd, TICK, "3 hours", 15.0)
    return rows.withColumn("blocked", _joined("blocked"))


@query
def j7_open_gates(d):
    """Gates left to every seating zone."""
    gates = answers.gate_densities(d.crowd, TICK, "3 hours")
    blocked = egress.blocked_gates(gates, ["plan_time"])
    own = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.array(*[F.lit(g) for g in gs]).alias("own")) for z, gs in venue.SEATING_GATES]))
    rows = blocked.select("plan_time", "blocked", own.alias("s")).select("plan_time", "blocked", "s.*")
    gate, rerouted = egress.choose_gate(F.col("own"), F.col("blocked"))
    return rows.select("plan_time", "zone", _joined(F.array_except("own", "blocked")).alias("open_gates"), gate.alias("gate"), rerouted.alias("rerouted"))


@query
def j8_alert_zones(d):
    """Zones of alerts that name a stand, typed in lower case or unknown."""
    named = d.queues.select("tie", F.when(F.col("tie") % 6 == 0, "x1").otherwise(F.lower("stand_id")).alias("stand_id"))
    return alerts.with_stand_zone(named)


@query
def j9_zones_with_bands(d):
    return twin.zones(d.crowd)


@query
def j9_stands_with_forecasts(d):
    return twin.stands(d.queues)


@query
def j10_zone_sensors(d):
    return latest.with_sensor_state(latest.zone_state(d.crowd), latest.zone_sensor_state(d.ble, d.cctv))


@query
def j11_weighted_edges(d):
    rows = d.crowd.select(F.window("time", TICK)["start"].alias("snapshot"), "zone", "density")
    return routes.weighted_edges(rollup.zone_means(rows, ["snapshot"]), ["snapshot"])


# --- aggregations ---------------------------------------------------------------


@query
def a1_crowd_buckets(d):
    return rollup.crowd_buckets(d.crowd, BUCKET)


@query
def a2_queue_buckets(d):
    return rollup.queue_buckets(d.queues, BUCKET)


@query
def a3_zone_means(d):
    rows = d.crowd.withColumn("snapshot", F.window("time", TICK)["start"])
    return rollup.zone_means(rows, ["snapshot"])


@query
def a4_venue_density(d):
    rows = d.crowd.withColumn("snapshot", F.window("time", TICK)["start"])
    last = latest.latest_per_key(rows, ["snapshot", "sensor_id"], ["density"])
    return snapshot.venue_density(last, ["snapshot"])


@query
def a5_attendance(d):
    rows = d.ble.withColumn("snapshot", F.window("time", TICK)["start"])
    return snapshot.attendance(latest.latest_per_key(rows, ["snapshot", "beacon_id"], ["active_devices"]), ["snapshot"])


@query
def a6_unresolved_critical(d):
    return alerts.unresolved_critical(d.alerts)


@query
def a7_heatmap_totals(d):
    zones = latest.zone_state(d.crowd).withColumn("anomaly_active", F.lit(False))
    found = heatmap.totals(heatmap.heatmap(zones, twin.stands(d.queues)))
    return found.withColumn("critical_zones", _joined("critical_zones"))


@query
def a8_order_totals(d):
    return d.orders.select("order_id", orders.order_total(F.col("items")).alias("total_price"))


@query
def a9_orders_per_seat(d):
    return d.order_heads.groupBy("seat_id").agg(F.count("*").alias("total"))


@query
def a10_alert_totals(d):
    return alerts.alert_totals(answers.live_alerts(d.crowd, d.queues, d.cctv))


@query
def a11_blocked_zones(d):
    snaps = routes.snapshot_densities(d.crowd, TICK)
    return snaps.select("snapshot", _joined(routes.blocked_zones(F.col("densities"))).alias("blocked"))


@query
def a12_latency(d):
    return rollup.latency_report(d.table("events"), "value", ["event_type"])


# --- window functions -------------------------------------------------------------


@query
def w1_arrival_rate(d):
    return wait.arrival_rates(d.queues.select("time", "tie", "stand_id", "queue_length")).select(
        "tie", "stand_id", round_half_up(F.col("arrival_rate"), 6).alias("arrival_rate")
    )


@query
def w2_spikes(d):
    return wait.arrival_rates(d.queues.select("time", "tie", "stand_id", "queue_length")).where("spike").select(
        "tie", "stand_id", "queue_length"
    )


@query
def w3_buffer_sizes(d):
    """Spikes and first readings for buffers of one, two and five readings."""
    rows = d.queues.select("time", "tie", "stand_id", "queue_length")
    counts = [
        wait.arrival_rates(rows, window=n).agg(
            F.lit(n).alias("window"), F.count_if("spike").alias("spikes"), F.sum(F.floor(F.col("arrival_rate") * 1000 + 0.5)).alias("rate_sum")
        )
        for n in (1, 2, 5)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def w4_latest_bucket(d):
    return rollup.latest_bucket(rollup.crowd_buckets(d.crowd, BUCKET))


@query
def w5_latest_per_sensor(d):
    return latest.latest_per_key(d.crowd, ["sensor_id"], ["time", "tie", "zone", "density"])


@query
def w6_exit_priorities(d):
    return answers.exit_plans(d.crowd, TICK, "3 hours").select("plan_time", "zone", "priority", "departure_offset_minutes")


@query
def w7_smoothed_density(d):
    """Smoothing over hourly zone means."""
    return flow.snapshot_forecasts(d.crowd, TICK).select("snapshot", "zone", "predicted_density")


@query
def w8_run_means(d):
    rows, last = numbered(d.crowd.select("time", "tie", "zone", "density"), ["time", "tie"])
    means = flow.run_zone_means(flow.run_members(rows, last))
    return means.select("run", "zone", round_half_up(F.col("density"), 9).alias("density"), "appeared")


@query
def w9_zone_order(d):
    rows, last = numbered(d.crowd.select("time", "tie", "zone", "density"), ["time", "tie"])
    means = flow.run_zone_means(flow.run_members(rows, last))
    runs = means.groupBy("_block", "run").agg(F.sort_array(F.collect_list(F.struct("appeared", "zone"))).alias("z"))
    return runs.select("run", _joined(F.transform("z", lambda z: z["zone"])).alias("zones"))


# --- sorts and top-k ----------------------------------------------------------------


@query
def t1_shortest_waits(d):
    last = latest.latest_per_key(d.queues, ["stand_id"], ["stand_name", "wait_minutes", "is_open"])
    return latest.shortest_waits(last, 3)


@query
def t2_stands_by_wait(d):
    state = latest.stand_state(d.queues).withColumn("wait_minutes", F.when(F.col("stand_id") != "A7", F.col("wait_minutes")))
    return latest.by_wait(state).select("stand_id", "wait_minutes")


@query
def t3_zones_by_name(d):
    return latest.zone_state(d.crowd).orderBy("zone").select("zone", "density")


@query
def t4_newest_alerts(d):
    return alerts.newest_unresolved(d.alerts, 50)


@query
def t5_newest_orders(d):
    return orders.order_history(d.order_heads, "L5", 20).select("order_id", "placed_at", "stand_id", "status")


@query
def t6_queue_history(d):
    raw = rollup.readings_for_history(d.queues, AS_OF, 1440, BUCKET)
    return rollup.history(rollup.queue_buckets(raw, BUCKET), "stand_id", "b2", AS_OF, 1440)


@query
def t7_ranked_stands(d):
    rows = orders.ranked_stands(stands_per_tick(d), 3)
    return rows.select("tick", _joined(F.transform("nearby", lambda s: s["stand_id"])).alias("stands"))


@query
def t8_stands_in_zone(d):
    state = latest.stand_state(d.queues).withColumn("wait_minutes", F.when(F.col("stand_id") != "A7", F.col("wait_minutes")))
    forecasted = state.withColumns({"predicted_wait_5min": F.lit(None).cast("double"), "halftime_spike_expected": F.lit(False)})
    zones = latest.zone_state(d.crowd).withColumn("anomaly_active", F.lit(False))
    return heatmap.stand_rows(heatmap.heatmap(zones, forecasted)).select("zone", "place", "stand_id", "wait_minutes")


@query
def t9_exit_order(d):
    rows = answers.exit_plans(d.crowd, TICK, "3 hours")
    plan = rows.groupBy("plan_time").agg(F.sort_array(F.collect_list(F.struct("priority", "zone"))).alias("z"))
    return plan.select("plan_time", _joined(F.transform("z", lambda z: z["zone"])).alias("zones"))


@query
def t10_latest_order_zone(d):
    return orders.latest_order_zone(d.order_heads)


# --- set operations -------------------------------------------------------------------


@query
def u1_live_alerts(d):
    return answers.live_alerts(d.crowd, d.queues, d.cctv).select("kind", "source_order", "category", "zone", "stand_id", "message")


@query
def u2_alerts_in_order(d):
    return alerts.sensor_alerts(d.queues, d.crowd, d.cctv).groupBy("source_order", "category").agg(
        F.count("*").alias("n"), F.min("tie").alias("first_tie"), F.max("tie").alias("last_tie")
    )


@query
def u2_alert_list(d):
    """All sensor alerts in the order in which they are shown."""
    rows = alerts.sensor_alerts(d.queues, d.crowd, d.cctv)
    day = F.to_date("time")
    shown = Window.partitionBy(day).orderBy("source_order", "tie", "message")
    return rows.select(day.alias("day"), F.row_number().over(shown).alias("place"), "source_order", "category", "zone", "stand_id", "message")


@query
def u3_display_order(d):
    zones = latest.zone_state(d.crowd).withColumn("anomaly_active", F.lit(False)).where("zone NOT IN ('Concourse-B', 'VIP-Lounge')")
    rows = heatmap.in_display_order(heatmap.heatmap(zones, twin.stands(d.queues)))
    return rows.select("zone", "stand_only", F.size("stands").alias("stands"))


@query
def u4_prediction_messages(d):
    flow_rows = flow.forecast_history(d.crowd).select("run", "zone", "congestion_risk")
    wait_rows = wait.wait_forecasts(d.queues).select("tie", "stand_id")
    sent = messages.predictions_as_messages(flow_rows, wait_rows)
    return sent.groupBy("topic", "key").agg(F.count("*").alias("n"))


# --- scalar functions --------------------------------------------------------------------


@query
def f1_erlang_c(d):
    rates = wait.arrival_rates(d.queues.select("time", "tie", "stand_id", "queue_length"))
    p = queueing.erlang_c(F.col("arrival_rate"), F.col("service_rate"), F.col("tills"))
    return rates.select("tie", round_half_up(p, 9).alias("p_wait"))


@query
def f2_wait_forecasts(d):
    return wait.wait_forecasts(d.queues).select(
        "tie", "time", "stand_id", "stand_name", "queue_length",
        *[round_half_up(F.col(c), 9).alias(c) for c in ("current_wait_min", "predicted_wait_5min", "predicted_wait_10min", "arrival_rate_lambda", "utilization_rho")],
        "service_rate_mu", "server_count", "halftime_spike_expected",
    )


@query
def f6_exit_offsets(d):
    rows = answers.exit_plans(d.crowd, TICK, "3 hours", 30.0)
    return rows.select("plan_time", "zone", "departure_offset_minutes", "congestion_weight", "match_end", "window_start", "window_end")


@query
def f10_text_formats(d):
    return d.crowd.select(
        "tie",
        text.whole_percent(F.col("density")).alias("percent"),
        text.whole_number(F.col("flow_rate")).alias("whole"),
        text.decimals(F.col("flow_rate"), 2).alias("decimals"),
        text.iso_time(F.col("time")).alias("iso"),
    )


@query
def f16_uuids(d):
    digest = F.md5(F.col("tie").cast("string"))
    form = F.col("tie") % 5
    typed = (
        F.when(form == 0, text.uuid_from(F.col("tie")))
        .when(form == 1, F.concat(F.lit("{"), text.uuid_from(F.col("tie")), F.lit("}")))
        .when(form == 2, F.concat(F.lit("urn:uuid:"), F.upper(digest)))
        .when(form == 3, F.substring(digest, 1, 31))
        .otherwise(F.concat(F.lit("x"), F.substring(digest, 2, 31)))
    )
    return d.crowd.select("tie", text.is_uuid(typed).alias("valid"), text.canonical_uuid(typed).alias("canonical"))


@query
def f17_items_json(d):
    sent = d.orders.select("order_id", text.items_to_json(F.col("items")).alias("j"))
    broken = F.when(F.col("order_id").cast("long") % 10 == 0, "no list").otherwise(F.col("j"))
    back = sent.select("order_id", text.items_from_json(broken).alias("items"))
    return back.select("order_id", F.size("items").alias("n"), orders.order_total(F.col("items")).alias("total"))


# --- graph -----------------------------------------------------------------------------------


@query
def g2_all_routes(d):
    rows = routes.all_routes(routes.snapshot_densities(d.crowd, TICK))
    return rows.select("snapshot", "from_zone", "to_zone", "cost", _joined("path", ">").alias("path"))


@query
def g3_routes(d):
    snaps = routes.snapshot_densities(d.crowd, BUCKET)
    rows = routes.routes(snaps.withColumns({"from_zone": F.lit("Parking-P1"), "to_zone": F.lit("Lower-Stands")}))
    return rows.withColumns({"path": _joined("path", ">"), "avoided_zones": _joined("avoided_zones")})


@query
def g3_best_routes(d):
    """Routes now, from wherever a seat's stand is to the seat."""
    asked = d.requests.join(F.broadcast(venue.stands(d.spark).select("stand_id", F.col("zone").alias("from_zone"))), "stand_id")
    asked = asked.select("tie", "from_zone", crowd_f.seat_zone(F.col("seat_id")).alias("to_zone"))
    rows = answers.best_routes(asked, d.crowd, AS_OF)
    return rows.withColumns({"path": _joined("path", ">"), "avoided_zones": _joined("avoided_zones")})


@query
def g4_flow_forecasts(d):
    rows = flow.forecast_history(d.crowd).drop("smoothed")
    return rows.withColumn("avoid_zones", _joined("avoid_zones"))


@query
def g4_flow_answer(d):
    return answers.flow_answer(d.crowd).withColumn("avoid_zones", _joined("avoid_zones"))


@query
def g5_hops_of_readings(d):
    """Hops to a gate for every zone that has readings."""
    seen = d.crowd.groupBy("zone").agg(F.count("*").alias("readings"))
    return seen.join(F.broadcast(egress.gate_hops(d.spark)), "zone")


@query
def g6_gate_choice(d):
    return answers.exit_plans(d.crowd, BUCKET, "30 minutes").select("plan_time", "zone", "recommended_gate", "gate_was_rerouted", "note")


@query
def g7_walks(d):
    accepted, _ = placed(d)
    return accepted.select("tie", "seat_id", "stand_id", "zone", "walk_minutes")


# --- routing, orders and alerts as batches --------------------


@query
def r7_rooms(d):
    """Audiences of alert and prediction messages."""
    tie = F.col("tie")
    seat = F.when(tie % 5 == 0, F.concat(F.lit("D-"), tie.cast("string")))
    zone = F.when(tie % 5 == 1, F.col("zone")).when(tie % 5 == 2, F.lit(""))
    stand = F.when(tie % 5 == 2, F.lower("stand_id")).when(tie % 5 == 3, F.lit("X1"))
    body = F.struct(
        F.lit("warning").alias("severity"), F.lit("queue").alias("category"), F.lit("m").alias("message"),
        F.when(tie % 7 != 0, text.iso_time(F.col("time"))).alias("timestamp"),
        seat.alias("seat_id"), zone.alias("zone"), stand.alias("stand_id"),
    )
    key = F.when(tie % 3 == 0, F.concat(F.lit("flow:"), "zone")).when(tie % 3 == 1, F.concat(F.lit("wait:"), "stand_id")).otherwise("other")
    sent = d.queues.select("tie", F.lit(venue.ALERTS_TOPIC).alias("topic"), F.col("stand_id").alias("key"), F.to_json(body).alias("value"))
    sent = sent.unionByName(
        d.queues.select("tie", F.lit(venue.INTELLIGENCE_TOPIC).alias("topic"), key.alias("key"), F.lit("{}").alias("value"))
    )
    return alerts.route_messages(sent).select("tie", "topic", "key", "room", "type", "valid")


@query
def r8_envelopes(d):
    """Forecast messages keep their fields and are marked valid; flow messages never are."""
    wait_rows = wait.wait_forecasts(d.queues).select(
        "tie", "stand_id", "stand_name", "predicted_wait_5min", "predicted_wait_10min",
        "halftime_spike_expected", "recommendation", text.iso_time(F.col("time")).alias("generated_at"),
    )
    flow_rows = flow.forecast_history(d.crowd).withColumn("generated_at", text.iso_time(F.col("time"))).drop("time", "smoothed")
    rooms = alerts.route_messages(messages.predictions_as_messages(flow_rows, wait_rows))
    return rooms.groupBy("room", "type", "valid").agg(F.count("*").alias("n"))


@query
def r9_alert_emission(d):
    """Every critical run and every spike raises an alert, without suppression."""
    both = alerts.union([
        alerts.critical_crowd_alerts(flow.forecast_history(d.crowd)),
        alerts.spike_alerts(wait.wait_forecasts(d.queues)),
    ])
    return both.groupBy("category", "zone", "stand_id").agg(F.count("*").alias("n"))


@query
def r9_alerts(d):
    """The alerts of every critical run and every spike, with their texts."""
    both = alerts.union([
        alerts.critical_crowd_alerts(flow.forecast_history(d.crowd)),
        alerts.spike_alerts(wait.wait_forecasts(d.queues)),
    ])
    return both.select("time", "severity", "category", "zone", "stand_id", "message")


@query
def r8_routed_forecasts(d):
    """Where every wait forecast goes, with the payload its receivers see."""
    rows = wait.wait_forecasts(d.queues).select(
        "tie", "stand_id", "stand_name", "predicted_wait_5min", "predicted_wait_10min",
        "halftime_spike_expected", "recommendation", text.iso_time(F.col("time")).alias("generated_at"),
    )
    told = alerts.route_messages(messages.predictions_as_messages(None, rows))
    seen = told.select("room", "type", "valid", "key", F.try_parse_json("value").alias("p"))
    fields = [("tie", "bigint"), ("predicted_wait_5min", "double"), ("halftime_spike_expected", "boolean"), ("recommendation", "string"), ("generated_at", "string")]
    return seen.select("room", "type", "valid", "key", *[F.try_variant_get("p", f"$.{n}", t).alias(n) for n, t in fields])


@query
def r11_orders(d):
    accepted, _ = placed(d)
    return accepted.select(
        "tie", "placed_at", "seat_id", "stand_id", "zone", "queue_wait_minutes", "walk_minutes",
        "delivery_eta_minutes", "delivery_eta_timestamp", "total_price", "status",
    )


@query
def r11_rejected_orders(d):
    _, rejected = placed(d)
    return rejected.select("tie", "stand_id", _joined("reasons", "; ").alias("reasons"))


def _resolutions(d: Data) -> DataFrame:
    """Alerts asked to be resolved: known, unknown and malformed ids."""
    key = F.col("tie")
    return d.crowd.where("density > 0.85").select(
        "tie",
        F.when(key % 4 == 0, "not-an-id")
        .when(key % 4 == 1, text.uuid_from(F.lit(9), key))
        .otherwise(F.concat(F.lit("{"), F.upper(text.uuid_from(F.lit(2), key)), F.lit("}")))
        .alias("alert_id"),
    )


@query
def r12_resolved_alerts(d):
    updated, _ = alerts.resolve(d.alerts, _resolutions(d), "tie")
    return updated.groupBy("category", "severity", "resolved").agg(F.count("*").alias("n"))


@query
def r12_outcomes(d):
    _, outcomes = alerts.resolve(d.alerts, _resolutions(d), "tie")
    return outcomes.select("tie", "outcome")


# --- streams ------------------------------------------------------------------------------------


def _streamed(d: Data, job, readings: DataFrame, late_first: bool = False, arrival: str = "tie"):
    """``job`` after two batches of JSON messages, one for each half of the history.

    The stream runs when a half is written, and again for the other; each half is as many
    files as its readings have partitions. ``arrival``: SQL of the order inside a batch.
    """
    path = scratch_path(d.spark, "messages")
    middle = at(datetime(2024, 1, 16))
    fields = [c for c in readings.columns if c not in ("time", "tie")]
    key = "stand_id" if "stand_id" in readings.columns else "zone"
    stamped = readings.withColumn("timestamp", text.iso_time(F.col("time")))
    halves = [F.col("time") < middle, F.col("time") >= middle]
    for half in reversed(halves) if late_first else halves:
        stamped.where(half).select(
            F.col(key).alias("key"),
            F.to_json(F.struct("timestamp", *fields)).alias("value"),
            "tie",
            F.expr(arrival).alias("arrival"),
        ).write.mode("append").json(path)
        job.start(messages.message_stream(d.spark, path)).awaitTermination()
    return job


def _crowd_streamed(d: Data) -> reading_streams.CrowdStream:
    return _streamed(d, reading_streams.CrowdStream(d.spark, scratch_path(d.spark, "crowd")), d.crowd)


def _queues_streamed(d: Data) -> reading_streams.QueueStream:
    return _streamed(d, reading_streams.QueueStream(d.spark, scratch_path(d.spark, "queues")), d.queues)


@query
def r1_crowd_stream(d):
    """Flow forecasts of the crowd stream, over several batches."""
    job = _crowd_streamed(d)
    rows = tables.read_table(d.spark, f"{job.root}/flow_predictions").drop("date")
    return rows.withColumn("avoid_zones", _joined("avoid_zones"))


@query
def r1_stream_zones(d):
    """Live zone state after the crowd stream."""
    return _crowd_streamed(d).zones.read(1).drop("position")


def _halves(d: Data, run) -> None:
    """``run`` with a stream of events, when their first half is there and again with the second."""
    events, path = d.table("events"), scratch_path(d.spark, "events")
    middle = at(datetime(2024, 1, 16)).cast(events.schema["ts"].dataType)
    for half in (F.col("ts") < middle, F.col("ts") >= middle):
        events.where(half).write.mode("append").parquet(path)
        run(d.spark.readStream.schema(events.schema).parquet(path)).awaitTermination()


@query
def s17_snapshot_stream(d):
    """Snapshots told by timers of the state store, for the ticks that the watermark has passed."""
    job = keyed_streams.SnapshotStream(d.spark, scratch_path(d.spark, "ticks"), TICK)
    kinds = {"crowd": adapters.crowd, "queue": adapters.queues, "ble": adapters.ble, "cctv": adapters.cctv}
    _halves(d, lambda events: job.start({kind: read(events) for kind, read in kinds.items()}))
    return _flat_snapshot(job.snapshots())


@query
def r3_state_store_forecasts(d):
    """Wait forecasts with the last queue lengths of every stand in the state store."""
    path = scratch_path(d.spark, "forecasts")
    _halves(d, lambda events: keyed_streams.start_forecasts(adapters.queues(events), path))
    return d.spark.read.parquet(f"{path}/wait_predictions").select(
        "tie", "time", "stand_id", "queue_length", "predicted_wait_5min", "predicted_wait_10min",
        "arrival_rate_lambda", "halftime_spike_expected", "recommendation",
    )


@query
def r2_queue_stream(d):
    """Wait forecasts of the queue stream, over several batches."""
    job = _queues_streamed(d)
    return tables.read_table(d.spark, f"{job.root}/wait_predictions").select(
        "tie", "time", "stand_id", "queue_length", "predicted_wait_5min", "predicted_wait_10min",
        "arrival_rate_lambda", "halftime_spike_expected", "recommendation",
    )


@query
def r3_stream_stands(d):
    """Live stand state after the queue stream."""
    return _queues_streamed(d).stands.read(1).drop("tie")


def _delivered(d: Data, job, readings: DataFrame):
    """``job`` after four batches of Kafka-shaped rows of two source partitions.

    The first has the first third of all readings, each sent twice; the second starts again in the middle
    of the first; a tenth of the readings is lost before the third; the fourth is the third again.
    """
    path = scratch_path(d.spark, "kafka")
    n = d.table("events").agg(F.max("event_id").alias("n")).first()["n"] or 0
    third, lost, on = n // 3, n // 2, n // 2 + n // 10
    fields = [c for c in readings.columns if c not in ("time", "tie")]
    topic = venue.QUEUE_TOPIC if "stand_id" in readings.columns else venue.CROWD_TOPIC
    rows = readings.withColumn("timestamp", text.iso_time(F.col("time"))).select(
        F.lit(topic).alias("topic"),
        F.lit("k").cast("binary").alias("key"),
        F.to_json(F.struct("timestamp", *fields)).cast("binary").alias("value"),
        (F.col("tie") % 2).cast("int").alias("partition"),
        F.floor(F.col("tie") / 2).alias("offset"),
        F.col("time").alias("timestamp"),
        "tie",
    )
    between = lambda a, b: rows.where((F.col("tie") >= a) & (F.col("tie") <= b)).drop("tie")
    last = between(on, n)
    for batch in (between(0, third).unionAll(between(0, third)), between(third // 2, lost), last, last):
        batch.write.mode("append").parquet(path)
        stream = messages.kafka_rows(d.spark.readStream.schema(batch.schema).parquet(path))
        job.start(stream).awaitTermination()
    return job


@query
def r10_queue_deliveries(d):
    """Forecasts of the queue stream when messages are repeated, replayed and lost."""
    job = _delivered(d, reading_streams.QueueStream(d.spark, scratch_path(d.spark, "queues"), offsets=True), d.queues)
    return tables.read_table(d.spark, f"{job.root}/wait_predictions").select(
        "time", "stand_id", "queue_length", "predicted_wait_5min", "predicted_wait_10min",
        "arrival_rate_lambda", "halftime_spike_expected", "recommendation",
    )


@query
def r10_delivered_stands(d):
    """Live stand state when messages are repeated, replayed and lost: one row per stand."""
    job = _delivered(d, reading_streams.QueueStream(d.spark, scratch_path(d.spark, "queues"), offsets=True), d.queues)
    return job.stands.read(3).drop("tie")


@query
def r10_crowd_deliveries(d):
    """Flow forecasts of the crowd stream when messages are repeated, replayed and lost."""
    job = _delivered(d, reading_streams.CrowdStream(d.spark, scratch_path(d.spark, "crowd"), offsets=True), d.crowd)
    rows = tables.read_table(d.spark, f"{job.root}/flow_predictions").drop("date")
    return rows.withColumn("avoid_zones", _joined("avoid_zones"))


@query
def r10_offsets(d):
    """What the ledger says of every batch and source partition: taken and missing messages."""
    job = _delivered(d, reading_streams.QueueStream(d.spark, scratch_path(d.spark, "queues"), offsets=True), d.queues)
    return job.ledger.deliveries()


def _events_stream(d: Data) -> DataFrame:
    reader = d.spark.readStream.schema(d.table("events").schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(d.sf_dir)


@query
def r5_stream_buckets(d):
    """Closed buckets of the crowd stream: those the watermark has passed."""
    path = scratch_path(d.spark, "buckets")
    stream = bucket_streams.crowd_bucket_stream(adapters.crowd(_events_stream(d)), BUCKET)
    bucket_streams.start(stream, path, f"{path}_checkpoint", {"availableNow": True}).awaitTermination()
    return d.spark.read.parquet(path)


@query
def r5_stream_queue_buckets(d):
    path = scratch_path(d.spark, "buckets")
    stream = bucket_streams.queue_bucket_stream(adapters.queues(_events_stream(d)), BUCKET)
    bucket_streams.start(stream, path, f"{path}_checkpoint", {"availableNow": True}).awaitTermination()
    return d.spark.read.parquet(path)


def _refreshed(d: Data, read, buckets) -> refresh_streams.RefreshedBuckets:
    """One-minute buckets of readings that are received up to twenty minutes after they were taken, in two batches by receipt."""
    delay = F.make_dt_interval(mins=(F.col("tie") % 21).cast("int"))
    rows = read(d.table("events")).withColumn("received", F.col("time") + delay)
    path, middle = scratch_path(d.spark, "received"), at(datetime(2024, 1, 16, 0, 0, 30))
    job = refresh_streams.RefreshedBuckets(d.spark, scratch_path(d.spark, "refreshed"), buckets)
    for half in (F.col("received") < middle, F.col("received") >= middle):
        rows.where(half).write.mode("append").parquet(path)
        job.start(d.spark.readStream.schema(rows.schema).parquet(path), {"availableNow": True}).awaitTermination()
    return job


@query
def r5_refreshed_minutes(d):
    """One-minute crowd buckets as the refresh policy leaves them: without the newest minute, and without late readings."""
    return _refreshed(d, adapters.crowd, rollup.crowd_buckets).table()


@query
def r5_refreshed_queue_minutes(d):
    return _refreshed(d, adapters.queues, rollup.queue_buckets).table()


@query
def r6_too_late_to_refresh(d):
    """Readings that came after the last refresh of their bucket."""
    return _refreshed(d, adapters.queues, rollup.queue_buckets).late().select("tie", "time", "received", "stand_id")


@query
def r6_late_readings(d):
    """The second half of the history first, then the first half, and inside a batch the newest
    reading first: all raw rows are kept, and by arrival the state is the oldest reading."""
    job = reading_streams.QueueStream(d.spark, scratch_path(d.spark, "queues"), reading_streams.ARRIVAL)
    _streamed(d, job, d.queues, late_first=True, arrival="-unix_micros(time) * 1000 - tie % 1000")
    kept = tables.read_table(d.spark, f"{job.root}/queue_readings").groupBy("stand_id").agg(F.count("*").alias("kept"))
    return job.stands.read(1).select("stand_id", "last_updated", "queue_length").join(kept, "stand_id")


@query
def r7_stream_rooms(d):
    """Routing as a stream over forecast messages."""
    path = scratch_path(d.spark, "sent")
    wait_rows = wait.wait_forecasts(d.queues).select("tie", "stand_id", "recommendation")
    messages.predictions_as_messages(None, wait_rows).write.json(path)
    stream = d.spark.readStream.schema("topic string, key string, value string").json(path)
    routing_streams.start(stream, f"{path}_rooms", f"{path}_checkpoint").awaitTermination()
    rooms = d.spark.read.json(f"{path}_rooms")
    return rooms.groupBy("room", "key", "type").agg(F.count("*").alias("n"))


@query
def r11_order_stream(d):
    """Orders placed through the stream."""
    root = scratch_path(d.spark, "orders")
    job = order_streams.OrderStream(
        d.spark,
        root,
        lambda: wait.wait_forecasts(d.queues),
        lambda: routes.snapshot_densities(d.crowd, BUCKET),
        BUCKET,
        lambda: d.order_heads,
    )
    job.start(adapters.order_requests(_events_stream(d))).awaitTermination()
    return tables.read_table(d.spark, f"{root}/fan_orders").select(
        "tie", "placed_at", "seat_id", "stand_id", "zone", "queue_wait_minutes", "walk_minutes",
        "delivery_eta_minutes", "delivery_eta_timestamp", "total_price", "status",
    )


def _joined_orders(d: Data) -> str:
    """Root of the order job over JSON order messages, forecasts and densities, all as streams, after two halves."""
    root = scratch_path(d.spark, "orders")
    zones = order_streams.known_zones(d.order_heads, f"{root}/known_zones")
    forecasts = wait.wait_forecasts(d.queues.limit(0)).schema

    def run(events: DataFrame):
        crowd = bucket_streams.crowd_bucket_stream(adapters.crowd(events), BUCKET)
        bucket_streams.start(crowd, f"{root}/densities", f"{root}/_checkpoint/densities", {"availableNow": True}).awaitTermination()
        keyed_streams.start_forecasts(adapters.queues(events), root).awaitTermination()
        asked = adapters.order_requests(events).withColumn("timestamp", text.iso_time(F.col("placed_at")))
        sent = asked.select("tie", F.to_json(F.struct("timestamp", "seat_id", "stand_id", "items", "special_instructions")).alias("value"))
        job = order_streams.JoinedOrderStream(d.spark, root, f"{root}/densities", BUCKET, zones)
        return job.start(sent, d.spark.readStream.schema(forecasts).parquet(f"{root}/wait_predictions"))

    _halves(d, run)
    return root


@query
def r11_joined_orders(d):
    """Orders of JSON messages joined with the streams of forecasts and densities, of ticks that are over."""
    return tables.read_table(d.spark, f"{_joined_orders(d)}/fan_orders").select(
        "tie", "placed_at", "seat_id", "stand_id", "zone", "queue_wait_minutes", "walk_minutes",
        "delivery_eta_minutes", "delivery_eta_timestamp", "total_price", "status",
    )


@query
def r11_joined_rejections(d):
    """Requests that the joined order stream rejects, of ticks that are over."""
    schema = "placed_at timestamp, tie long, seat_id string, stand_id string, reason string"
    rows = d.spark.read.schema(schema).json(f"{_joined_orders(d)}/rejected")
    return rows.select("tie", "stand_id", F.col("reason").alias("reasons"))
