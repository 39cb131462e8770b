"""SQL per catalog query. Names and columns match the catalog."""

from __future__ import annotations

from gatherline.sources import venue

from .base import (
    band,
    bucket,
    compose,
    compose_with,
    erlang,
    iso,
    mean,
    path_ctes,
    percent,
    rnd,
    route_ctes,
    seat_zone,
    text_list,
    uuid,
    whole,
)

B = "10 minutes"
T = "1 hour"
AS_OF = "TIMESTAMP '2024-01-29 12:00:00'"
DAY_BEFORE = "TIMESTAMP '2024-01-28 12:00:00'"

_SQL: dict[str, str] = {}


def sql(name: str, body: str, *needs: str) -> None:
    _SQL[name] = compose(body, *needs)


def oracle() -> dict[str, str]:
    return dict(_SQL)


# --- sources and sinks
GOOD = "tie % 17 <> 0 AND tie % 19 <> 1 AND tie % 23 <> 2 AND tie % 29 <> 3"
sql("s1_parse_crowd", f"SELECT tie, time, sensor_id, zone, density, headcount, flow_rate, direction FROM crowd WHERE {GOOD}", "crowd")
sql("s2_parse_ble", "SELECT tie, time, beacon_id, location_label, zone, active_devices, rssi_avg, dwell_time_avg FROM ble", "ble")
sql("s2_parse_cctv", "SELECT tie, time, camera_id, zone, headcount_estimate, motion_intensity, anomaly_detected, anomaly_type FROM cctv", "cctv")
sql("s3_timestamps", "SELECT tie, CASE tie % 4 WHEN 0 THEN time WHEN 1 THEN time - INTERVAL '2 hours' WHEN 2 THEN time END AS time FROM crowd", "crowd")
sql(
    "s4_quarantine",
    f"""SELECT tie, CASE WHEN tie % 17 = 0 THEN 'unreadable' ELSE concat_ws('; ',
        CASE WHEN tie % 23 = 2 THEN 'missing zone' END,
        CASE WHEN tie % 19 = 1 THEN 'density outside 0..1' END,
        CASE WHEN tie % 29 = 3 THEN 'bad timestamp' END) END AS reasons FROM crowd WHERE NOT ({GOOD})""",
    "crowd",
)
sql("s5_append_crowd", "SELECT *, CAST(time AS DATE) AS date FROM crowd", "crowd")
sql("s6_append_queue", "SELECT *, CAST(time AS DATE) AS date FROM queue", "queue")
sql(
    "s7_append_wait_predictions",
    """SELECT time, tie, stand_id, stand_name, w5 AS predicted_wait_5min, w10 AS predicted_wait_10min, lam3 AS arrival_rate_lambda,
        mu AS service_rate_mu, c AS server_count, rho3 AS utilization_rho, spike AS halftime_spike_expected FROM forecast""",
    "forecast",
)
sql(
    "s9_append_alerts",
    f"SELECT time, {uuid('source_order', 'tie')} AS alert_id, 'warning' AS severity, category, zone, stand_id, message, false AS resolved FROM sensor_alerts",
    "sensor_alerts",
)
sql("s11_zone_state", "SELECT * FROM zone_state", "zone_state")
sql("s12_stand_state", "SELECT * FROM stand_state", "stand_state")
sql(
    "s13_seeded_stands",
    """SELECT stand_id, stand_name, zone, CASE WHEN h THEN last_updated END AS last_updated, CASE WHEN h THEN queue_length ELSE 0 END AS queue_length,
        CASE WHEN h THEN wait_minutes ELSE 0.0 END AS wait_minutes, CASE WHEN h THEN capacity_pct ELSE 0.0 END AS capacity_pct,
        CASE WHEN h THEN is_open ELSE true END AS is_open FROM (SELECT *, stand_id IN ('C4','B2','A7','B5') AS h FROM stand_state)""",
    "stand_state",
)
sql(
    "s14_publish_predictions",
    "SELECT 'vf_intelligence_out' AS topic, 'wait:' || stand_id AS key, tie, w5 AS predicted_wait_5min, spike AS halftime_spike_expected FROM forecast",
    "forecast",
)
sql(
    "s15_publish_readings",
    f"""SELECT 'vf_crowd_raw' AS topic, zone AS key, sensor_id, {iso('time')} || 'Z' AS timestamp FROM crowd
        UNION ALL SELECT 'vf_queues_raw', stand_id, sensor_id, {iso('time')} || 'Z' FROM queue""",
    "crowd", "queue",
)


def snapshot_sql(ticks: str, upto: str, *needs: str) -> str:
    """``ticks``: SQL of a relation with column tick; ``upto``: comparison of time and tick."""
    def last(kind: str, key: str) -> str:
        return (
            f"SELECT * FROM (SELECT t.tick, r.*, row_number() OVER (PARTITION BY t.tick, r.{key} ORDER BY r.time DESC, r.tie DESC) AS rn "
            f"FROM ticks t JOIN {kind} r ON r.time {upto} t.tick) WHERE rn = 1"
        )

    def asof(kind: str, key: str) -> str:
        return (
            f"SELECT k.tick, r.* FROM (SELECT tick, {key} FROM ticks, (SELECT DISTINCT {key} FROM {kind})) k "
            f"ASOF JOIN {kind} r ON r.{key} = k.{key} AND r.time {upto} k.tick"
        )

    extras = {
        "ticks": ticks,
        "lc": asof("crowd", "sensor_id"),
        "lq": asof("queue", "sensor_id"),
        "lb": asof("ble", "beacon_id"),
        "lv": asof("cctv", "camera_id"),
        "texts": f"""SELECT tick, 1 AS o, CASE WHEN wait_minutes > 15 THEN 'Long queue at ' || stand_name || ' (' || {whole('wait_minutes')} || ' min wait) — consider opening reserve stand'
                ELSE 'Moderate queue at ' || stand_name || ' (' || {whole('wait_minutes')} || ' min wait)' END AS m FROM lq WHERE wait_minutes > 10
            UNION ALL SELECT tick, 2, 'High crowd density in ' || zone || ' (' || {percent('density')} || ') — activate crowd management' FROM lc WHERE density > 0.85
            UNION ALL SELECT tick, 3, 'Anomaly detected by ' || camera_id || ' in ' || zone || ': ' || anomaly_type FROM lv WHERE anomaly_detected""",
    }
    body = f"""SELECT t.tick AS time, coalesce((SELECT CAST(floor(sum(active_devices) / 2) AS BIGINT) FROM lb WHERE lb.tick = t.tick), 0) AS total_attendance,
        {band("coalesce(d.density, 0.0)")} AS venue_congestion_level, d.n AS crowd_sensors,
        (SELECT CAST(count(*) AS INTEGER) FROM lq WHERE lq.tick = t.tick) AS queue_sensors,
        (SELECT CAST(count(*) AS INTEGER) FROM lb WHERE lb.tick = t.tick) AS ble_beacons,
        (SELECT CAST(count(*) AS INTEGER) FROM lv WHERE lv.tick = t.tick) AS cctv_cameras,
        coalesce(x.n, 0) AS alert_count, coalesce(x.alerts, '') AS alerts
        FROM ticks t LEFT JOIN (SELECT tick, {mean('density')} AS density, CAST(count(*) AS INTEGER) AS n FROM lc GROUP BY tick) d ON d.tick = t.tick
        LEFT JOIN (SELECT tick, CAST(count(*) AS INTEGER) AS n, string_agg(m, '|' ORDER BY o, m) AS alerts FROM texts GROUP BY tick) x ON x.tick = t.tick"""
    return compose_with(body, ["crowd", "queue", "ble", "cctv"], extras)


ALL_TICKS = f"SELECT unnest(generate_series((SELECT min({bucket(T)}) FROM crowd) + INTERVAL '{T}', (SELECT max({bucket(T)}) FROM crowd) + INTERVAL '{T}', INTERVAL '{T}')) AS tick"
_SQL["s16_snapshot"] = snapshot_sql(f"SELECT {AS_OF} AS tick", "<=")
_SQL["s17_snapshots"] = snapshot_sql(ALL_TICKS, "<")



def sensor_rows_sql(ticks: str, upto: str) -> str:
    """All listed fields of the last reading of every sensor at every tick."""
    listed = [
        ("crowd", "sensor_id", ["zone", "direction"], ["density", "headcount", "flow_rate"]),
        ("queue", "sensor_id", ["stand_id", "stand_name", "zone", "is_open"], ["queue_length", "wait_minutes", "capacity_pct"]),
        ("ble", "beacon_id", ["location_label", "zone"], ["active_devices", "rssi_avg", "dwell_time_avg"]),
        ("cctv", "camera_id", ["zone", "anomaly_detected", "anomaly_type"], ["headcount_estimate", "motion_intensity", "NULL"]),
    ]
    parts = [
        f"""SELECT k.tick, '{kind}' AS kind, r.{key} AS sensor, r.time, concat_ws('|', {", ".join(f"CAST(r.{t} AS VARCHAR)" for t in texts)}) AS words,
            {", ".join(f"CAST({n} AS DOUBLE) AS value_{i}" for i, n in enumerate(numbers, 1))}
            FROM (SELECT tick, {key} FROM ticks, (SELECT DISTINCT {key} FROM {kind})) k ASOF JOIN {kind} r ON r.{key} = k.{key} AND r.time {upto} k.tick"""
        for kind, key, texts, numbers in listed
    ]
    return compose_with(" UNION ALL ".join(parts), ["crowd", "queue", "ble", "cctv"], {"ticks": ticks})


_SQL["s16_sensor_rows"] = sensor_rows_sql(f"SELECT {AS_OF} AS tick", "<=")
_SQL["s17_sensor_rows"] = sensor_rows_sql(ALL_TICKS, "<")
# A tick is told once the newest reading is more than the lateness past its end.
_SQL["s17_snapshot_stream"] = snapshot_sql(
    f"SELECT tick FROM ({ALL_TICKS}) WHERE tick <= (SELECT date_trunc('milliseconds', max(time)) - INTERVAL '10 minutes' FROM crowd)", "<"
)

# --- projections and filters
sql("p1_zone_readings", "SELECT tie, time, sensor_id, density, headcount FROM crowd WHERE zone = 'Concourse-A'", "crowd")
sql("p2_stand_lookup", "SELECT * FROM stand_state WHERE stand_id = 'C4'", "stand_state")
sql("p3_zone_lookup", "SELECT * FROM zone_state WHERE zone = 'Gate-East'", "zone_state")
sql("p4_anomalies", "SELECT tie, time, camera_id, zone, anomaly_type FROM cctv WHERE anomaly_detected", "cctv")
sql("p5_open_stands", "SELECT tie, stand_id, o AS is_open FROM (SELECT *, CASE WHEN tie % 7 <> 0 THEN is_open END AS o FROM queue) WHERE coalesce(o, true)", "queue")
sql("p6_unresolved_alerts", "SELECT time, alert_id, severity, category, message FROM alerts WHERE NOT resolved", "alerts")
sql(
    "p7_seat_orders",
    """SELECT order_id, placed_at, stand_id, status, CAST(n AS INTEGER) AS item_count FROM heads JOIN totals USING (o_orderkey)
        WHERE seat_id = 'U1' AND status = 'delivered' ORDER BY placed_at DESC, order_id LIMIT 100""",
    "heads", "totals",
)
CROWD_BUCKETS = f"SELECT {bucket(B)} AS bucket, zone, {mean('density')} AS avg_density, max(headcount) AS max_headcount, {mean('flow_rate')} AS avg_flow_rate FROM crowd GROUP BY 1, 2"
QUEUE_BUCKETS = f"SELECT {bucket(B)} AS bucket, stand_id, stand_name, avg(queue_length) AS avg_queue_length, {mean('wait_minutes')} AS avg_wait_minutes, {mean('capacity_pct')} AS avg_capacity_pct FROM queue GROUP BY 1, 2, 3"


def until(buckets: str, table: str) -> str:
    """The same buckets of the readings up to AS_OF."""
    return buckets.replace(f"FROM {table} GROUP", f"FROM {table} WHERE time <= {AS_OF} GROUP")


sql("p8_recent_buckets", f"SELECT * FROM ({until(CROWD_BUCKETS, 'crowd')}) WHERE zone = 'Gate-North' AND bucket > {DAY_BEFORE}", "crowd")
sql("p9_gate_buckets", f"SELECT * FROM ({until(CROWD_BUCKETS, 'crowd')}) WHERE zone LIKE 'Gate-%' AND bucket > {DAY_BEFORE}", "crowd")
sql("p10_bands", f"SELECT zone, {band('avg_density')} AS band, count(*) AS buckets FROM ({CROWD_BUCKETS}) GROUP BY 1, 2", "crowd")
sql("p11_recommendations", "SELECT tie, stand_id, recommendation FROM advice", "advice")
sql("p12_sensor_alerts", "SELECT time, tie, source_order, category, zone, stand_id, message FROM sensor_alerts", "sensor_alerts")
CRITICAL = f"""SELECT t.time, 'critical' AS severity, 'crowd' AS category, zone,
        'CRITICAL congestion in ' || zone || ' (density=' || {percent(rnd('d', 4))} || ') — activate crowd management' AS message
        FROM run_zones JOIN run_times t USING (run) WHERE d >= 0.8"""
sql("p13_critical_alerts", CRITICAL, "run_zones", "run_times")
sql("p14_spike_alerts", "SELECT tie, time, 'warning' AS severity, 'queue' AS category, stand_id, recommendation AS message FROM advice WHERE spike", "advice")
sql("p15_blocked", f"SELECT bucket, zone, avg_density FROM ({CROWD_BUCKETS}) WHERE avg_density >= 0.9", "crowd")
sql("p16_avoid_zones", "SELECT run, zone, avoid_zones FROM avoid", "avoid")
sql("p17_seat_zones", f"SELECT tie, seat_id, {seat_zone('seat_id')} AS zone FROM requests", "requests")
LAST_ORDER = "SELECT seat_id, zone AS ordered_zone FROM (SELECT *, row_number() OVER (PARTITION BY seat_id ORDER BY placed_at DESC, order_id DESC) rn FROM heads) WHERE rn = 1"
sql("p18_fan_zones", f"SELECT tie, r.seat_id, coalesce(ordered_zone, {seat_zone('r.seat_id')}) AS fan_zone FROM requests r LEFT JOIN ({LAST_ORDER}) o ON o.seat_id = r.seat_id", "requests", "heads")
LAST_ADVICE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stand_id ORDER BY time DESC, tie DESC) AS rn FROM advice) WHERE rn = 1"
sql(
    "p19_wait_answer",
    f"""SELECT stand_id, stand_name, w0 AS current_wait_min, w5 AS predicted_wait_5min, w10 AS predicted_wait_10min, lam3 AS arrival_rate_lambda,
        mu AS service_rate_mu, c AS server_count, rho3 AS utilization_rho, spike AS halftime_spike_expected, recommendation FROM ({LAST_ADVICE})""",
    "advice",
)
sql("p20_order_status", "SELECT tie, tie % 5 <> 0 AS valid FROM requests", "requests")

# --- joins
BANDED = f"""SELECT s.zone, s.last_updated, s.density, s.headcount, s.flow_rate, s.direction,
        CASE WHEN r.run * 5 >= s.i THEN {band('r.d')} ELSE {band('s.density')} END AS congestion_level
        FROM (SELECT zone, time AS last_updated, density, headcount, flow_rate, direction, i, row_number() OVER (PARTITION BY zone ORDER BY i DESC) AS rn FROM indexed) s
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY run DESC) AS rn FROM run_zones) r ON r.zone = s.zone AND r.rn = 1 WHERE s.rn = 1"""
SENSORS = """SELECT zone, CAST(sum(v) AS INTEGER) AS ble_active_devices FROM (SELECT zone, beacon_id, arg_max(active_devices, (time, tie)) AS v FROM ble GROUP BY 1, 2) GROUP BY 1"""
CAMERAS = """SELECT zone, CAST(sum(h) AS INTEGER) AS cctv_headcount, bool_or(a) AS anomaly_active FROM
        (SELECT zone, camera_id, arg_max(headcount_estimate, (time, tie)) AS h, arg_max(anomaly_detected, (time, tie)) AS a FROM cctv GROUP BY 1, 2) GROUP BY 1"""
STANDS = f"SELECT s.*, f.w5, f.w10, coalesce(f.spike, false) AS spike FROM stand_state s LEFT JOIN ({LAST_ADVICE}) f ON f.stand_id = s.stand_id"
NESTED = "SELECT zone, string_agg(stand_id, ',' ORDER BY wait_minutes IS NULL, wait_minutes, stand_id) AS stands, count(*) AS n FROM stand_state GROUP BY zone"


def heat_sql(zones: str) -> str:
    return f"""SELECT coalesce(z.zone, s.zone) AS zone, {rnd('density', 4)} AS density, headcount, {rnd('flow_rate', 2)} AS flow_rate, congestion_level,
        coalesce(c.anomaly_active, false) AND z.zone IS NOT NULL AS anomaly_active, {iso('last_updated')} AS last_updated,
        z.zone IS NULL AS stand_only, coalesce(density >= 0.9, false) AS is_critical, coalesce(stands, '') AS stands
        FROM ({zones}) z FULL JOIN ({NESTED}) s ON s.zone = z.zone LEFT JOIN ({CAMERAS}) c ON c.zone = z.zone"""


HEAT_NEEDS = ["indexed", "run_zones", "stand_state", "cctv"]
sql("j1_heatmap_zones", heat_sql(f"SELECT * FROM ({BANDED}) WHERE zone <> 'Concourse-B'"), *HEAT_NEEDS)
sql("j1_venue_heatmap", heat_sql(BANDED), *HEAT_NEEDS)
PLACE = "row_number() OVER (PARTITION BY zone ORDER BY wait_minutes IS NULL, wait_minutes, stand_id) - 1"
sql(
    "j1_heatmap_stands",
    f"""SELECT zone, CAST({PLACE} AS INTEGER) AS place, stand_id, stand_name, queue_length, {rnd('wait_minutes', 2)} AS wait_minutes,
        {rnd('capacity_pct', 2)} AS capacity_pct, {rnd('w5', 2)} AS predicted_wait_5min, is_open, spike AS halftime_spike_expected FROM ({STANDS})""",
    "stand_state", "advice",
)


def state_at_ticks(tick: str, relation: str, key: str, columns: str) -> str:
    """State of every key before the end of every tick, from its first tick on."""
    return f"""SELECT k.tick, r.{key}, {columns} FROM (SELECT tick, {key} FROM (SELECT unnest(generate_series(
            (SELECT min({bucket(tick)}) FROM {relation}) + INTERVAL '{tick}', (SELECT max({bucket(tick)}) FROM {relation}) + INTERVAL '{tick}', INTERVAL '{tick}')) AS tick),
            (SELECT DISTINCT {key} FROM {relation})) k ASOF JOIN {relation} r ON r.{key} = k.{key} AND r.time < k.tick"""


def gate_sql(tick: str, within: str) -> str:
    buckets = f"SELECT {bucket(tick)} AS bucket, zone, {mean('density')} AS avg_density, max(headcount) AS max_headcount, {mean('flow_rate')} AS avg_flow_rate FROM crowd GROUP BY 1, 2"
    return f"""SELECT coalesce(s.tick, b.tick) AS plan_time, coalesce(s.zone, b.zone) AS gate, greatest(coalesce(b.avg_density, 0.0), coalesce(s.density, 0.0)) AS avg_density,
        coalesce(b.avg_flow_rate, 0.0) AS avg_flow_rate, coalesce(b.max_headcount, 0) AS max_headcount
        FROM (SELECT * FROM ({state_at_ticks(tick, 'crowd', 'zone', 'r.density')}) WHERE zone LIKE 'Gate-%') s
        LEFT JOIN (SELECT * FROM (SELECT t.tick, x.*, row_number() OVER (PARTITION BY t.tick, x.zone ORDER BY x.bucket DESC) AS rn
            FROM (SELECT DISTINCT tick FROM ({state_at_ticks(tick, 'crowd', 'zone', 'r.density')})) t
            JOIN ({buckets}) x ON x.bucket > t.tick - INTERVAL '{within}' AND x.bucket <= t.tick - INTERVAL '{tick}' WHERE x.zone LIKE 'Gate-%') WHERE rn = 1) b
        ON b.tick = s.tick AND b.zone = s.zone"""


sql("j2_gate_density", gate_sql(B, "30 minutes"), "crowd")

HOPS = "CASE WHEN zone LIKE 'Gate-%' THEN 0 WHEN zone IN ('Lower-Stands', 'Upper-Stands') THEN 2 ELSE 1 END"


def exit_sql(tick: str, within: str, minutes: float) -> str:
    """All columns of exit plans."""
    gates = text_list(venue.GATES_BY_PRIORITY)
    micros = lambda m: f"to_microseconds(CAST(floor(({m}) * 60e6 + 0.5) AS BIGINT))"
    return f"""SELECT plan_time, plan_time + {micros(minutes)} AS match_end,
        CAST(row_number() OVER (PARTITION BY plan_time ORDER BY {rnd('o', 2)}, seat_order) AS INTEGER) AS priority, zone, gate AS recommended_gate, rerouted AS gate_was_rerouted,
        {rnd('o', 2)} AS departure_offset_minutes, plan_time + {micros(minutes)} + {micros('o')} AS window_start,
        plan_time + {micros(minutes)} + {micros('o')} + INTERVAL '5 minutes' AS window_end, {rnd('density', 4)} AS zone_density, {rnd('1 + density', 4)} AS congestion_weight,
        array_to_string(blocked, ',') AS blocked, CASE WHEN rerouted THEN 'Primary gate(s) blocked (density ≥ 90%). Rerouted to ' || gate || '.' END AS note, open_gates
        FROM (SELECT *, coalesce(own_open[1], any_open[1], own[1]) AS gate, len(own_open) = 0 AS rerouted, {HOPS} * (1 + density) * 5 AS o, array_to_string(own_open, ',') AS open_gates
        FROM (SELECT p.plan_time, s.seat_order, s.zone, s.own, coalesce(d.density, 0.0::DOUBLE) AS density, coalesce(b.blocked, []) AS blocked,
            list_filter(s.own, lambda g: NOT list_contains(coalesce(b.blocked, []), g)) AS own_open,
            list_filter({gates}, lambda g: NOT list_contains(coalesce(b.blocked, []), g)) AS any_open
            FROM (SELECT DISTINCT tick AS plan_time FROM states) p CROSS JOIN seating s
            LEFT JOIN states d ON d.tick = p.plan_time AND d.zone = s.zone
            LEFT JOIN (SELECT plan_time, list(gate ORDER BY gate) FILTER (WHERE avg_density >= 0.9) AS blocked FROM gates GROUP BY 1) b ON b.plan_time = p.plan_time))"""


def exit_query(tick: str, within: str, minutes: float, columns: str, tail: str = "") -> str:
    extras = {
        "states AS MATERIALIZED": state_at_ticks(tick, "crowd", "zone", "r.density"),
        "gates AS MATERIALIZED": gate_sql(tick, within),
        "plans AS MATERIALIZED": exit_sql(tick, within, minutes),
    }
    return compose_with(f"SELECT {columns} FROM plans {tail}", ["crowd", "seating"], extras)


_SQL["j6_exit_plans"] = exit_query(T, "3 hours", 15.0, "* EXCLUDE (open_gates)")
_SQL["j7_open_gates"] = exit_query(T, "3 hours", 0.0, "plan_time, zone, open_gates, recommended_gate AS gate, gate_was_rerouted AS rerouted", "WHERE plan_time IN (SELECT plan_time FROM gates)")
_SQL["w6_exit_priorities"] = exit_query(T, "3 hours", 0.0, "plan_time, zone, priority, departure_offset_minutes")
_SQL["t9_exit_order"] = exit_query(T, "3 hours", 0.0, "plan_time, string_agg(zone, ',' ORDER BY priority) AS zones", "GROUP BY plan_time")
_SQL["f6_exit_offsets"] = exit_query(T, "3 hours", 30.0, "plan_time, zone, departure_offset_minutes, congestion_weight, match_end, window_start, window_end")
_SQL["g6_gate_choice"] = exit_query(B, "30 minutes", 0.0, "plan_time, zone, recommended_gate, gate_was_rerouted, note")

FAULTS = """CASE WHEN quantity < 1 OR quantity > 20 THEN 'quantity outside 1..20' WHEN d.stand_id IS NULL THEN 'stand not found' ELSE '' END"""
sql("j4_order_checks", f"SELECT tie, r.stand_id, d.stand_name, {FAULTS} AS reasons FROM requests r LEFT JOIN stands_dim d ON d.stand_id = r.stand_id", "requests", "stands_dim")
sql(
    "j5_state_at_order",
    """SELECT r.placed_at, r.tie, r.seat_id, r.stand_id, f.queue_length, f.w5 AS predicted_wait_5min, f.is_open
        FROM (SELECT * FROM requests WHERE stand_id <> 'ZZ99') r ASOF LEFT JOIN forecast f ON f.stand_id = r.stand_id AND r.placed_at >= f.time""",
    "requests", "forecast",
)
sql(
    "j8_alert_zones",
    "SELECT tie, a AS stand_id, d.zone AS stand_zone FROM (SELECT tie, CASE WHEN tie % 6 = 0 THEN 'x1' ELSE lower(stand_id) END AS a FROM queue) LEFT JOIN stands_dim d ON d.stand_id = upper(a)",
    "queue", "stands_dim",
)
sql("j9_zones_with_bands", BANDED, "indexed", "run_zones")
sql(
    "j9_stands_with_forecasts",
    f"SELECT * EXCLUDE (w5, w10, spike), w5 AS predicted_wait_5min, w10 AS predicted_wait_10min, spike AS halftime_spike_expected FROM ({STANDS})",
    "stand_state", "advice",
)
sql(
    "j10_zone_sensors",
    f"""SELECT z.*, b.ble_active_devices, c.cctv_headcount, coalesce(c.anomaly_active, false) AS anomaly_active
        FROM zone_state z LEFT JOIN ({SENSORS}) b ON b.zone = z.zone LEFT JOIN ({CAMERAS}) c ON c.zone = z.zone""",
    "zone_state", "ble", "cctv",
)


def snaps(tick: str) -> dict[str, str]:
    return {
        "snaps AS MATERIALIZED": f"SELECT {bucket(tick)} AS sid, zone, {mean('density')} AS d FROM crowd GROUP BY 1, 2",
    }


_SQL["j11_weighted_edges"] = compose_with(
    "SELECT sid AS snapshot, u AS from_zone, v AS to_zone, w AS seconds FROM rw",
    ["crowd", "edges"],
    snaps(T),
    {"srcs": "SELECT DISTINCT sid, '' AS src FROM snaps"},
    {"rw": route_ctes("r", "snaps", "srcs", 0)["rw AS MATERIALIZED"]},
)

# --- aggregations
sql("a1_crowd_buckets", CROWD_BUCKETS, "crowd")
sql("a2_queue_buckets", QUEUE_BUCKETS, "queue")
sql("a3_zone_means", f"SELECT {bucket(T)} AS snapshot, zone, {mean('density')} AS density FROM crowd GROUP BY 1, 2", "crowd")
sql(
    "a4_venue_density",
    f"""SELECT snapshot, density, {band('density')} AS venue_congestion_level FROM (SELECT snapshot, {mean('v')} AS density FROM
        (SELECT {bucket(T)} AS snapshot, sensor_id, arg_max(density, (time, tie)) AS v FROM crowd GROUP BY 1, 2) GROUP BY 1)""",
    "crowd",
)
sql(
    "a5_attendance",
    f"""SELECT snapshot, CAST(floor(sum(v) / 2) AS BIGINT) AS total_attendance FROM
        (SELECT {bucket(T)} AS snapshot, beacon_id, arg_max(active_devices, (time, tie)) AS v FROM ble GROUP BY 1, 2) GROUP BY 1""",
    "ble",
)
sql("a6_unresolved_critical", "SELECT count(*) FILTER (WHERE severity = 'critical' AND NOT resolved) AS unresolved_critical_alerts FROM alerts", "alerts")
sql(
    "a7_heatmap_totals",
    f"""SELECT count(*) AS total_zones, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_stands,
        coalesce(string_agg(z.zone, ',' ORDER BY z.zone) FILTER (WHERE density >= 0.9), '') AS critical_zones
        FROM zone_state z FULL JOIN ({NESTED}) s ON s.zone = z.zone""",
    "zone_state", "stand_state",
)
sql("a8_order_totals", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, total AS total_price FROM totals", "totals")
sql("a9_orders_per_seat", "SELECT seat_id, count(*) AS total FROM heads GROUP BY 1", "heads")
LIVE = f"""SELECT 'sensor' AS kind, 1 AS source_order, 'queue' AS category, zone, stand_id,
        CASE WHEN wait_minutes > 15 THEN 'Long queue at ' || stand_name || ' (' || {whole('wait_minutes')} || ' min wait) — consider opening reserve stand'
        ELSE 'Moderate queue at ' || stand_name || ' (' || {whole('wait_minutes')} || ' min wait)' END AS message
        FROM (SELECT *, row_number() OVER (PARTITION BY stand_id ORDER BY time DESC, tie DESC) AS rn FROM queue) WHERE rn = 1 AND wait_minutes > 10
        UNION ALL SELECT 'sensor', 2, 'crowd', zone, NULL, 'High crowd density in ' || zone || ' (' || {percent('density')} || ') — activate crowd management'
        FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time DESC, tie DESC) AS rn FROM crowd) WHERE rn = 1 AND density > 0.85
        UNION ALL SELECT 'sensor', 3, 'cctv', zone, NULL, 'Anomaly detected by ' || camera_id || ' in ' || zone || ': ' || anomaly_type
        FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY time DESC, tie DESC) AS rn FROM cctv) WHERE rn = 1 AND anomaly_detected
        UNION ALL SELECT 'intelligence', 5, 'intelligence', NULL, stand_id, recommendation FROM ({LAST_ADVICE}) WHERE spike"""
sql("a10_alert_totals", f"SELECT count(*) FILTER (WHERE kind = 'sensor') AS sensor_alerts, count(*) FILTER (WHERE kind = 'intelligence') AS intelligence_alerts, count(*) AS total FROM ({LIVE})", "queue", "crowd", "cctv", "advice")
sql(
    "a11_blocked_zones",
    f"""SELECT snapshot, coalesce(string_agg(zone, ',' ORDER BY zone) FILTER (WHERE d >= 0.9), '') AS blocked
        FROM (SELECT {bucket(T)} AS snapshot, zone, {mean('density')} AS d FROM crowd GROUP BY 1, 2) GROUP BY 1""",
    "crowd",
)
_SQL["a12_latency"] = "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1"

# --- window functions
sql("w1_arrival_rate", f"SELECT tie, stand_id, {rnd('lam', 6)} AS arrival_rate FROM rates", "rates")
sql("w2_spikes", "SELECT tie, stand_id, queue_length FROM rates WHERE spike", "rates")
sql(
    "w3_buffer_sizes",
    """SELECT 1 AS "window", CAST(0 AS BIGINT) AS spikes, CAST(sum(floor(c * mu * 0.9::DOUBLE * 1000 + 0.5)) AS BIGINT) AS rate_sum FROM rates
        UNION ALL SELECT 2, 0, CAST(sum(floor(lam * 1000 + 0.5)) AS BIGINT) FROM rates
        UNION ALL SELECT 5, count(*) FILTER (WHERE spike), CAST(sum(floor(lam * 1000 + 0.5)) AS BIGINT) FROM rates""",
    "rates",
)
sql("w4_latest_bucket", f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY bucket DESC) AS rn FROM ({CROWD_BUCKETS})) WHERE rn = 1", "crowd")
sql("w5_latest_per_sensor", "SELECT sensor_id, time, tie, zone, density FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time DESC, tie DESC) AS rn FROM crowd) WHERE rn = 1", "crowd")
_SQL["w7_smoothed_density"] = compose_with(
    f"SELECT sid AS snapshot, zone, {rnd('s', 4)} AS predicted_density FROM hourly",
    ["crowd"],
    {
        "steps AS MATERIALIZED": f"SELECT *, row_number() OVER (PARTITION BY zone ORDER BY sid) AS step FROM (SELECT {bucket(T)} AS sid, zone, {mean('density')} AS d FROM crowd GROUP BY 1, 2)",
        "hourly": """SELECT zone, sid, step, 0.3::DOUBLE * d + 0.7::DOUBLE * d AS s FROM steps WHERE step = 1
            UNION ALL SELECT z.zone, z.sid, z.step, 0.3::DOUBLE * z.d + 0.7::DOUBLE * e.s FROM hourly e JOIN steps z ON z.zone = e.zone AND z.step = e.step + 1""",
    },
)
sql("w8_run_means", f"SELECT run, zone, {rnd('d', 9)} AS density, appeared FROM run_zones", "run_zones")
sql("w9_zone_order", "SELECT run, string_agg(zone, ',' ORDER BY appeared) AS zones FROM run_zones GROUP BY run", "run_zones")

# --- sorts and top-k
sql(
    "t1_shortest_waits",
    """SELECT stand_id, stand_name, wait_minutes, is_open FROM (SELECT q.*, d.stand_order, row_number() OVER (PARTITION BY q.stand_id ORDER BY time DESC, tie DESC) AS rn
        FROM queue q JOIN stands_dim d USING (stand_id)) WHERE rn = 1 ORDER BY wait_minutes, stand_order LIMIT 3""",
    "queue", "stands_dim",
)
sql("t2_stands_by_wait", "SELECT stand_id, CASE WHEN stand_id <> 'A7' THEN wait_minutes END AS wait_minutes FROM stand_state", "stand_state")
sql("t3_zones_by_name", "SELECT zone, density FROM zone_state", "zone_state")
sql("t4_newest_alerts", "SELECT * FROM alerts WHERE NOT resolved ORDER BY time DESC, alert_id LIMIT 50", "alerts")
sql("t5_newest_orders", "SELECT order_id, placed_at, stand_id, status FROM heads WHERE seat_id = 'L5' ORDER BY placed_at DESC, order_id LIMIT 20", "heads")
sql("t6_queue_history", f"SELECT * FROM ({until(QUEUE_BUCKETS, 'queue')}) WHERE stand_id = 'B2' AND bucket > {DAY_BEFORE}", "queue")
sql("t8_stands_in_zone", f"SELECT zone, CAST({PLACE} AS INTEGER) AS place, stand_id, {rnd('wait_minutes', 2)} AS wait_minutes FROM (SELECT zone, stand_id, CASE WHEN stand_id <> 'A7' THEN wait_minutes END AS wait_minutes FROM stand_state)", "stand_state")
sql("t10_latest_order_zone", LAST_ORDER, "heads")

STANDS_AT_TICKS = {
    "stand_ticks AS MATERIALIZED": state_at_ticks(T, "forecast", "stand_id", "r.stand_name, r.zone, r.wait_minutes, r.is_open, r.w5, r.spike"),
    "ranked AS MATERIALIZED": "SELECT *, row_number() OVER (PARTITION BY tick ORDER BY wait_minutes, stand_id) AS rank FROM stand_ticks WHERE is_open",
}
_SQL["t7_ranked_stands"] = compose_with("SELECT tick, string_agg(stand_id, ',' ORDER BY rank) AS stands FROM ranked WHERE rank <= 3 GROUP BY tick", ["forecast"], STANDS_AT_TICKS)
_SQL["j3_nearby"] = compose_with(
    f"""SELECT a.tie, a.seat_id, a.tick, a.fan_zone, CAST(k.rank AS INTEGER) AS rank, k.stand_id, k.stand_name, k.zone, {rnd('k.wait_minutes', 2)} AS wait_minutes, {rnd('k.w5', 2)} AS predicted_wait_5min,
        CASE WHEN k.zone = a.fan_zone THEN k.zone WHEN p.cost IS NULL THEN a.fan_zone || ' > ' || k.zone ELSE p.path END AS path,
        CASE WHEN k.zone = a.fan_zone THEN 0.0 WHEN p.cost IS NULL THEN 2.0 ELSE {rnd('p.cost / 60', 1)} END AS estimated_walk_minutes,
        {rnd(f"k.wait_minutes + CASE WHEN k.zone = a.fan_zone THEN 0.0::DOUBLE WHEN p.cost IS NULL THEN 2.0::DOUBLE ELSE {rnd('p.cost / 60', 1)} END", 2)} AS total_eta_minutes,
        k.is_open, k.spike AS halftime_spike_expected
        FROM asked a JOIN ranked k ON k.tick = a.tick AND k.rank <= 3
        LEFT JOIN rpaths p ON p.sid = a.tick AND p.src = a.fan_zone AND p.dst = k.zone""",
    ["forecast", "crowd", "requests", "heads", "edges"],
    STANDS_AT_TICKS,
    {
        "asked AS MATERIALIZED": f"SELECT r.tie, r.seat_id, {bucket(T, 'r.placed_at')} + INTERVAL '{T}' AS tick, coalesce(ordered_zone, {seat_zone('r.seat_id')}) AS fan_zone FROM requests r LEFT JOIN ({LAST_ORDER}) o ON o.seat_id = r.seat_id",
        "snaps AS MATERIALIZED": f"SELECT {bucket(T)} + INTERVAL '{T}' AS sid, zone, {mean('density')} AS d FROM crowd GROUP BY 1, 2",
        "srcs": "SELECT DISTINCT tick AS sid, fan_zone AS src FROM asked",
        "targets": "SELECT DISTINCT a.tick AS sid, a.fan_zone AS src, k.zone AS dst FROM asked a JOIN ranked k ON k.tick = a.tick AND k.rank <= 3",
    },
    route_ctes("r", "snaps", "srcs"),
    path_ctes("r", "targets", " > "),
)

# --- set operations
sql("u1_live_alerts", LIVE, "queue", "crowd", "cctv", "advice")
sql("u2_alerts_in_order", "SELECT source_order, category, count(*) AS n, min(tie) AS first_tie, max(tie) AS last_tie FROM sensor_alerts GROUP BY 1, 2", "sensor_alerts")
sql(
    "u3_display_order",
    f"""SELECT coalesce(z.zone, s.zone) AS zone, z.zone IS NULL AS stand_only, CAST(coalesce(n, 0) AS INTEGER) AS stands
        FROM (SELECT * FROM zone_state WHERE zone NOT IN ('Concourse-B', 'VIP-Lounge')) z FULL JOIN ({NESTED}) s ON s.zone = z.zone""",
    "zone_state", "stand_state",
)
sql(
    "u4_prediction_messages",
    """SELECT 'vf_intelligence_out' AS topic, 'flow:' || zone AS key, count(*) AS n FROM run_zones GROUP BY 2
        UNION ALL SELECT 'vf_intelligence_out', 'wait:' || stand_id, count(*) FROM queue GROUP BY 2""",
    "run_zones", "queue",
)

sql(
    "s14_wait_payloads",
    f"""SELECT 'vf_intelligence_out' AS topic, 'wait:' || stand_id AS key, tie, stand_id, stand_name, queue_length, w0 AS current_wait_min, w5 AS predicted_wait_5min,
        w10 AS predicted_wait_10min, lam3 AS arrival_rate_lambda, rho3 AS utilization_rho, mu AS service_rate_mu, c AS server_count,
        spike AS halftime_spike_expected, recommendation, {iso('time')} AS generated_at FROM advice""",
    "advice",
)
sql(
    "r8_routed_forecasts",
    f"""SELECT 'ops' AS room, 'wait_intelligence' AS type, true AS valid, 'wait:' || stand_id AS key, tie, w5 AS predicted_wait_5min,
        spike AS halftime_spike_expected, recommendation, {iso('time')} AS generated_at FROM advice""",
    "advice",
)
sql(
    "r9_alerts",
    f"""SELECT time, severity, category, zone, CAST(NULL AS VARCHAR) AS stand_id, message FROM ({CRITICAL})
        UNION ALL SELECT time, 'warning', 'queue', NULL, stand_id, recommendation FROM advice WHERE spike""",
    "run_zones", "run_times", "advice",
)
sql(
    "u2_alert_list",
    """SELECT CAST(time AS DATE) AS day, row_number() OVER (PARTITION BY CAST(time AS DATE) ORDER BY source_order, tie, message) AS place,
        source_order, category, zone, stand_id, message FROM sensor_alerts""",
    "sensor_alerts",
)

# --- scalar functions
sql("f1_erlang_c", f"SELECT tie, {rnd(erlang('lam', 'mu', 'c'), 9)} AS p_wait FROM rates", "rates")
sql(
    "f2_wait_forecasts",
    f"""SELECT tie, time, stand_id, stand_name, queue_length, {rnd('w0', 9)} AS current_wait_min, {rnd('w5', 9)} AS predicted_wait_5min, {rnd('w10', 9)} AS predicted_wait_10min,
        {rnd('lam3', 9)} AS arrival_rate_lambda, {rnd('rho3', 9)} AS utilization_rho, mu AS service_rate_mu, c AS server_count, spike AS halftime_spike_expected FROM forecast""",
    "forecast",
)
sql(
    "f10_text_formats",
    f"SELECT tie, {percent('density')} AS percent, {whole('flow_rate')} AS whole, printf('%.2f', {rnd('flow_rate', 2)}) AS decimals, {iso('time')} AS iso FROM crowd",
    "crowd",
)
sql(
    "f16_uuids",
    f"SELECT tie, tie % 5 < 3 AS valid, CASE WHEN tie % 5 < 3 THEN {uuid('tie')} END AS canonical FROM crowd",
    "crowd",
)
sql(
    "f17_items_json",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE n END AS INTEGER) AS n,
        CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE total END AS total FROM totals""",
    "totals",
)

# --- graph
ALL_SOURCES = {"srcs": "SELECT sid, zone AS src FROM (SELECT DISTINCT sid FROM snaps), (SELECT zone FROM zones_dim)"}
_SQL["g2_all_routes"] = compose_with(
    """SELECT t.sid AS snapshot, t.src AS from_zone, t.dst AS to_zone, p.cost, coalesce(p.path, '') AS path
        FROM targets t LEFT JOIN rpaths p ON p.sid = t.sid AND p.src = t.src AND p.dst = t.dst""",
    ["crowd", "edges", "zones_dim"],
    snaps(T),
    ALL_SOURCES,
    {"targets AS MATERIALIZED": "SELECT sid, src, zone AS dst FROM srcs, zones_dim"},
    route_ctes("r", "snaps", "srcs"),
    path_ctes("r", "targets", ">"),
)
ROUTE_COLUMNS = f"coalesce(p.path, '') AS path, {rnd('p.cost', 1)} AS estimated_seconds, {rnd('p.cost / 60', 1)} AS estimated_minutes, p.cost IS NOT NULL AS reachable"
_SQL["g3_routes"] = compose_with(
    f"""SELECT t.sid AS snapshot, t.src AS from_zone, t.dst AS to_zone, {ROUTE_COLUMNS}, coalesce(b.z, '') AS avoided_zones
        FROM targets t LEFT JOIN rpaths p ON p.sid = t.sid
        LEFT JOIN (SELECT sid, string_agg(zone, ',' ORDER BY zone) FILTER (WHERE d >= 0.9 AND zone NOT IN ('Parking-P1', 'Lower-Stands')) AS z FROM snaps GROUP BY sid) b ON b.sid = t.sid""",
    ["crowd", "edges"],
    snaps(B),
    {"srcs": "SELECT DISTINCT sid, 'Parking-P1' AS src FROM snaps", "targets AS MATERIALIZED": "SELECT sid, src, 'Lower-Stands' AS dst FROM srcs"},
    route_ctes("r", "snaps", "srcs"),
    path_ctes("r", "targets", ">"),
)
_SQL["g3_best_routes"] = compose_with(
    f"""SELECT a.tie, a.from_zone, a.to_zone, {ROUTE_COLUMNS},
        coalesce((SELECT string_agg(zone, ',' ORDER BY zone) FROM snaps s WHERE d >= 0.9 AND zone <> a.from_zone AND zone <> a.to_zone), '') AS avoided_zones
        FROM asked a LEFT JOIN rpaths p ON p.src = a.from_zone AND p.dst = a.to_zone""",
    ["crowd", "edges", "requests", "stands_dim"],
    {
        "snaps AS MATERIALIZED": f"""SELECT 1 AS sid, zone, {mean('v')} AS d FROM (SELECT zone, density AS v FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time DESC, tie DESC) AS rn
            FROM crowd WHERE time <= {AS_OF}) WHERE rn = 1) GROUP BY zone""",
        "asked AS MATERIALIZED": f"SELECT r.tie, d.zone AS from_zone, {seat_zone('r.seat_id')} AS to_zone FROM requests r JOIN stands_dim d ON d.stand_id = r.stand_id",
        "srcs": "SELECT DISTINCT 1 AS sid, from_zone AS src FROM asked",
        "targets": "SELECT DISTINCT 1 AS sid, from_zone AS src, to_zone AS dst FROM asked",
    },
    route_ctes("r", "snaps", "srcs"),
    path_ctes("r", "targets", ">"),
)
RUN_ROUTES = [
    {"snaps AS MATERIALIZED": "SELECT run AS sid, zone, d FROM run_zones", "srcs": "SELECT sid, zone AS src FROM snaps", "targets": f"SELECT sid, src, '{venue.MAIN_SEATING}' AS dst FROM srcs"},
    route_ctes("r", "snaps", "srcs"),
    path_ctes("r", "targets", " → "),
]
FLOW = f"""SELECT z.run, t.time, z.zone, {rnd('z.d', 4)} AS current_density, {rnd('m.s', 4)} AS predicted_density, {band('z.d')} AS congestion_risk,
        CASE WHEN z.zone <> '{venue.MAIN_SEATING}' THEN p.path END AS recommended_route, v.avoid_zones
        FROM run_zones z JOIN run_times t USING (run) JOIN smoothed m ON m.run = z.run AND m.zone = z.zone JOIN avoid v ON v.run = z.run AND v.zone = z.zone
        LEFT JOIN rpaths p ON p.sid = z.run AND p.src = z.zone"""
FLOW_NEEDS = ["run_zones", "run_times", "smoothed", "avoid", "edges"]
_SQL["g4_flow_forecasts"] = compose_with(FLOW, FLOW_NEEDS, *RUN_ROUTES)
_SQL["s14_flow_payloads"] = compose_with(
    f"SELECT 'vf_intelligence_out' AS topic, 'flow:' || zone AS key, * EXCLUDE (time) FROM ({FLOW})", FLOW_NEEDS, *RUN_ROUTES
)
_SQL["g4_flow_answer"] = compose_with(f"SELECT * EXCLUDE (run, time) FROM ({FLOW}) WHERE run = (SELECT max(run) FROM run_zones)", FLOW_NEEDS, *RUN_ROUTES)
_SQL["s8_append_flow_predictions"] = compose_with(f"SELECT time, run, zone, predicted_density, recommended_route, congestion_risk, avoid_zones FROM ({FLOW})", FLOW_NEEDS, *RUN_ROUTES)
sql("g5_hops_of_readings", f"SELECT zone, count(*) AS readings, CASE WHEN zone LIKE 'Parking-%' THEN 1 ELSE {HOPS} END AS hops FROM crowd GROUP BY zone", "crowd")

# --- orders
PLACED_NEEDS = ["forecast", "cold", "crowd", "requests", "heads", "stands_dim", "edges"]
PLACED = [
    {
        "taken AS MATERIALIZED": f"""SELECT r.*, d.stand_name, d.zone AS stand_zone, coalesce(o.ordered_zone, {seat_zone('r.seat_id')}) AS zone, coalesce(f.w5, c.w5) AS wait,
            coalesce(f.is_open, true) AS is_open, {bucket(B, 'r.placed_at')} AS sid
            FROM (SELECT * FROM requests WHERE quantity BETWEEN 1 AND 20) r JOIN stands_dim d ON d.stand_id = r.stand_id JOIN cold c ON c.stand_id = r.stand_id
            LEFT JOIN ({LAST_ORDER}) o ON o.seat_id = r.seat_id
            ASOF LEFT JOIN forecast f ON f.stand_id = r.stand_id AND r.placed_at >= f.time""",
    },
    snaps(B),
    {"srcs": "SELECT DISTINCT sid, stand_zone AS src FROM taken WHERE is_open", "targets": "SELECT DISTINCT sid, stand_zone AS src, zone AS dst FROM taken WHERE is_open"},
    route_ctes("r", "snaps", "srcs"),
    {
        "walked AS MATERIALIZED": f"""SELECT t.*, CASE WHEN t.stand_zone = t.zone THEN 0.0::DOUBLE WHEN p.cost IS NULL THEN 2.0::DOUBLE ELSE {rnd('p.cost / 60', 1)} END AS walk
            FROM taken t LEFT JOIN rdist p ON p.sid = t.sid AND p.src = t.stand_zone AND p.node = t.zone WHERE t.is_open""",
        "placed": f"""SELECT *, {rnd('wait', 2)} AS queue_wait_minutes, {rnd('walk', 2)} AS walk_minutes, {rnd('wait + walk + 1.0::DOUBLE', 2)} AS delivery_eta_minutes,
            placed_at + to_microseconds(CAST(floor({rnd('wait + walk + 1.0::DOUBLE', 2)} * 60e6 + 0.5) AS BIGINT)) AS delivery_eta_timestamp,
            {rnd('price * quantity', 2)} AS total_price, 'placed' AS status, {uuid('seat_id', 'stand_id', 'tie')} AS order_id FROM walked""",
    },
]
_SQL["s10_append_orders"] = compose_with("SELECT tie, order_id, seat_id, stand_id, stand_name, zone, status, total_price, placed_at, CAST(placed_at AS DATE) AS date, true AS has_items FROM placed", PLACED_NEEDS, *PLACED)
_SQL["s14_publish_orders"] = compose_with("SELECT 'vf_orders' AS topic, 'order:' || seat_id AS key, tie, total_price, status FROM placed", PLACED_NEEDS, *PLACED)
ORDER_COLUMNS = """order_id, seat_id, stand_id, stand_name, zone, status, queue_wait_minutes, walk_minutes, delivery_eta_minutes, delivery_eta_timestamp,
    placed_at, total_price, CAST(NULL AS VARCHAR) AS special_instructions, placed_at AS updated_at"""
ITEM = "0 AS place, 'Item' AS item_name, quantity AS item_quantity, price AS item_price"
_SQL["s10_stored_orders"] = compose_with(f"SELECT {ORDER_COLUMNS}, {ITEM} FROM placed", PLACED_NEEDS, *PLACED)
_SQL["s14_order_payloads"] = compose_with(
    f"""SELECT 'vf_orders' AS topic, 'order:' || seat_id AS key, tie, order_id, seat_id, stand_id, stand_name, zone, status, queue_wait_minutes, walk_minutes,
        delivery_eta_minutes, {iso('delivery_eta_timestamp')} AS delivery_eta_timestamp, {iso('placed_at')} AS placed_at, total_price, {iso('placed_at')} AS updated_at, {ITEM} FROM placed""",
    PLACED_NEEDS, *PLACED,
)
_SQL["t5_order_history"] = compose_with(
    f"""SELECT * FROM (SELECT row_number() OVER (PARTITION BY seat_id ORDER BY placed_at DESC, order_id) AS place_in_history, {ORDER_COLUMNS}, {ITEM}
        FROM placed) WHERE place_in_history <= 20""",
    PLACED_NEEDS, *PLACED,
)
_SQL["g7_walks"] = compose_with("SELECT tie, seat_id, stand_id, zone, walk_minutes FROM placed", PLACED_NEEDS, *PLACED)
_SQL["r11_orders"] = compose_with("SELECT tie, placed_at, seat_id, stand_id, zone, queue_wait_minutes, walk_minutes, delivery_eta_minutes, delivery_eta_timestamp, total_price, status FROM placed", PLACED_NEEDS, *PLACED)
sql(
    "r11_rejected_orders",
    f"""SELECT tie, stand_id, reasons FROM (SELECT r.tie, r.stand_id, CASE WHEN {FAULTS} <> '' THEN {FAULTS} WHEN NOT coalesce(f.is_open, true) THEN 'stand closed' ELSE '' END AS reasons
        FROM requests r LEFT JOIN stands_dim d ON d.stand_id = r.stand_id ASOF LEFT JOIN forecast f ON f.stand_id = r.stand_id AND r.placed_at >= f.time) WHERE reasons <> ''""",
    "requests", "stands_dim", "forecast",
)

# --- routing and resolution
sql(
    "r7_rooms",
    """SELECT tie, topic, key, unnest(CASE WHEN special IS NULL THEN ['ops'] ELSE [special, 'ops'] END) AS room, type, valid FROM (
        SELECT tie, 'vf_alerts' AS topic, q.stand_id AS key, CASE tie % 5 WHEN 0 THEN 'fan:D-' || CAST(tie AS VARCHAR) WHEN 1 THEN 'zone:' || q.zone WHEN 2 THEN 'zone:' || q.zone END AS special,
            'alert' AS type, tie % 7 <> 0 AS valid FROM queue q
        UNION ALL SELECT tie, 'vf_intelligence_out', CASE tie % 3 WHEN 0 THEN 'flow:' || zone WHEN 1 THEN 'wait:' || stand_id ELSE 'other' END,
            CASE WHEN tie % 3 = 0 THEN 'zone:' || zone END,
            CASE tie % 3 WHEN 0 THEN 'flow_intelligence' WHEN 1 THEN 'wait_intelligence' ELSE 'intelligence' END, false FROM queue)""",
    "queue",
)
sql(
    "r8_envelopes",
    """SELECT room, type, valid, count(*) AS n FROM (
        SELECT unnest(['zone:' || zone, 'ops']) AS room, 'flow_intelligence' AS type, false AS valid FROM run_zones
        UNION ALL SELECT 'ops', 'wait_intelligence', true FROM queue) GROUP BY 1, 2, 3""",
    "run_zones", "queue",
)
sql(
    "r9_alert_emission",
    """SELECT category, zone, stand_id, count(*) AS n FROM (
        SELECT 'crowd' AS category, zone, NULL AS stand_id FROM run_zones WHERE d >= 0.8
        UNION ALL SELECT 'queue', NULL, stand_id FROM rates WHERE spike) GROUP BY 1, 2, 3""",
    "run_zones", "rates",
)
ASKED = f"SELECT tie, CASE WHEN tie % 4 >= 2 THEN {uuid('2', 'tie')} END AS id FROM crowd WHERE density > 0.85"
sql(
    "r12_resolved_alerts",
    f"""SELECT category, severity, resolved OR alert_id IN (SELECT id FROM ({ASKED}) WHERE id IS NOT NULL) AS resolved, count(*) AS n FROM alerts GROUP BY 1, 2, 3""",
    "alerts", "crowd",
)
sql(
    "r12_outcomes",
    f"""SELECT tie, CASE WHEN tie % 4 = 0 THEN 'invalid_id' WHEN nth = 1 AND id IN (SELECT alert_id FROM alerts WHERE NOT resolved) THEN 'resolved' ELSE 'not_found' END AS outcome
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tie) AS nth FROM ({ASKED}))""",
    "alerts", "crowd",
)

# --- streams
_SQL["r1_crowd_stream"] = _SQL["g4_flow_forecasts"]
_SQL["r1_stream_zones"] = _SQL["j9_zones_with_bands"]
sql(
    "r2_queue_stream",
    """SELECT tie, time, stand_id, queue_length, w5 AS predicted_wait_5min, w10 AS predicted_wait_10min, lam3 AS arrival_rate_lambda,
        spike AS halftime_spike_expected, recommendation FROM advice""",
    "advice",
)
_SQL["r3_state_store_forecasts"] = _SQL["r2_queue_stream"]
_SQL["r3_stream_stands"] = _SQL["j9_stands_with_forecasts"]

# Deliveries: a tenth of the readings after the middle never comes.
M = "(SELECT max(event_id) FROM events)"
ARRIVED = f"(SELECT * FROM events WHERE event_id <= {M} // 2 OR event_id >= {M} // 2 + {M} // 10) events"


def _arrived(query: str) -> str:
    return query.replace("FROM events", f"FROM {ARRIVED}")


sql(
    "r10_queue_deliveries",
    """SELECT time, stand_id, queue_length, w5 AS predicted_wait_5min, w10 AS predicted_wait_10min, lam3 AS arrival_rate_lambda,
        spike AS halftime_spike_expected, recommendation FROM advice""",
    "advice",
)
_SQL["r10_queue_deliveries"] = _arrived(_SQL["r10_queue_deliveries"])
_SQL["r10_delivered_stands"] = _arrived(_SQL["r3_stream_stands"])
_SQL["r10_crowd_deliveries"] = _arrived(_SQL["r1_crowd_stream"])
sql(
    "r10_offsets",
    f"""SELECT batch_id, partition, expected_offset, first_offset, last_offset, taken, last_offset + 1 - expected_offset - taken AS missing
        FROM (SELECT *, coalesce(lag(last_offset) OVER (PARTITION BY partition ORDER BY batch_id) + 1, first_offset) AS expected_offset
            FROM (SELECT batch_id, CAST(event_id % 2 AS INTEGER) AS partition, min(event_id // 2) AS first_offset, max(event_id // 2) AS last_offset, count(*) AS taken
                FROM (SELECT CASE WHEN event_id <= {M} // 3 THEN 0 WHEN event_id <= {M} // 2 THEN 1 ELSE 2 END AS batch_id, event_id FROM {ARRIVED})
                GROUP BY 1, 2))""",
)
# A bucket is closed once the newest reading is more than the lateness past its end.
sql("r5_stream_buckets", f"SELECT * FROM ({CROWD_BUCKETS}) WHERE bucket + INTERVAL '{B}' <= (SELECT date_trunc('milliseconds', max(time)) - INTERVAL '10 minutes' FROM crowd)", "crowd")
sql("r5_stream_queue_buckets", f"SELECT * FROM ({QUEUE_BUCKETS}) WHERE bucket + INTERVAL '{B}' <= (SELECT date_trunc('milliseconds', max(time)) - INTERVAL '10 minutes' FROM queue)", "queue")
# Refreshes at whole minutes reach from ten minutes to one minute before them.
RECEIVED = "time + to_minutes(CAST(tie % 21 AS INTEGER))"
TIMELY = f"{RECEIVED} <= {bucket('1 minute')} + INTERVAL '10 minutes'"


def refreshed(kind: str, buckets: str) -> str:
    last = f"(SELECT date_trunc('minute', max({RECEIVED})) FROM {kind})"
    rows_ = f"(SELECT * FROM {kind} WHERE {TIMELY} AND {RECEIVED} <= {last})"
    return compose(
        f"SELECT * FROM ({buckets.replace(bucket(B), bucket('1 minute')).replace(f'FROM {kind}', f'FROM {rows_}')}) WHERE bucket + INTERVAL '2 minutes' <= {last}", kind
    )


_SQL["r5_refreshed_minutes"] = refreshed("crowd", CROWD_BUCKETS)
_SQL["r5_refreshed_queue_minutes"] = refreshed("queue", QUEUE_BUCKETS)
sql("r6_too_late_to_refresh", f"SELECT tie, time, {RECEIVED} AS received, stand_id FROM queue WHERE NOT ({TIMELY})", "queue")
sql(
    "r6_late_readings",
    """SELECT stand_id, last_updated, queue_length, kept FROM (SELECT stand_id, time AS last_updated, queue_length, row_number() OVER (PARTITION BY stand_id ORDER BY time, tie % 1000) AS rn
        FROM queue WHERE time < TIMESTAMP '2024-01-16') JOIN (SELECT stand_id, count(*) AS kept FROM queue GROUP BY 1) USING (stand_id) WHERE rn = 1""",
    "queue",
)
sql("r7_stream_rooms", "SELECT 'ops' AS room, 'wait:' || stand_id AS key, 'wait_intelligence' AS type, count(*) AS n FROM queue GROUP BY stand_id", "queue")
_SQL["r11_order_stream"] = _SQL["r11_orders"]
# An order comes out once the newest reading is more than the lateness past the end of its tick.
OVER = f"{bucket(B, 'placed_at')} + INTERVAL '{B}' <= (SELECT date_trunc('milliseconds', max(time)) - INTERVAL '10 minutes' FROM crowd)"
_SQL["r11_joined_orders"] = compose_with(
    f"SELECT tie, placed_at, seat_id, stand_id, zone, queue_wait_minutes, walk_minutes, delivery_eta_minutes, delivery_eta_timestamp, total_price, status FROM placed WHERE {OVER}",
    PLACED_NEEDS, *PLACED,
)
sql(
    "r11_joined_rejections",
    f"""SELECT tie, stand_id, reasons FROM (SELECT r.tie, r.stand_id, r.placed_at, CASE WHEN {FAULTS} <> '' THEN {FAULTS} WHEN NOT coalesce(f.is_open, true) THEN 'stand closed' ELSE '' END AS reasons
        FROM requests r LEFT JOIN stands_dim d ON d.stand_id = r.stand_id ASOF LEFT JOIN forecast f ON f.stand_id = r.stand_id AND r.placed_at >= f.time) WHERE reasons <> '' AND {OVER}""",
    "requests", "stands_dim", "forecast", "crowd",
)
