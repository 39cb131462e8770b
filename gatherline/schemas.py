"""Schemas of messages and tables.

Messages carry ``timestamp``; tables carry the same value as ``time``.
"""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(fields: str) -> T.StructType:
    """``name type, …`` as a schema, usable before there is a session."""
    named = [f.split() for f in fields.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


CROWD_MESSAGE = _struct(
    "sensor_id string, zone string, timestamp string, density double, "
    "headcount int, flow_rate double, direction string"
)
QUEUE_MESSAGE = _struct(
    "sensor_id string, stand_id string, stand_name string, zone string, timestamp string, "
    "queue_length int, wait_minutes double, capacity_pct double, is_open boolean"
)
BLE_MESSAGE = _struct(
    "beacon_id string, location_label string, zone string, timestamp string, "
    "active_devices int, rssi_avg double, dwell_time_avg double"
)
CCTV_MESSAGE = _struct(
    "camera_id string, zone string, timestamp string, headcount_estimate int, "
    "motion_intensity double, anomaly_detected boolean, anomaly_type string"
)

ITEMS = T.ArrayType(_struct("name string, quantity int, price double"))

ORDER_REQUEST = T.StructType(
    [
        T.StructField("seat_id", T.StringType()),
        T.StructField("stand_id", T.StringType()),
        T.StructField("items", ITEMS),
        T.StructField("special_instructions", T.StringType()),
    ]
)

# Output messages, as their receivers declare them (used for the valid flag).
FLOW_ENVELOPE = _struct(
    "zone string, current_density double, predicted_density double, congestion_risk string, "
    "recommended_route array<string>, avoid_zones array<string>, generated_at string"
)
WAIT_ENVELOPE = _struct(
    "stand_id string, stand_name string, predicted_wait_5min double, "
    "predicted_wait_10min double, halftime_spike_expected boolean, "
    "recommendation string, generated_at string"
)
ALERT_ENVELOPE = _struct(
    "severity string, category string, message string, timestamp string, "
    "seat_id string, zone string, stand_id string"
)

ZONE_STATE_COLUMNS = ["density", "headcount", "flow_rate", "direction", "congestion_level"]
STAND_STATE_COLUMNS = ["queue_length", "wait_minutes", "capacity_pct", "is_open"]
