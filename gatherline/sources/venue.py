"""The venue: zones, stands, corridors and gates.

Everything here is fixed-size reference data (12 zones, 8 stands, 19 corridors),
which is what makes broadcasting it safe at any data volume.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Zones, in venue order.
ZONES = [
    "Gate-North", "Gate-South", "Gate-East", "Gate-West",
    "Concourse-A", "Concourse-B", "Concourse-C",
    "Lower-Stands", "Upper-Stands", "VIP-Lounge",
    "Parking-P1", "Parking-P2",
]

# Stand, name, zone, queue capacity, tills, served per minute and till.
STANDS = [
    ("C4", "Hot Dogs & Snacks", "Concourse-A", 40, 3, 2.0),
    ("B2", "Beer & Beverages", "Concourse-B", 35, 2, 1.7),
    ("A7", "Pizza Corner", "Concourse-A", 30, 2, 1.2),
    ("B5", "Burgers & Fries", "Concourse-B", 45, 3, 1.5),
    ("C1", "Coffee & Desserts", "Concourse-C", 25, 2, 1.8),
    ("A3", "Nachos & Wraps", "Concourse-A", 30, 2, 1.3),
    ("D2", "VIP Bar", "VIP-Lounge", 20, 4, 2.3),
    ("B8", "South Grill", "Concourse-B", 35, 2, 1.5),
]
# Tills and service rate of a stand that is not listed.
UNKNOWN_STAND_TILLS = 2
UNKNOWN_STAND_RATE = 1.5

# Corridors walkable both ways, with seconds when empty.
CORRIDORS = [
    ("Gate-North", "Concourse-A", 45.0),
    ("Gate-South", "Concourse-C", 40.0),
    ("Gate-East", "Concourse-A", 50.0),
    ("Gate-East", "Concourse-B", 55.0),
    ("Gate-West", "Concourse-C", 45.0),
    ("Concourse-A", "Concourse-B", 60.0),
    ("Concourse-B", "Concourse-C", 60.0),
    ("Concourse-A", "Concourse-C", 90.0),
    ("Concourse-A", "Lower-Stands", 30.0),
    ("Concourse-B", "Lower-Stands", 35.0),
    ("Concourse-C", "Lower-Stands", 40.0),
    ("Concourse-A", "Upper-Stands", 60.0),
    ("Concourse-B", "Upper-Stands", 65.0),
    ("Gate-North", "VIP-Lounge", 25.0),
    ("VIP-Lounge", "Lower-Stands", 20.0),
    ("Parking-P1", "Gate-North", 120.0),
    ("Parking-P1", "Gate-East", 90.0),
    ("Parking-P2", "Gate-South", 100.0),
    ("Parking-P2", "Gate-West", 110.0),
]

# Seating zones in planning order, with their own gates by preference.
SEATING_GATES = [
    ("VIP-Lounge", ["Gate-North"]),
    ("Lower-Stands", ["Gate-North", "Gate-East"]),
    ("Upper-Stands", ["Gate-East", "Gate-North"]),
    ("Concourse-A", ["Gate-North", "Gate-East"]),
    ("Concourse-B", ["Gate-East"]),
    ("Concourse-C", ["Gate-South", "Gate-West"]),
]
# Gates in the order tried when a zone's own gates are blocked.
GATES_BY_PRIORITY = ["Gate-North", "Gate-East", "Gate-South", "Gate-West"]
# Hops to a gate, used only where no gate can be reached.
HOPS_WITHOUT_PATH = {
    "VIP-Lounge": 1, "Lower-Stands": 2, "Upper-Stands": 3,
    "Concourse-A": 2, "Concourse-B": 2, "Concourse-C": 2,
}
DEFAULT_HOPS = 3

# Fixed value: where fans of a zone are routed to.
MAIN_SEATING = "Lower-Stands"

# Message topics.
CROWD_TOPIC = "vf_crowd_raw"
QUEUE_TOPIC = "vf_queues_raw"
BLE_TOPIC = "vf_ble_raw"
CCTV_TOPIC = "vf_cctv_raw"
INTELLIGENCE_TOPIC = "vf_intelligence_out"
ALERTS_TOPIC = "vf_alerts"
ORDERS_TOPIC = "vf_orders"

# Kinds of camera anomaly.
ANOMALY_TYPES = [
    "crowd_surge", "unattended_bag", "medical_emergency",
    "queue_overflow", "restricted_area_breach",
]


def _table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    # An Arrow table becomes a local relation, whose exact size the optimizer knows.
    names = [c.split()[0] for c in ddl.split(", ")]
    columns = [pa.array(list(column)) for column in zip(*rows)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names), ddl)


def zones(spark: SparkSession) -> DataFrame:
    return _table(spark, list(enumerate(ZONES)), "zone_order int, zone string")


def stands(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(STANDS)]
    return _table(
        spark,
        rows,
        "stand_order int, stand_id string, stand_name string, zone string, "
        "capacity int, tills int, service_rate double",
    )


def edges(spark: SparkSession) -> DataFrame:
    """Corridors as directed edges, two per corridor."""
    both = CORRIDORS + [(b, a, s) for a, b, s in CORRIDORS]
    return _table(spark, both, "from_zone string, to_zone string, base_seconds double")


def seating(spark: SparkSession) -> DataFrame:
    rows = [(i, zone, gates) for i, (zone, gates) in enumerate(SEATING_GATES)]
    return _table(spark, rows, "seat_order int, zone string, own_gates array<string>")


def with_stand_rates(df: DataFrame) -> DataFrame:
    """Add ``tills`` and ``service_rate``; unlisted stands get the defaults."""
    rates = stands(df.sparkSession).select("stand_id", "tills", "service_rate")
    return (
        df.join(F.broadcast(rates), "stand_id", "left")
        .withColumn("tills", F.coalesce("tills", F.lit(UNKNOWN_STAND_TILLS)))
        .withColumn("service_rate", F.coalesce("service_rate", F.lit(UNKNOWN_STAND_RATE)))
    )
