"""Typed parsing and validation of JSON messages, and their counterpart: output
as keyed JSON. Works on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_time, stand_key
from ..schemas import BLE_MESSAGE, CCTV_MESSAGE, CROWD_MESSAGE, ORDER_REQUEST, QUEUE_MESSAGE
from . import venue

_CORRUPT = "_corrupt"
_KEPT = ("tie", "arrival", "received")
#: Of a message's number: the bits of its offset; those above are of its source partition.
OFFSET_BITS = 44

# Lifecycle of an order.
ORDER_STATUSES = ["placed", "preparing", "delivered", "cancelled"]


def _required(schema: T.StructType, optional: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    return [
        (f"missing {name}", F.col(name).isNull()) for name in schema.fieldNames() if name not in optional
    ]


def _unit_interval(name: str) -> tuple[str, Column]:
    return (f"{name} outside 0..1", ~F.col(name).between(0.0, 1.0))


def _rules(topic: str) -> tuple[T.StructType, dict, list[tuple[str, Column]]]:
    """Schema, defaults of absent fields, and the rules that reject a message."""
    if topic == venue.CROWD_TOPIC:
        return CROWD_MESSAGE, {}, _required(CROWD_MESSAGE) + [_unit_interval("density")]
    if topic == venue.QUEUE_TOPIC:
        return (
            QUEUE_MESSAGE,
            {"is_open": True},
            _required(QUEUE_MESSAGE, ("is_open",)) + [_unit_interval("capacity_pct")],
        )
    if topic == venue.BLE_TOPIC:
        return BLE_MESSAGE, {}, _required(BLE_MESSAGE)
    if topic == venue.CCTV_TOPIC:
        optional = ("anomaly_detected", "anomaly_type")
        return (
            CCTV_MESSAGE,
            {"anomaly_detected": False},
            _required(CCTV_MESSAGE, optional) + [_unit_interval("motion_intensity")],
        )
    raise ValueError(f"no readings on topic {topic}")


def failed_rules(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules a row breaks, in rule order; NULL conditions do not fail."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])
    )


def _computed_once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """Add ``column``, computed once per row. Filters on the result, and each use in a later column, would else
    compute it again: the optimizer writes a column's expression wherever its name stands, but not below an explode."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def _parsed_once(messages: DataFrame, kept: list[str], schema: T.StructType) -> DataFrame:
    """``kept``, value and the fields of the message; both the text and its fields are made once per row."""
    rows = _computed_once(messages.select(*kept, F.col("value").alias("_text")), "value", F.col("_text")).drop("_text")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT})
    return _computed_once(rows, "m", parsed).select(*kept, "value", "m.*")


def parse(messages: DataFrame, topic: str) -> DataFrame:
    """Readings with a ``reasons`` column; an empty list marks a valid reading.

    Input: ``value`` (JSON text) and optionally ``tie``, ``arrival``, ``received``.
    """
    schema, defaults, rules = _rules(topic)
    corrupt_aware = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    kept = [c for c in _KEPT if c in messages.columns]
    rows = _parsed_once(messages, kept, corrupt_aware)
    rows = _computed_once(rows, "time", parse_time(F.col("timestamp")))
    for name, default in defaults.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(default)))
    unreadable = F.col(_CORRUPT).isNotNull()
    reasons = F.when(unreadable, F.array(F.lit("unreadable"))).otherwise(
        failed_rules(rules + [("bad timestamp", F.col("timestamp").isNotNull() & F.col("time").isNull())])
    )
    fields = [f for f in schema.fieldNames() if f != "timestamp"]
    return rows.select(*kept, "time", *fields, "value", reasons.alias("reasons"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("reasons") == 0).drop("reasons", "value", "received")


def quarantined(parsed: DataFrame) -> DataFrame:
    kept = [c for c in _KEPT if c in parsed.columns and c != "received"]
    return parsed.where(F.size("reasons") > 0).select(*kept, "value", "reasons")


def order_faults() -> list[tuple[str, Column]]:
    """Why an order request cannot be taken (size, range and text rules)."""
    def any_item(test) -> Column:
        return F.exists("items", test)

    return [
        ("no items", F.coalesce(F.size("items"), F.lit(0)) < 1),
        (
            "quantity outside 1..20",
            any_item(lambda i: i["quantity"].isNull() | ~i["quantity"].between(1, 20)),
        ),
        ("price below 0", any_item(lambda i: i["price"].isNull() | (i["price"] < 0))),
        ("instructions too long", F.length("special_instructions") > 200),
    ]


def parse_orders(messages: DataFrame) -> DataFrame:
    """Order requests of JSON messages: placed_at, tie, seat_id, stand_id, items, special_instructions, value, reasons.

    The request's ``timestamp`` is the time it was placed. ``reasons`` names what cannot be read at all or is
    missing; the rules of :func:`order_faults` come later.
    """
    schema = T.StructType([T.StructField("timestamp", T.StringType()), *ORDER_REQUEST.fields])
    corrupt_aware = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    rows = _parsed_once(messages, ["tie"], corrupt_aware)
    rows = _computed_once(rows, "placed_at", parse_time(F.col("timestamp")))
    rules = _required(schema, ("special_instructions", "items"))
    rules += [("bad timestamp", F.col("timestamp").isNotNull() & F.col("placed_at").isNull())]
    unreadable = F.col(_CORRUPT).isNotNull()
    reasons = F.when(unreadable, F.array(F.lit("unreadable"))).otherwise(failed_rules(rules))
    return rows.select(
        "placed_at", "tie", "seat_id", "stand_id", "items", "special_instructions", "value", reasons.alias("reasons")
    )


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(ORDER_STATUSES), F.lit(False))


def _payload(df: DataFrame, fields: list[str]) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def keyed(df: DataFrame, topic: str, key: Column, fields: list[str] | None = None) -> DataFrame:
    """Rows as (topic, key, value) messages."""
    return df.select(
        F.lit(topic).alias("topic"),
        key.alias("key"),
        _payload(df, fields or df.columns).alias("value"),
    )


def readings_as_messages(readings: DataFrame, topic: str) -> DataFrame:
    """Crowd readings keyed by zone, queue readings by stand."""
    key = F.col("stand_id") if topic == venue.QUEUE_TOPIC else F.col("zone")
    schema = _rules(topic)[0]
    stamped = readings.withColumn("timestamp", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return keyed(stamped, topic, key, schema.fieldNames())


def predictions_as_messages(flow: DataFrame | None, wait: DataFrame | None) -> DataFrame:
    """Flow and wait predictions in one topic."""
    parts = []
    if flow is not None:
        parts.append(keyed(flow, venue.INTELLIGENCE_TOPIC, F.concat(F.lit("flow:"), "zone")))
    if wait is not None:
        parts.append(keyed(wait, venue.INTELLIGENCE_TOPIC, F.concat(F.lit("wait:"), "stand_id")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def orders_as_messages(orders: DataFrame) -> DataFrame:
    return keyed(orders, venue.ORDERS_TOPIC, F.concat(F.lit("order:"), "seat_id"))


def message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of (key, value, arrival) from a folder of JSON-lines files."""
    reader = spark.readStream.schema("key string, value string, tie long, arrival long")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def kafka_rows(rows: DataFrame) -> DataFrame:
    """Kafka's columns as (topic, key, value, tie, arrival, received), batch or stream.

    ``tie`` is unique within a topic; offsets order one partition only, so messages of several
    arrive by (timestamp, partition, offset). ``received``: the source's timestamp.
    """
    return rows.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        (F.shiftleft(F.col("partition").cast("bigint"), OFFSET_BITS) + F.col("offset")).alias("tie"),
        F.struct("timestamp", "partition", "offset").alias("arrival"),
        F.col("timestamp").alias("received"),
    )


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest") -> DataFrame:
    """Stream of (topic, key, value, tie, arrival, received) from Kafka; needs the Kafka package."""
    return kafka_rows(
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
        .load()
    )


def normalised_stand(df: DataFrame) -> DataFrame:
    return df.withColumn("stand_id", stand_key(F.col("stand_id")))
