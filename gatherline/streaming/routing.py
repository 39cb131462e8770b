"""Message routing to audiences as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import route_messages


def start(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write (topic, key, value, room, type, valid) as JSON lines. Stateless; the file
    sink commits every batch once."""
    return (
        route_messages(stream)
        .writeStream.outputMode("append")
        .format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def to_kafka(stream: DataFrame, servers: str, checkpoint: str) -> StreamingQuery:
    """Publish (topic, key, value) rows; needs the Kafka package on the cluster."""
    return (
        stream.select("topic", "key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )
