"""Points in time given by callers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(time: datetime) -> Column:
    """A timestamp literal; a time without zone is UTC, wherever the driver runs."""
    return F.lit(time if time.tzinfo else time.replace(tzinfo=timezone.utc)).cast("timestamp")
