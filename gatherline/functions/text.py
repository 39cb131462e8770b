"""Text formats and parsing of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ITEMS
from .numbers import round_half_up


def whole_number(x: Column) -> Column:
    return F.floor(x + 0.5).cast("string")


def whole_percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100.0 + 0.5).cast("string"), F.lit("%"))


def decimals(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_half_up(x, digits))


def path_text(path: Column) -> Column:
    """Zones joined by arrows; NULL unless there is a step to take."""
    return F.when(F.size(path) > 1, F.array_join(path, " → "))


def is_uuid(text: Column) -> Column:
    """UUID text, with or without hyphens, braces or the urn prefix (in lower case)."""
    bare = F.lower(F.regexp_replace(text, r"urn:|uuid:", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[{}]+|[{}]+$", ""), "-", "")
    return F.coalesce(bare.rlike("^[0-9a-f]{32}$"), F.lit(False))


def uuid_from(*parts: Column) -> Column:
    """A UUID-shaped id that depends only on ``parts``, so replays repeat it."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def canonical_uuid(text: Column) -> Column:
    """The hyphenated lower-case form of any accepted UUID text, else NULL."""
    bare = F.regexp_replace(F.lower(text), r"urn:|uuid:|[{}\-]", "")
    return F.when(
        is_uuid(text),
        F.concat_ws(
            "-",
            F.substring(bare, 1, 8),
            F.substring(bare, 9, 4),
            F.substring(bare, 13, 4),
            F.substring(bare, 17, 4),
            F.substring(bare, 21, 12),
        ),
    )


def parse_time(text: Column) -> Column:
    """ISO-8601 text with ``Z``, an offset or none (UTC); bad text gives NULL."""
    return F.try_to_timestamp(text)


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def items_from_json(text: Column) -> Column:
    """Order items; unreadable text gives an empty list."""
    return F.coalesce(F.from_json(text, ITEMS), F.array().cast(ITEMS))


def items_to_json(items: Column) -> Column:
    return F.to_json(items)


def stand_key(text: Column) -> Column:
    return F.upper(text)


def after_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1)))
