"""Time-based identifiers: version-1 UUIDs to timestamps and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 100-nanosecond steps from the start of UUID time (1582-10-15) to 1970-01-01.
UUID_EPOCH = 0x01B21DD213814000


def uuid_timestamp(uuid: Column) -> Column:
    """The time inside a version-1 UUID, to the microsecond."""
    digits = F.concat(F.substring(uuid, 16, 3), F.substring(uuid, 10, 4), F.substring(uuid, 1, 8))
    steps = F.conv(digits, 16, 10).cast("long") - UUID_EPOCH
    # doubles cannot tell these numbers apart from 2027 on, decimals can
    return F.timestamp_micros(F.floor(steps.cast("decimal(20,0)") / 10).cast("long"))


def time_uuid(ts: Column, *unique: str) -> Column:
    """A version-1 UUID of a time; the other bits are a hash of the given columns."""
    steps = F.lpad(F.lower(F.hex(F.unix_micros(ts) * 10 + UUID_EPOCH)), 15, "0")
    node = F.substring(F.sha2(F.concat_ws("\0", *unique), 256), 1, 15)
    return F.concat_ws(
        "-",
        F.substring(steps, 8, 8),
        F.substring(steps, 4, 4),
        F.concat(F.lit("1"), F.substring(steps, 1, 3)),
        F.concat(F.lit("8"), F.substring(node, 1, 3)),
        F.substring(node, 4, 12),
    )
