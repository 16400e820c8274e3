"""Channel keys, exposure ids and key patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPOSURE_PARTS = 7
SUBSYSTEM_PART = 4


def normal_key(key: Column) -> Column:
    """A channel key with its subsystem, the text before the first dot, in upper case."""
    head = F.substring_index(key, ".", 1)
    return F.concat(F.upper(head), F.substr(key, F.length(head) + 1))


def event_key(source: Column, event_name: Column) -> Column:
    """The identity of a telemetry channel: source and event name."""
    return F.concat(normal_key(source), F.lit("."), event_name)


def exposure_parts(exposure_id: Column) -> Column:
    """The dash-separated parts; empty parts at the end do not count."""
    return F.split(F.regexp_replace(exposure_id, "-+$", ""), "-")


def exposure_subsystem(exposure_id: Column) -> Column:
    """Upper-case subsystem named by a well-formed exposure id, else null."""
    parts = exposure_parts(exposure_id)
    return F.when(F.size(parts) == EXPOSURE_PARTS, F.upper(F.get(parts, F.lit(SUBSYSTEM_PART - 1))))


def glob_like(key: Column, pattern: str) -> Column:
    """True where the whole key matches a glob in which ``*`` stands for any text, dots included."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return key.like(escaped.replace("*", "%"))
