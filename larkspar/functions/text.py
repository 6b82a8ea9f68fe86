"""Text, time and formatting scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_text(value: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, the last three of a cut one being dots."""
    return F.when(F.char_length(value) > limit, F.concat(F.substring(value, 1, limit - 3), F.lit("..."))).otherwise(value)


def redact_user(value: Column) -> Column:
    t = F.trim(F.coalesce(value, F.lit("")))
    return F.when(t == "", F.lit("(redacted)")).otherwise(clip_text(t, 120))


def redact_agent(value: Column) -> Column:
    t = F.trim(F.coalesce(value, F.lit("")))
    return F.when(t == "", F.lit("(redacted)")).otherwise(clip_text(t, 200))


def signed_pct(value: Column, digits: int = 1) -> Column:
    """+2.3% or -0.5%."""
    return F.format_string(f"%+.{digits}f%%", value)


def as_bool(value: Column) -> Column:
    """Whether a text says yes: 1, true, yes or on."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def tool_name(value: Column, prefix: str) -> Column:
    """A tool's name without its prefix."""
    return F.when(value.startswith(prefix), F.substring(value, len(prefix) + 1, 1 << 20)).otherwise(value)


#: Memory paths by the phase of the trading day.
REVIEW_PATH, OPENING_PATH, SESSION_PATH = "/trading/equity/daily_review", "/trading/equity/ops/T0", "/trading/equity/journal/positions"


def market_clock(utc: Column, zone: str = "Asia/Shanghai") -> Column:
    """Memory path of a moment: review at weekends and after 15:00, opening from 9:15, session from 10:00; '' before."""
    t = F.from_utc_timestamp(utc, zone)
    minute = F.hour(t) * 60 + F.minute(t)
    weekend = F.weekday(t) >= 5
    return F.when(weekend | (minute >= 15 * 60), REVIEW_PATH).when(minute >= 10 * 60, SESSION_PATH).when(minute >= 9 * 60 + 15, OPENING_PATH).otherwise("")


def time_stamp_features(ts: Column) -> Column:
    """minute, hour, weekday (Monday 0), day of month, month."""
    return F.array(*[f(ts).cast("double") for f in (F.minute, F.hour, F.weekday, F.dayofmonth, F.month)])


def keywords(value: Column) -> Column:
    """A JSON list of texts, or else a comma-separated list; blank items go."""
    items = F.coalesce(F.from_json(value, "array<string>"), F.split(F.coalesce(value, F.lit("")), ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def memory_path(value: Column, root: str = "memory") -> Column:
    """A normalised memory path: no double or outer slashes, under the root."""
    p = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\\", "/"), "/+", "/"), F.lit("/"))
    return F.when(p == "", F.lit(root)).when(p.startswith(root + "/") | (p == root), p).otherwise(F.concat(F.lit(root + "/"), p))
