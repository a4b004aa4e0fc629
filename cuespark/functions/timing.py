"""Times as column expressions: milliseconds, cue timestamps, even splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, MINUTE, SECOND = 3_600_000, 60_000, 1_000


def truncated_ms(seconds: Column) -> Column:
    """Seconds to milliseconds, towards zero."""
    return (seconds.cast("double") * F.lit(1000.0)).cast("long")


def rounded_ms(seconds: Column) -> Column:
    """Seconds to milliseconds, ties to even, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.rint(seconds.cast("double") * F.lit(1000.0)).cast("long"))


def srt_timestamp(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; negative times are zero, hours take as many digits as they need."""
    whole = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    parts = (F.floor(whole / HOUR), F.floor(whole / MINUTE) % 60, F.floor(whole / SECOND) % 60, whole % 1000)
    hours, minutes, seconds, millis = (p.cast("string") for p in parts)
    two = lambda x: F.lpad(x, 2, "0")  # noqa: E731  a formatter for each time costs many times as much
    return F.concat(F.when(parts[0] < 100, two(hours)).otherwise(hours), F.lit(":"), two(minutes), F.lit(":"), two(seconds), F.lit(","), F.lpad(millis, 3, "0"))


def clock_ms(hours: Column, minutes: Column, seconds: Column, millis: Column) -> Column:
    """Milliseconds of digit groups; an absent (empty) group counts as zero."""
    value = [F.coalesce(F.nullif(x, F.lit("")).cast("long"), F.lit(0).cast("long")) for x in (hours, minutes, seconds, millis)]
    return value[0] * HOUR + value[1] * MINUTE + value[2] * SECOND + value[3]


def vtt_ms(timestamp: Column) -> Column:
    """``HH:MM:SS.mmm`` to milliseconds by floating point, truncated."""
    part = F.split(timestamp, ":")
    value = part[0].cast("double") * HOUR + part[1].cast("double") * MINUTE + part[2].cast("double") * SECOND
    return value.cast("long")


def even_split(start: Column, end: Column, count: Column) -> Column:
    """``count`` consecutive ``{start_ms, end_ms}`` that divide a span by integer floors; empty below 1."""
    point = lambda i: start + F.floor((end - start) * i / F.nullif(count, F.lit(0))).cast("long")
    spans = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct(point(i).alias("start_ms"), point(i + 1).alias("end_ms")))
    return F.when(count >= 1, spans).otherwise(F.slice(spans, 1, 0))


def report_time(seconds: Column) -> Column:
    """Three decimals and ``s``; a question mark for null."""
    return F.when(seconds.isNull(), "?").otherwise(F.format_string("%.3fs", seconds))


def shanghai_time(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")
