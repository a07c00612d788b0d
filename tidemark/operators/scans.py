"""Scans by time over frames with a ts_ns key: exact, oldest, newest, range, since, after, and text filters."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.durations import parse_duration
from tidemark.functions.timeconv import LAST_NS, between_ns
from tidemark.functions.values import json_valid

OLDEST_LIMIT = NEWEST_LIMIT = 10
RANGE_LIMIT = 100


def now() -> int:
    return time.time_ns()


def limit_or(given: object, default: int) -> int:
    """A limit as requests give it: what is no positive integer means the default."""
    try:
        n = int(str(given))
    except ValueError:
        return default
    return n if n > 0 else default


def at_time(df: DataFrame, ts_ns: int) -> DataFrame:
    return between_ns(df, ts_ns, ts_ns)


def first_rows(df: DataFrame, limit: int = 0) -> DataFrame:
    """Ascending by time; a limit of 0 or less means all."""
    out = df.orderBy("ts_ns")
    return out.limit(limit) if limit > 0 else out


def oldest(df: DataFrame, limit: int = OLDEST_LIMIT) -> DataFrame:
    return first_rows(df, limit)


def newest(df: DataFrame, limit: int = NEWEST_LIMIT, since: str | int | None = None, now_ns: int | None = None, order: str = "desc") -> DataFrame:
    """Newest first. With since, the newest of that span; order='asc' keeps the span's oldest instead."""
    if since is not None:
        df = since_span(df, since, now_ns)
    if order == "asc":
        return first_rows(df, limit)
    out = df.orderBy(F.desc("ts_ns"))
    return out.limit(limit) if limit > 0 else out


def since_span(df: DataFrame, since: str | int, now_ns: int | None = None) -> DataFrame:
    end = now() if now_ns is None else now_ns
    width = parse_duration(since) if isinstance(since, str) else since
    return between_ns(df, end - width, end)


def time_range(
    df: DataFrame, start: int = 0, end: int = 0, since: str | int | None = None, after: int | None = None,
    limit: int = 0, now_ns: int | None = None,
) -> DataFrame:
    """Both ends inclusive, ascending. since goes before after, and after before start and end; 0 is an open end, up to now."""
    if since is not None:
        return first_rows(since_span(df, since, now_ns), limit)
    present = now() if now_ns is None else now_ns
    if after is not None:
        return first_rows(between_ns(df, after + 1, present), limit)
    last = end or present
    if start > last:
        raise ValueError("the range starts after its end")
    return first_rows(between_ns(df, start, min(last, LAST_NS)), limit)


def contains_text(df: DataFrame, needle: str, ignore_case: bool = False, column: str = "payload") -> DataFrame:
    """Rows whose stored form has the text; an empty text keeps all rows."""
    return df.where(text_match(F.col(column), needle, ignore_case)) if needle else df


def text_match(payload: Column, needle: str, ignore_case: bool = False) -> Column:
    text = payload.cast("string")
    return F.contains(F.lower(text), F.lit(needle.lower())) if ignore_case else F.contains(text, F.lit(needle))


def json_only(df: DataFrame, column: str = "payload") -> DataFrame:
    """Rows with valid JSON; for lists it applies after the limit."""
    return df.where(json_valid(F.col(column).cast("string")))


def json_objects(df: DataFrame, column: str = "payload") -> DataFrame:
    """The parsed record as VARIANT; invalid JSON raises when read."""
    return df.withColumn("record", F.parse_json(F.col(column).cast("string")))
