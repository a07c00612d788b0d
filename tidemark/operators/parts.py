"""Time cut into parts of about equal numbers of rows, so that ordered work is spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import unused

#: At most so many parts, of so many rows each, and of so many bytes where rows carry payloads, as long as there are
#: fewer parts than that.
MOST_PARTS, PART_ROWS, PART_BYTES = 1024, 1_000_000, 64 << 20
#: Parts by bytes are put together from so many times as many ranges of equal numbers of rows.
FINER = 8


def key_cuts(df: DataFrame, key: str = "ts_ns", rows: int = PART_ROWS) -> list[int]:
    """Ascending keys at which parts begin; no cuts if one part is enough, which a count of the keys tells.

    They are approximate quantiles, so a dense hour is cut as finely as a thin month. A key lies in one part only.
    """
    parts = min(MOST_PARTS, -(-df.agg(F.count(key)).first()[0] // rows))
    if parts <= 1:
        return []
    quantiles = F.percentile_approx(key, [k / parts for k in range(1, parts)], 8 * parts)
    return sorted(set(df.agg(quantiles.alias("q")).first()["q"]))


def weighted_cuts(df: DataFrame, key: str, weight: str, rows: int = PART_ROWS, most: int = PART_BYTES) -> list[int]:
    """The same for rows that carry `weight` bytes each: parts have at most about `rows` rows and `most` bytes.

    Where long payloads stand together the parts are shorter: ranges much finer than a part are weighed, and as many
    neighbours as fit make a part.
    """
    n, total = df.agg(F.count(key), F.sum(weight)).first()
    parts = min(MOST_PARTS, max(-(-n // rows), -(-int(total or 0) // most)))
    if parts <= 1:
        return []
    fine = FINER * parts
    quantiles = F.percentile_approx(key, [k / fine for k in range(1, fine)], 4 * fine)
    cuts = sorted(set(df.agg(quantiles.alias("q")).first()["q"]))
    at, count, size = unused(df.columns, "at", "n", "bytes")
    weighed = df.groupBy(part_of(F.col(key), cuts).alias(at)).agg(F.count(key).alias(count), F.sum(weight).alias(size)).collect()
    found, full_rows, full = [], max(rows, n / MOST_PARTS), max(most, (total or 0) / MOST_PARTS)
    n, total = 0, 0
    for r in sorted(weighed):
        if r[at] and n and (n + r[count] > full_rows or total + (r[size] or 0) > full):
            found.append(cuts[r[at] - 1])
            n, total = 0, 0
        n, total = n + r[count], total + (r[size] or 0)
    return found


def part_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key: a binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts))
    bits = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.reduce(bits, F.lit(0), lambda at, bit: F.when(F.get(table, at + bit - 1) <= key, at + bit).otherwise(at))


def by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where the keys change, with the keys' values; rows of a key come one after another."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        cuts = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            cuts |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cuts) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            yield tuple(c[a].as_py() for c in columns), batch.slice(a, z - a)
