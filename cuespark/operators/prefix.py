"""Sums and ranks along a recording, for recordings of any length.

A window over a whole document is one task's work, however long the document is.  With a ``part`` (a column that does
not fall along the order: word number div 65,536, minutes) the same numbers come from two levels: totals are taken for
each part, added up along the document (one row a part), and joined to windows that hold one part only.  The join and
the windows are on the same key, so rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, made longer until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _with_earlier(rows: DataFrame, total: Column, part: Column, at: str, earlier: str) -> DataFrame:
    """``rows`` with ``at`` (document and part) and ``earlier``: the totals of the parts before it."""
    rows = rows.withColumn(at, F.struct(F.col("doc_id").alias("doc"), part.alias("part")))  # equal where both ids are null, too
    along = W.partitionBy(f"{at}.doc").orderBy(f"{at}.part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(at).agg(total.alias(earlier))
    return rows.join(totals.select(at, F.coalesce(F.sum(earlier).over(along), F.lit(0)).alias(earlier)), at)


def sum_before(rows: DataFrame, name: str, value: Column, order: list[str], part: Column | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the document that come before."""
    if part is None:
        along = W.partitionBy("doc_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(along), F.lit(0)))
    at, earlier, columns = unused("part", rows), unused("earlier", rows), [c for c in rows.columns if c != name]
    along = W.partitionBy(at).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(along), F.lit(0))
    return _with_earlier(rows, F.sum(value), part, at, earlier).select(*columns, (F.col(earlier) + own).alias(name))


def number(rows: DataFrame, name: str, order: list[str], part: Column | None = None) -> DataFrame:
    """``name``: the place of the row in the document, from 0."""
    if part is None:
        return rows.withColumn(name, (F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1).cast("long"))
    at, earlier, columns = unused("part", rows), unused("earlier", rows), [c for c in rows.columns if c != name]
    own = F.row_number().over(W.partitionBy(at).orderBy(*order)) - 1
    return _with_earlier(rows, F.count(F.lit(1)), part, at, earlier).select(*columns, (F.col(earlier) + own).alias(name))


def dense_number(rows: DataFrame, name: str, column: str, part: Column | None = None) -> DataFrame:
    """``name``: how many smaller values ``column`` has in the document; ``part`` must follow from ``column``."""
    if part is None:
        return rows.withColumn(name, (F.dense_rank().over(W.partitionBy("doc_id").orderBy(column)) - 1).cast("long"))
    at, earlier, columns = unused("part", rows), unused("earlier", rows), [c for c in rows.columns if c != name]
    own = F.dense_rank().over(W.partitionBy(at).orderBy(column)) - 1
    return _with_earlier(rows, F.countDistinct(column), part, at, earlier).select(*columns, (F.col(earlier) + own).alias(name))
