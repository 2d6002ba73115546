"""The most frequent values of a column, exactly, without shuffling all distinct values.

Rows are counted in a fixed number of hash buckets first; a task sends one count per bucket, however many values it
reads. No value is more frequent than its bucket is full, so bucket totals are upper bounds. The values of the fullest
buckets are then counted exactly, and the k-th of these counts is a lower bound of the border: a value of any bucket
whose total stays below it can't be among the first k. If every other bucket is below, the result is certified; if not,
the values of all buckets that reach the border are counted, which certifies it. Ties at the border stay whole, as a
bucket that merely reaches the border is counted too.

On skewed data few buckets are counted. On flat data all buckets reach the border and this is the plain grouping, after
two cheaper passes. The input is read once for each pass (two or three): stage it if it is dear to compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets; their totals, and the bucket numbers to keep, are all that passes the driver or is broadcast.
BUCKETS = 1 << 16
#: Buckets that are counted first, for each value asked for.
FIRST_PER_VALUE = 4


def bucket_totals(rows: DataFrame, column: str, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(bucket, rows) of the buckets that hold rows, fullest first: at most `buckets` pairs."""
    totals = rows.groupBy(_bucket(column, buckets).alias("bucket")).agg(F.count("*").alias("n")).collect()
    return sorted(((r.bucket, r.n) for r in totals), key=lambda t: (-t[1], t[0]))


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).isNull(), column), F.lit(buckets)).cast("int")


def _counted(rows: DataFrame, column: str, chosen: list[int], of: int, buckets: int) -> DataFrame:
    """Exact counts of the values in the chosen ones of `of` filled buckets."""
    if len(chosen) < of:
        wanted = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in chosen], "wanted int"))
        rows = rows.join(wanted, _bucket(column, buckets) == F.col("wanted"), "left_semi")
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def _first(counted: DataFrame, column: str, k: int) -> DataFrame:
    return counted.orderBy(F.desc("n"), F.asc(column)).limit(k)


def heavy_hitters(rows: DataFrame, column: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The k most frequent values with their counts `n`, ties by value, null being a value and the smallest one.

    All values come back if there are fewer than k. `k` rows pass the driver.
    """
    if k < 1 or column == "n":
        raise ValueError("k must be positive, and the column's name other than n")
    rows = rows.select(column)
    totals = bucket_totals(rows, column, buckets)
    filled = [b for b, _ in totals]
    tried = filled[: FIRST_PER_VALUE * k]
    found = _first(_counted(rows, column, tried, len(filled), buckets), column, k)
    best = found.collect()
    border = best[-1]["n"] if len(best) == k else 0
    needed = [b for b, n in totals if n >= border]
    if len(needed) <= len(tried):
        return rows.sparkSession.createDataFrame(best, found.schema)
    return _first(_counted(rows, column, needed, len(filled), buckets).where(F.col("n") >= border), column, k)
