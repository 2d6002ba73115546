"""The k-th largest value of a column, found digit by digit without sorting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 12


def kth_largest(rows: DataFrame, column: str, k: int, bits: int = 60) -> tuple[int, int]:
    """Value of the k-th largest whole number in 0..2^bits-1 (k from 1 to the number of rows), and how many are larger.

    Each round counts one digit of the numbers that share the digits found so far: at most 2^DIGIT counts reach the driver.
    """
    found, larger = 0, 0
    for shift in range(bits - DIGIT, -1, -DIGIT):
        digit = F.shiftright(column, shift)
        same = rows.where(F.shiftright(column, shift + DIGIT) == F.lit(found)) if shift < bits - DIGIT else rows
        counts = {r.digit: r.n for r in same.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
        for value in sorted(counts, reverse=True):
            if larger + counts[value] >= k:
                found = value
                break
            larger += counts[value]
    return found, larger
