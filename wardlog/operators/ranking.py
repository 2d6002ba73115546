"""Exact ranks, running totals and quantiles over the whole table without one global sort task.

All of them cut the order into ranges first. The totals per range form a small table whose size is
fixed by the number of ranges, so offsets come from a cumulative sum over that, and only the rows
inside one range are ever sorted together.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 4
#: Distinct values that one range of a running total aims at, and equal ranges of a quantile sketch at most.
RANGE_ROWS, MOST_RANGES = 100_000, 65_536
#: Distinct values that one task orders when a rank is selected.
SELECT_ROWS = 10_000
#: Accuracy from which a sketch is not refined any more.
FINEST = 1_000_000


def hash_key(seed: int | str, *ids: str) -> Column:
    """md5 text that orders rows the same way in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def _with_offsets(df: DataFrame, strata: list[str], bucket: str, weight: Column) -> DataFrame:
    """Joins `_before` (weight in earlier buckets) and `_total` per stratum."""
    order = Window.partitionBy(*strata).orderBy(bucket) if strata else Window.partitionBy(F.lit(0)).orderBy(bucket)
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    totals = df.groupBy(*strata, bucket).agg(F.sum(weight).alias("_here"))
    offsets = totals.select(
        *strata,
        bucket,
        (F.sum("_here").over(order) - F.col("_here")).alias("_before"),
        F.sum("_here").over(whole).alias("_total"),
    )
    named = offsets.withColumnsRenamed({c: f"_of_{c}" for c in [*strata, bucket]})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*strata, bucket]]
    return df.join(named, reduce(and_, same)).drop(*[f"_of_{c}" for c in [*strata, bucket]])


def hash_rank(df: DataFrame, ids: list[str], strata: list[str], seed: int | str = 42, digits: int = HEX_DIGITS) -> DataFrame:
    """Adds `rank` (1..n per stratum, in md5 order) and `stratum_size`.

    A stratum is spread over 16^digits hash ranges, so one huge class never meets in one task.
    NULL is a stratum of its own; `ids` must identify a row.
    """
    keyed = df.withColumn("_hash", hash_key(seed, *ids)).withColumn("_bucket", F.left("_hash", F.lit(digits)))
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", *ids)
    return (
        _with_offsets(keyed, strata, "_bucket", F.lit(1).cast("bigint"))
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .withColumnRenamed("_total", "stratum_size")
        .drop("_hash", "_bucket", "_before")
    )


def hash_cut(df: DataFrame, ids: list[str], strata: list[str], wanted: Column, seed: int | str = 42) -> DataFrame:
    """Per stratum, as `_cut`, the (hash, ids) of the last row that belongs to the first `wanted` rows in hash order.

    `wanted` may use `stratum_size`. Rows are counted per hash range, and only the range in which a cut falls is ordered, so no
    row is moved but those; strata of which nothing is wanted have no cut.
    """
    keyed = df.select(*strata, *ids, hash_key(seed, *ids).alias("_hash")).withColumn("_bucket", F.left("_hash", F.lit(HEX_DIGITS)))
    by = [F.col(c) for c in strata] or [F.lit(0)]
    order = Window.partitionBy(*by).orderBy("_bucket")
    counts = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_here"))
    totals = counts.withColumns(
        {"_upto": F.sum("_here").over(order), "stratum_size": F.sum("_here").over(Window.partitionBy(*by))}
    ).withColumn("_wanted", F.least(wanted, F.col("stratum_size")))
    edge = totals.where((F.col("_wanted") > F.col("_upto") - F.col("_here")) & (F.col("_wanted") <= F.col("_upto")))
    edge = edge.select(*[F.col(c).alias(f"_of_{c}") for c in strata], F.col("_bucket").alias("_of_bucket"), (F.col("_wanted") - F.col("_upto") + F.col("_here")).alias("_nth"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in strata], F.col("_bucket") == F.col("_of_bucket"))
    inside = keyed.join(edge, same).withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_hash", *ids)))
    return inside.where(F.col("_rank") == F.col("_nth")).select(*strata, F.struct("_hash", *ids).alias("_cut"))


def range_bucket(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """Adds `_bucket`: the quantile range a numeric value falls in. Only the edges reach the driver.

    The number of ranges follows the number of rows.
    """
    if ranges is None:
        ranges = max(2, min(MOST_RANGES, -(-df.count() // RANGE_ROWS)))
    probabilities = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(df.approxQuantile(column, probabilities, 1 / (4 * ranges))))
    splits = [float("-inf"), *edges, float("inf")]
    source = df.withColumn("_split", F.col(column).cast("double"))
    return Bucketizer(splits=splits, inputCol="_split", outputCol="_bucket").transform(source).drop("_split")


def running_totals(
    df: DataFrame, column: str, weights: list[str], by: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Adds `<weight>_before`: the total weight of rows with a smaller `column`, per group of `by`.

    `column` must be distinct within a group.
    """
    by = by or []
    bucketed = range_bucket(df, column, ranges)
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    totals = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    offsets = totals.select(
        *by, "_bucket", *[(F.sum(f"_{w}").over(order) - F.col(f"_{w}")).alias(f"_{w}_off") for w in weights]
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(column)
    return bucketed.join(offsets, [*by, "_bucket"]).select(
        *df.columns,
        *[(F.col(f"_{w}_off") + F.sum(w).over(inside) - F.col(w)).cast("double").alias(f"{w}_before") for w in weights],
    )


def values_at_ranks(df: DataFrame, column: str, ranks: list[int], accuracy: int = 10_000) -> dict[int, object]:
    """Value of a numeric column at each 0-based rank that exists."""
    narrow = df.select(column).where(F.col(column).isNotNull())
    n = narrow.count()
    wanted = {(column, rank): (None, None, 0, n) for rank in ranks if 0 <= rank < n}
    if not wanted:
        return {}
    edges = _sketch_edges(narrow, wanted, accuracy)
    return {rank: value for (_, rank), value in _select_ranks(narrow, wanted, edges, accuracy).items()}


def row_range(df: DataFrame, id_column: str, first: int, last: int) -> DataFrame:
    """Rows number `first`..`last` in id order (from 1, inclusive). Ids are unique numbers.

    The two limiting ids are found first, on the id column alone; the rows are then one range filter,
    which reaches the scan.
    """
    if first < 1 or last < first:
        raise ValueError("need 1 <= first <= last")
    limits = values_at_ranks(df, id_column, [first - 1, last - 1])
    if first - 1 not in limits:
        return df.where(F.lit(False))
    kept = df.where(F.col(id_column) >= limits[first - 1])
    return kept.where(F.col(id_column) <= limits[last - 1]) if last - 1 in limits else kept


def sample_rows(df: DataFrame, n: int, ids: list[str], seed: int | str = 42) -> DataFrame:
    """At most n rows in seeded hash order: the same rows wherever and however often it runs.

    The last row of the sample is found first; the sample is then a filter, in as many tasks as the table.
    """
    cut = hash_cut(df, ids, [], F.lit(n), seed).first()
    if cut is None:
        return df.where(F.lit(False))
    last = F.struct(F.lit(cut._cut._hash).alias("_hash"), *[F.lit(cut._cut[c]).cast(df.schema[c].dataType).alias(c) for c in ids])
    return df.where(F.struct(hash_key(seed, *ids).alias("_hash"), *ids) <= last)


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10_000
) -> dict[str, dict[float, float]]:
    """Exact linear-interpolated quantiles per column, NULLs ignored.

    An approximate sketch brackets every wanted rank, what lies below the bracket is counted, and the value is
    selected inside it; a bracket that is still too large is bracketed again. Only one row per pass
    reaches the driver.
    """
    numeric = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    slack = 2.0 / accuracy
    points = [x for p in probabilities for x in (max(0.0, p - slack), min(1.0, p + slack))]
    start = numeric.agg(
        *[F.count(c).alias(f"{c}_n") for c in columns],
        *[F.percentile_approx(c, F.lit(points), accuracy).alias(f"{c}_s") for c in columns],
    ).first()
    counts = {c: start[f"{c}_n"] for c in columns}
    result: dict[str, dict[float, float]] = {c: dict.fromkeys(probabilities) for c in columns}
    wanted, edges = {}, {}
    for c in columns:
        if not counts[c]:
            continue
        for i, p in enumerate(probabilities):
            position = p * (counts[c] - 1)
            for rank in {floor(position), ceil(position)}:
                wanted[(c, rank)] = (None, None, 0, counts[c])
                edges[(c, rank)] = (start[f"{c}_s"][2 * i], start[f"{c}_s"][2 * i + 1])
    found = _select_ranks(numeric, wanted, edges, accuracy)
    for c in columns:
        if not counts[c]:
            continue
        for p in probabilities:
            position = p * (counts[c] - 1)
            low, high = found[(c, floor(position))], found[(c, ceil(position))]
            result[c][p] = low + (high - low) * (position - floor(position))
    return result


def _inside(column: str, bracket: tuple) -> Column:
    low, high = bracket[0], bracket[1]
    condition = F.col(column).isNotNull()
    if low is not None:
        condition = condition & (F.col(column) >= low)
    if high is not None:
        condition = condition & (F.col(column) <= high)
    return condition


def _sketch_edges(df: DataFrame, brackets: dict, accuracy: int) -> dict:
    """A narrower bracket around each rank; ranks that share a bracket share one sketch."""
    shared: dict = {}
    for key, (low, high, below, inside) in brackets.items():
        share, slack = (key[1] - below) / max(inside - 1, 1), 2.0 / accuracy
        shared.setdefault((key[0], brackets[key]), []).append((key, [max(0.0, share - slack), min(1.0, share + slack)]))
    sketches = []
    for i, ((column, bracket), members) in enumerate(shared.items()):
        value = F.when(_inside(column, bracket), F.col(column))
        sketches.append(F.percentile_approx(value, F.lit([p for _, w in members for p in w]), accuracy).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    return {
        key: (row[f"s{i}"][2 * n], row[f"s{i}"][2 * n + 1])
        for i, members in enumerate(shared.values())
        for n, (key, _) in enumerate(members)
    }


def _select_ranks(df: DataFrame, wanted: dict, edges: dict, accuracy: int) -> dict:
    """Value at each (column, 0-based rank). A bracket is (low, high, rows below, rows inside)."""
    found: dict = {}
    open_ranks = dict(wanted)
    while open_ranks:
        keys = list(open_ranks)
        tallies = []
        for i, key in enumerate(keys):
            low, high = edges[key]
            tallies.append(F.count_if(F.col(key[0]) < low).alias(f"below{i}"))
            tallies.append(F.count_if((F.col(key[0]) >= low) & (F.col(key[0]) <= high)).alias(f"in{i}"))
        tally = df.agg(*tallies).first()
        small = {}
        for i, key in enumerate(keys):
            low, high = edges[key]
            below, inside = tally[f"below{i}"], tally[f"in{i}"]
            if not below <= key[1] < below + inside:
                # The sketch missed: a finer one of the same bracket follows, unless the bracket is small or its numbers
                # are too close together for a sketch of doubles; then it is ordered as it is.
                if open_ranks[key][3] <= SELECT_ROWS or accuracy > FINEST:
                    small[key] = open_ranks.pop(key)
            elif low == high:
                found[key] = low
                del open_ranks[key]
            elif inside <= SELECT_ROWS or inside == open_ranks[key][3]:
                small[key] = (low, high, below, inside)
                del open_ranks[key]
            else:
                open_ranks[key] = (low, high, below, inside)
        if small:
            found.update(_rank_in_brackets(df, small))
        if open_ranks:
            accuracy *= 2
            edges = _sketch_edges(df, open_ranks, accuracy)
    return found


def _rank_in_brackets(df: DataFrame, brackets: dict) -> dict:
    """Exact selection inside brackets that are small enough, equal values counted once."""
    keys = list(brackets)
    tagged = [
        F.when(_inside(key[0], brackets[key]), F.struct(F.lit(i).alias("slot"), F.col(key[0]).alias("v")))
        for i, key in enumerate(keys)
    ]
    anywhere = _inside(keys[0][0], brackets[keys[0]])
    for key in keys[1:]:
        anywhere = anywhere | _inside(key[0], brackets[key])
    counted = (
        df.where(anywhere)
        .select(F.explode(F.array_compact(F.array(*tagged))).alias("hit"))
        .groupBy("hit.slot", "hit.v")
        .agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("v"))
    target = F.element_at(F.array(*[F.lit(key[1] - brackets[key][2]).cast("bigint") for key in keys]), F.col("slot") + 1)
    hit = counted.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= target) & (target < F.col("upto")))
    return {keys[row["slot"]]: row["v"] for row in hit.select("slot", "v").collect()}
