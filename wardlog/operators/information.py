"""Nearest-neighbour mutual information of numeric features with a class label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.operators.ranking import running_totals
from wardlog.session import stage

PLACES = 6
#: Distinct values of one feature and class that are ordered together when neighbours are looked up.
BLOCK = 8192
#: Steps by which the argument of the digamma series is raised.
RAISED = 8


def digamma(x: Column) -> Column:
    """Digamma of a positive number by its asymptotic series, exact to about 1e-12."""
    s = x + RAISED
    square = 1 / (s * s)
    tail = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square / 240)))
    return F.ln(s) - 1 / (2 * s) - tail - sum((1 / (x + i) for i in range(1, RAISED)), 1 / x)


def _cells(df: DataFrame, label: str, columns: list[str], missing: float | None) -> DataFrame:
    """Rows per (feature, class, value), with the size of the class; classes of one row are left out."""
    items = []
    for c in columns:
        value = F.col(c).cast("double")
        value = F.when(F.abs(value) < float("inf"), value)
        value = value if missing is None else F.coalesce(value, F.lit(float(missing)))
        items.append(F.struct(F.lit(c).alias("feature"), value.alias("value")))
    rows = df.select(F.col(label).cast("string").alias("class"), F.inline(F.array(*items)))
    cells = rows.where("class IS NOT NULL AND value IS NOT NULL").groupBy("feature", "class", "value").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("feature", "class").agg(F.sum("n").alias("size"))
    return cells.join(sizes.where("size > 1"), ["feature", "class"])


def _radii(cells: DataFrame, k: int) -> DataFrame:
    """Adds `k` and `near`: distance and value of the k-th neighbour within the class.

    Values of a class are cut by position into blocks; the k values at either border also go to the next block, so each
    value finds k others on both sides, wherever there are so many.
    """
    width = max(BLOCK, k)
    placed = running_totals(cells.withColumn("one", F.lit(1)), "value", ["one"], ["feature", "class"])
    at = F.col("one_before").cast("long")
    block, place = F.floor(at / width), at % width
    copies = F.array_compact(F.array(block, F.when(place < k, block - 1), F.when(place >= width - k, block + 1)))
    spread = placed.select("feature", "class", "value", "n", "size", F.posexplode(copies).alias("copy", "block"))
    around = Window.partitionBy("feature", "class", "block").orderBy("value").rowsBetween(-k, k)
    others = spread.withColumn("around", F.collect_list(F.struct("value", "n")).over(around)).where("copy = 0")
    nearest = F.array_sort(
        F.transform("around", lambda o: F.struct(F.abs(o["value"] - F.col("value")).alias("d"), o["value"].alias("v"), o["n"].alias("n")))
    )
    wanted = F.least(F.lit(k), F.col("size") - 1)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d"), F.lit(0.0).alias("v"))
    # The row itself is the first of those at distance 0.
    reach = F.aggregate(
        nearest,
        start,
        lambda a, o: F.when(a["seen"] > wanted, a).otherwise(
            F.struct((a["seen"] + o["n"]).alias("seen"), o["d"].alias("d"), o["v"].alias("v"))
        ),
    )
    return others.select("feature", "class", "value", "n", "size", wanted.alias("k"), reach.alias("near"))


def neighbour_information(df: DataFrame, label: str, columns: list[str], k: int = 3, missing: float | None = 0.0) -> DataFrame:
    """Mutual information (nats) of each numeric column with the label from k-th neighbour distances, strongest first.

    For a row of a class, d is the distance to its k-th neighbour in the class (to the last one in classes of k rows or
    fewer) and m the number of rows of any class, itself included, strictly nearer than d; where d is 0, m counts the equal rows. The estimate is
    psi(N) + avg(psi(k)) - avg(psi(class size)) - avg(psi(m)), at least 0. No noise is added, so results repeat; columns of
    few values, where most distances are 0, are better served by `mutual_information`.

    Rows without a label and classes of one row take no part. NULL, NaN and infinite values become `missing`; with None
    the row takes no part for that column. A column without any usable row has no result row. Equal values of a class are
    one row with a count, and both the order within a class and the counts below a bound come from ranges of values, so no
    class or column is sorted in one task.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    names = {c: f"f{i}" for i, c in enumerate(dict.fromkeys(columns))}
    narrow = df.select(F.col(label).alias("y"), *[F.col(c).alias(name) for c, name in names.items()])
    cells = stage(_cells(narrow, "y", list(names.values()), missing), "value-cells")
    empty = narrow.sparkSession.createDataFrame([], "feature string, mi_score double")
    if cells.isEmpty():
        return empty
    d, v, x = F.col("near.d"), F.col("near.v"), F.col("value")
    upper = F.when(d == 0, x).when(v > x, v).otherwise(x + d)
    lower = F.when(d == 0, x).when(v < x, v).otherwise(x - d)
    # Rows below the upper bound minus rows up to the lower one; equal rows alone where the distance is 0.
    sides = F.array(
        F.struct(upper.alias("bound"), F.lit(1).alias("sign"), (d == 0).alias("closed")),
        F.struct(lower.alias("bound"), F.lit(-1).alias("sign"), (d > 0).alias("closed")),
    )
    bounds = stage(_radii(cells, k).select("feature", "class", "value", "n", "size", "k", F.inline(sides)), "value-bounds")
    marks = cells.select("feature", F.col("value").alias("bound"), F.col("n").alias("here"))
    marks = marks.unionByName(bounds.select("feature", "bound", F.lit(0).cast("long").alias("here")))
    marks = stage(marks.groupBy("feature", "bound").agg(F.sum("here").alias("here")), "value-marks")
    below = running_totals(marks, "bound", ["here"], ["feature"])
    inside = F.col("sign") * (F.col("here_before") + F.when(F.col("closed"), F.col("here")).otherwise(0))
    counted = bounds.join(below, ["feature", "bound"]).groupBy("feature", "class", "value", "n", "size", "k").agg(F.sum(inside).alias("m"))
    term = F.col("n") * (digamma(F.col("k")) - digamma(F.col("size")) - digamma(F.col("m")))
    totals = counted.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(term).alias("terms"))
    score = F.round(F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("terms") / F.col("rows")), PLACES)
    given = F.create_map(*[F.lit(t) for c, name in names.items() for t in (name, c)])
    return totals.select(given[F.col("feature")].alias("feature"), (score + 0.0).alias("mi_score")).orderBy(F.desc("mi_score"), "feature")
