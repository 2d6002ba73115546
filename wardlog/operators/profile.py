"""Data-quality and exploratory statistics. Column statistics take one pass and are then unpivoted."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlog.operators.attack import percent
from wardlog.operators.labels import distinct_rows
from wardlog.operators.ranking import exact_quantiles
from wardlog.session import stage

QUARTILES = [0.25, 0.5, 0.75]
PLACES = 6


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _unpivot(row: DataFrame, entries: list[tuple[str, list[Column]]], names: list[str]) -> DataFrame:
    """One-row statistics to one row per entry: `feature` and the named values."""
    items = [
        F.struct(F.lit(entry).alias("feature"), *[value.alias(name) for value, name in zip(values, names)])
        for entry, values in entries
    ]
    return row.select(F.inline(F.array(*items)))


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL count and share of the columns that have any."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [(c, [F.col(c), percent(F.col(c), F.col("_n"))]) for c in df.columns]
    return _unpivot(row, entries, ["missing_count", "missing_pct"]).where("missing_count > 0").orderBy(
        F.desc("missing_count"), "feature"
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows after the first of equal rows, and their share.

    Texts are grouped by their SHA-256, so long ones are not shuffled; counts combine map-side.
    """
    texts = set(text_columns(df))
    keys = [F.sha2(c, 256).alias(c) if c in texts else F.col(c) for c in df.columns]
    per_row = df.select(*keys).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")
    return per_row.agg(total.alias("total_rows"), (total - F.count("*")).alias("duplicate_rows")).withColumn(
        "duplicate_pct", percent(F.col("duplicate_rows"), F.col("total_rows"))
    )


def completeness(df: DataFrame) -> DataFrame:
    """Cells, NULL cells and the filled share."""
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total_nulls = nulls[0]
    for count in nulls[1:]:
        total_nulls = total_nulls + count
    return df.agg((F.count("*") * len(df.columns)).alias("total_cells"), total_nulls.alias("null_cells")).withColumn(
        "completeness_pct", percent(F.col("total_cells") - F.col("null_cells"), F.col("total_cells"))
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact linear quartiles, max per column."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, QUARTILES)
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double")
        aggregates += [
            F.count(c).alias(f"{c}_n"),
            F.avg(value).alias(f"{c}_mean"),
            F.stddev_samp(value).alias(f"{c}_std"),
            F.min(value).alias(f"{c}_min"),
            F.max(value).alias(f"{c}_max"),
        ]
    entries = [
        (
            c,
            [
                F.col(f"{c}_n"),
                F.round(f"{c}_mean", 4),
                F.round(f"{c}_std", 4),
                F.col(f"{c}_min"),
                *[F.round(F.lit(quartiles[c][q]).cast("double"), 4) for q in QUARTILES],
                F.col(f"{c}_max"),
            ],
        )
        for c in columns
    ]
    return _unpivot(df.agg(*aggregates), entries, ["n", "mean", "std", "min", "q1", "median", "q3", "max"])


def categorical_top10(df: DataFrame, columns: list[str] | None = None, top: int = 10) -> DataFrame:
    """Most frequent values per text column, ties by value; pruned per task before the shuffle."""
    columns = columns or text_columns(df)
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    counted = df.select(F.inline(items)).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    best = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("value"))
    return counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


def pearson(a: str, b: str) -> Column:
    """Correlation over complete pairs; NULL, not an error, for a constant column."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)))


def correlation_with_label(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Absolute correlation of every column with the label, strongest first."""
    row = df.agg(*[F.abs(pearson(c, label)).alias(c) for c in columns])
    return _unpivot(row, [(c, [F.round(c, PLACES)]) for c in columns], ["correlation"]).orderBy(
        F.desc_nulls_last("correlation"), "feature"
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All ordered pairs of columns; each unordered pair is computed once, all in one pass."""
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]
    row = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = []
    for a, b in pairs:
        value = F.round(F.col(f"{a}|{b}"), PLACES)
        for x, y in {(a, b), (b, a)}:
            items.append(F.struct(F.lit(x).alias("feature_1"), F.lit(y).alias("feature_2"), value.alias("correlation")))
    return row.select(F.inline(F.array(*items)))


def high_correlation_pairs(df: DataFrame, columns: list[str], limit: float = 0.9) -> DataFrame:
    """Unordered pairs with an absolute correlation above the limit."""
    position = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    pairs = correlation_matrix(df, columns).where(position[F.col("feature_1")] < position[F.col("feature_2")])
    return pairs.where(F.abs("correlation") > limit).orderBy(F.desc("correlation"), "feature_1", "feature_2")


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Per column: lower bound, upper bound, interquartile range."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    bounds = {}
    for c in columns:
        q1, q3 = quartiles[c][0.25], quartiles[c][0.75]
        if q1 is not None:
            bounds[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), q3 - q1)
    return bounds


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with values outside the 1.5 IQR fence: count, share, bounds."""
    bounds = iqr_bounds(df, columns)
    row = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(c) for c, (low, high, _) in bounds.items()],
    )
    entries = [
        (c, [F.col(c), percent(F.col(c), F.col("_n")), F.round(F.lit(low), 4), F.round(F.lit(high), 4)])
        for c, (low, high, _) in bounds.items()
    ]
    return _unpivot(row, entries, ["outliers", "outlier_pct", "lower_bound", "upper_bound"]).where("outliers > 0")


def flag_distribution(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and share of ones per flag."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) == 1).alias(c) for c in flags])
    return _unpivot(row, [(c, [F.col(c), percent(F.col(c), F.col("_n"))]) for c in flags], ["ones", "pct"])


def distinct_profile(df: DataFrame, top: int = 5) -> DataFrame:
    """Distinct addresses and URIs, the methods seen, and the most frequent URIs, as labelled rows.

    The three columns are counted in one grouping of (column, value) pairs, read once.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("source_ip", "uri", "method")])
    counts = stage(df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n")), "distinct-values")
    of = {c: counts.where(F.col("column") == c) for c in ("source_ip", "uri", "method")}

    def size(metric: str, column: str) -> DataFrame:
        number = F.count_if(F.col("value").isNotNull()).alias("n")
        return of[column].agg(number).select(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("value"), "n")

    best = of["uri"].orderBy(F.desc("n"), "value").limit(top)
    lists = [rows.select(F.lit(m).alias("metric"), "value", "n") for m, rows in (("method", of["method"]), ("top_uri", best))]
    return size("unique_source_ips", "source_ip").unionByName(size("unique_uris", "uri")).unionByName(lists[0]).unionByName(lists[1])


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts, shares, balance flag (classes differ by under 10 % of rows) in one row."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 0).alias("normal"),
        F.count_if(F.col(label) == 1).alias("attack"),
    ).select(
        "total",
        "normal",
        "attack",
        percent(F.col("normal"), F.col("total")).alias("normal_pct"),
        percent(F.col("attack"), F.col("total")).alias("attack_pct"),
        (F.abs(F.col("normal") - F.col("attack")) < F.col("total") * 0.1).alias("balanced"),
    )


def mutual_information(
    df: DataFrame, label: str, columns: list[str], binned: list[str] | None = None, bins: int = 10,
) -> DataFrame:
    """Discrete mutual information (nats) of each column with the label, strongest first.

    Columns named in `binned` are cut at their exact quantiles first; the others are used as they
    are; missing values are a cell of their own. Everything works on the contingency counts.
    """
    binned = binned or []
    cuts = exact_quantiles(df, binned, [i / bins for i in range(1, bins)]) if binned else {}
    items = []
    for c in columns:
        value = F.col(c).cast("double")
        if c in cuts:
            steps = [(value > edge).cast("double") for edge in cuts[c].values()]
            value = F.when(value.isNotNull(), F.aggregate(F.array(*steps), F.lit(0.0), lambda a, b: a + b))
        items.append(F.struct(F.lit(c).alias("feature"), F.coalesce(value, F.lit(float("nan"))).alias("value")))
    cells = (
        df.select(F.col(label).cast("double").alias("_y"), F.inline(F.array(*items)))
        .groupBy("feature", "value", "_y")
        .agg(F.count("*").cast("double").alias("n"))
    )
    by_value = cells.groupBy("feature", "value").agg(F.sum("n").alias("nx"))
    by_label = cells.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    totals = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    joined = cells.join(by_value, ["feature", "value"]).join(by_label, ["feature", "_y"]).join(totals, "feature")
    term = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return joined.groupBy("feature").agg(F.round(F.sum(term), PLACES).alias("mi_score")).orderBy(
        F.desc("mi_score"), "feature"
    )


def eda_clean(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Distinct rows, at least half filled, median and '' filled, inside every IQR fence, scaled.

    Columns named in `ids` pass through unscaled. Numeric columns become doubles scaled by the
    population deviation (a constant column scales by one).
    """
    ids = ids or []
    numeric = [c for c in numeric_columns(df) if c not in ids]
    text = [c for c in text_columns(df) if c not in ids]
    kept = stage(distinct_rows(df).dropna(thresh=int(len(df.columns) * 0.5)), "distinct")
    medians = exact_quantiles(kept, numeric, [0.5])
    filled = kept.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0.5]).cast("double")) for c in numeric},
            **{c: F.coalesce(F.col(c), F.lit("")) for c in text},
        }
    )
    inside = filled
    for c, (low, high, iqr) in iqr_bounds(filled, numeric).items():
        if iqr != 0:
            inside = inside.where(F.col(c).between(low, high))
    stats = inside.agg(*[f(c).alias(f"{c}_{n}") for c in numeric for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    scaled = {
        c: (F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] or 1.0) for c in numeric if stats[f"{c}_m"] is not None
    }
    return inside.withColumns(scaled) if scaled else inside
