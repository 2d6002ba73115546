"""Splits, weights and classification metrics as counts, shares and hash ranks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.operators.ranking import hash_cut, hash_key, hash_rank, running_totals
from wardlog.session import stage

PLACES = 6
CVE_WEIGHT = 10.0
#: Labels up to which the cuts of a split go to every task; more are joined by a shuffle.
FEW_LABELS = 100_000


def stratified_split(df: DataFrame, ids: list[str], label: str = "label", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split` (train/test): per label the first ceil(test_size * n) rows in hash order are test.

    NULL is a label of its own. The cut of each label is found first; the rows themselves are not moved: joined by a
    shuffle, all rows of a label would meet in one task.
    """
    cuts = hash_cut(df, ids, [label], F.ceil(F.round(F.col("stratum_size") * test_size, 9)), seed)
    cuts = stage(cuts.select(F.col(label).alias("_label"), "_cut"), "cuts")
    if cuts.count() <= FEW_LABELS:
        cuts = F.broadcast(cuts)
    test = F.struct(hash_key(seed, *ids).alias("_hash"), *ids) <= F.col("_cut")
    split = F.when(F.coalesce(test, F.lit(False)), F.lit("test")).otherwise(F.lit("train"))
    return df.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left").select(*df.columns, split.alias("split"))


def approx_split(df: DataFrame, ids: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split` by hash threshold alone: no shuffle, shares right on average."""
    prefix = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])), F.lit(8)), 16, 10)
    test = prefix.cast("double") / float(16**8) < test_size
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def stratified_folds(df: DataFrame, ids: list[str], label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold` 0..folds-1: rows of each label dealt out in hash order."""
    ranked = hash_rank(df, ids, [label], seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "stratum_size")


def shuffle_splits(
    df: DataFrame, ids: list[str], label: str = "label", repeats: int = 5, test_size: float = 0.2, seed: int = 42
) -> list[DataFrame]:
    """Repeated stratified splits, one seed each."""
    return [stratified_split(df, ids, label, test_size, seed + i) for i in range(repeats)]


def cve_sample_weight(label: Column) -> Column:
    """10 for attacks with a 2023 upload signature, else 1."""
    hit = (F.col("has_cve_2023_47271_upload") == 1) | (F.col("has_cve_2023_47271_rce") == 1)
    return F.when(F.coalesce(hit, F.lit(False)) & (label == 1), F.lit(CVE_WEIGHT)).otherwise(F.lit(1.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """TN, FP, FN, TP in one row (per group)."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _rates(confusion: DataFrame, extra: list[str]) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion.select(
        *extra,
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties at half, as one row (per group).

    Rows are first counted per distinct score; the positives below each score come from range
    totals, so neither one score nor one class has to fit in a task.
    """
    by = by or []
    y = F.col(label)
    per_score = df.groupBy(*by, score).agg(
        F.count_if(y == 1).cast("double").alias("pos"), F.count_if(y == 0).cast("double").alias("neg")
    )
    ranked = running_totals(per_score, score, ["neg"], by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "probability") -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and ROC-AUC in one row."""
    rates = _rates(confusion_matrix(df, label, prediction), [])
    auc = roc_auc(df, label, score).scalar()
    return rates.select(
        *[F.round(c, PLACES).alias(c) for c in ("accuracy", "precision", "recall", "f1")], F.round(auc, PLACES).alias("roc_auc")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def entry(name: str, hit: Column, predicted: Column, actual: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            _ratio(hit, predicted).alias("precision"),
            _ratio(hit, actual).alias("recall"),
            _ratio(2 * hit, predicted + actual).alias("f1"),
            actual.alias("support"),
        )

    classes = confusion_matrix(df, label, prediction).select(
        F.array(entry("0", tn, tn + fn, tn + fp), entry("1", tp, tp + fp, tp + fn)).alias("c")
    )

    def average(name: str, weighted: bool) -> Column:
        zero, one = F.col("c")[0], F.col("c")[1]
        support = zero["support"] + one["support"]

        def mean(metric: str) -> Column:
            if weighted:
                return _ratio(zero[metric] * zero["support"] + one[metric] * one["support"], support)
            return (zero[metric] + one[metric]) / 2

        return F.struct(
            F.lit(name).alias("class"), *[mean(m).alias(m) for m in ("precision", "recall", "f1")], support.alias("support")
        )

    rows = F.array_append(F.array_append(F.col("c"), average("macro avg", False)), average("weighted avg", True))
    return classes.select(F.inline(rows)).select(
        "class", *[F.round(m, PLACES).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def fold_metrics(df: DataFrame, fold: str = "fold") -> DataFrame:
    """The five metrics of every fold."""
    rates = _rates(confusion_matrix(df, by=[fold]), [fold])
    return rates.join(roc_auc(df, by=[fold]), fold)


def cv_metrics(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population deviation of every metric over folds."""
    per_fold = fold_metrics(df, fold)
    names = ["accuracy", "f1", "precision", "recall", "roc_auc"]
    row = per_fold.agg(*[f(n).alias(f"{n}_{k}") for n in names for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    items = [
        F.struct(F.lit(n).alias("metric"), F.round(f"{n}_mean", PLACES).alias("mean"), F.round(f"{n}_std", PLACES).alias("std"))
        for n in names
    ]
    return row.select(F.inline(F.array(*items)))


def first_of(document: object, keys: list[str]) -> object:
    """The first value under one of the keys, from outside in and in document order; nulls don't count.

    An object that has one of the keys is not searched further.
    """
    waiting = [document]
    while waiting:
        item = waiting.pop()
        if isinstance(item, dict):
            named = next((k for k in keys if k in item), None)
            if named is not None:
                if item[named] is not None:
                    return item[named]
                continue
            item = list(item.values())
        if isinstance(item, list):
            waiting.extend(reversed(item))
    return None


def metric_value(document: Column, *keys: str) -> Column:
    """A metric out of nested metric JSON, NULL where it is absent, no number, or the text is no JSON."""

    @F.pandas_udf("double")
    def look_up(texts: pd.Series) -> pd.Series:
        def value(text: str | None) -> float | None:
            try:
                found = first_of(json.loads(text), list(keys)) if text else None
                return None if found is None else float(found)
            except (ValueError, TypeError):
                return None

        return texts.map(value).astype("float64")

    return look_up(document)
