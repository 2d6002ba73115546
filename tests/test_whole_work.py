"""The registered training queries do the whole job: no sample of the rows, no short settings."""

import pytest
from pyspark.sql import functions as F

from wardlog.operators.labels import REQUIRED_TRAINING
from wardlog.plans import q_learning as q


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(60).withColumn("label", (F.col("id") % 2).cast("int"))
    uri = F.concat(F.lit("/Index.php?q="), F.when(F.col("label") == 1, "union select ").otherwise("water "), F.col("id") % 5)
    none = {*q.ml.NUMERIC_FEATURES, "has_cve_2023_47271_upload", "has_cve_2023_47271_rce", *REQUIRED_TRAINING} - {"id", "label", "method", "uri", "uri_len"}
    return rows.select("id", "label", F.lit("GET").alias("method"), uri.alias("uri"), F.length(uri).alias("uri_len"), *[F.lit(0).alias(c) for c in none])


def test_shared_model_is_fitted_on_the_whole_training_part(spark, monkeypatch):
    fitted = []
    rows = spark.range(26_000).select(F.col("id").alias("event_id"), F.when(F.col("id") < 25_000, "train").otherwise("test").alias("split"))
    monkeypatch.setattr(q, "_MODELS", {})
    monkeypatch.setattr(q, "split_rows", lambda *_: rows)
    monkeypatch.setattr(q.ml, "train_attack_model", lambda df: fitted.append((df.count(), df.agg(F.max("event_id")).first()[0])))
    q.shared_model(spark, "anywhere")
    assert fitted == [(25_000, 24_999)]


def test_importance_is_that_of_the_whole_training_part(spark, monkeypatch):
    ranked = []
    rows = spark.range(26_000).select(F.col("id").alias("event_id"), F.when(F.col("id") < 25_000, "train").otherwise("test").alias("split"))
    monkeypatch.setattr(q, "_MODELS", {})
    monkeypatch.setattr(q, "split_rows", lambda *_: rows)
    monkeypatch.setattr(q.ml, "train_attack_model", lambda df: df.count())
    monkeypatch.setattr(q.ml, "feature_importance", lambda model, df: ranked.append((model, df.count())) or spark.createDataFrame([("a", 0.6), ("b", 0.4)], "feature string, importance double"))
    assert q.importance_query(spark, "anywhere").first().asDict() == {"features": 2, "ranked": True}
    assert ranked == [(25_000, 26_000)]


def test_hyperparameter_search_draws_the_whole_space(spark, labelled, monkeypatch):
    fitted, best = [], []

    def areas(rows, held, candidates, parallelism):
        fitted.append(candidates)
        return [0.5 + 0.4 * (i == 7) + i / 1000 for i in range(len(candidates))]

    def fit(rows, settings):
        best.append(settings)
        return q.ml.bo.NewtonModel([], [], [])

    rows = labelled.withColumnRenamed("id", "event_id").withColumn("split", F.lit("all"))
    monkeypatch.setattr(q.ml.bo, "areas", areas)
    monkeypatch.setattr(q.ml.bo, "fit", fit)
    monkeypatch.setattr(q, "split_rows", lambda *_: rows)
    assert q.hyper_query(spark, "anywhere").first()["candidates"] == 25
    assert [len(c) for c in fitted] == [25] * 5 and all(c == fitted[0] for c in fitted)
    assert best == [fitted[0][7]]
    assert max(c.rounds for c in fitted[0]) > 800 and min(c.rounds for c in fitted[0]) >= 100
    assert {c.depth for c in fitted[0]} >= {3, 12} and max(c.gamma for c in fitted[0]) > 8
    assert max(c.l1 for c in fitted[0]) > 1 and min(c.l1 for c in fitted[0]) < 1e-5 and len({c.l2 for c in fitted[0]}) == 25


def test_the_best_second_order_trees_score_like_a_model(spark, labelled):
    space = {**q.ml.SEARCH_SPACE, "maxIter": (4, 8, 2), "maxDepth": (2, 3), "stepSize": (0.2, 0.3), "minInfoGain": (0.0, 0.1), "regAlpha": (1e-8, 1e-6), "regLambda": (0.1, 1.0), "minInstancesPerNode": (1, 2)}
    model, ranking = q.ml.hyperparameter_search(labelled, ["id"], trials=3, folds=2, space=space)
    assert ranking.count() == 3 and ranking.first()["roc_auc"] == 1.0
    hits = {r.id: r.prediction for r in q.ml.score_batch(model, labelled).collect()}
    assert all(hits[i] == i % 2 for i in range(60))
    shares = {r.feature: r.importance for r in q.ml.feature_importance(model, labelled).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and all(name.startswith("uri") for name in shares)


def test_model_search_fits_the_whole_grid(spark, labelled, monkeypatch):
    fitted, real = [], q.ml._fold_scores

    def scores(rows, folds, candidates, parallelism, smote):
        fitted.append((folds, [c[0] for c in candidates]))
        return real(rows, folds, candidates[:1], parallelism, smote) + [0.25] * (len(candidates) - 1)

    monkeypatch.setattr(q.ml, "_fold_scores", scores)
    monkeypatch.setattr(q, "split_rows", lambda *_: labelled.withColumnRenamed("id", "event_id").withColumn("split", F.lit("all")))
    assert q.model_search_query(spark, "anywhere").first().asDict() == {"candidates": 23, "valid": True}
    ((folds, names),) = fitted
    assert folds == 5 and len(names) == 23
    assert "RandomForestClassifier(numTrees=200, maxDepth=30, minInstancesPerNode=3)" in names
    assert "GBTClassifier(maxIter=200, maxDepth=6, stepSize=0.1)" in names


def test_search_over_all_families_gives_a_model(spark, labelled):
    grid = {"LogisticRegression": {"C": [0.1]}, "RandomForestClassifier": {"numTrees": [9], "maxDepth": [30], "minInstancesPerNode": [1]}, "GBTClassifier": {"maxIter": [6], "maxDepth": [3], "stepSize": [0.3]}}
    model, ranking = q.ml.model_search(labelled, ["id"], folds=2, grid=grid)
    assert ranking.count() == 3 and ranking.first()["roc_auc"] == 1.0
    for family in list(grid)[1:]:
        model, _ = q.ml.model_search(labelled, ["id"], folds=2, grid={family: grid[family]})
        assert isinstance(model.stages[-1], q.ml.NewtonTreesModel)
        assert all(r.prediction == r.id % 2 for r in q.ml.score_batch(model, labelled).collect())


def test_the_model_counts_every_row_in_a_task_and_over_the_table(spark, labelled, monkeypatch):
    rows = labelled.union(labelled.where("id % 3 = 0")).withColumn("label", F.when(F.col("id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    settings = {"maxIter": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "stepSize": 0.3}
    one = q.ml.train_attack_model(rows, **settings)
    monkeypatch.setattr(q.ml.bo, "TASK_CELLS", 0)
    other = q.ml.train_attack_model(rows, **settings)
    shown = [{r.id: r.probability for r in q.ml.score_batch(m, labelled).select("id", "probability").collect()} for m in (one, other)]
    assert len(one.stages[-1].model.trees) == 3 and isinstance(one.stages[-1].model.trees[0], q.ml.bo.PackedTree)
    assert len(set(shown[0].values())) > 1 and all(abs(shown[0][i] - shown[1][i]) < 1e-9 for i in range(60))
