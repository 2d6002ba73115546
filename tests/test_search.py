import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardlog.operators import learning as ml
from wardlog.operators.labels import REQUIRED_TRAINING

GRID = {"LogisticRegression": {"C": [1.0]}}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(60).withColumn("label", (F.col("id") % 2).cast("int"))
    uri = F.concat(F.lit("/Index.php?q="), F.when(F.col("label") == 1, "union select ").otherwise("water "), F.col("id") % 5)
    return rows.select(
        "id", "label", F.lit("GET").alias("method"), uri.alias("uri"), F.length(uri).alias("uri_len"), F.lit("x" * 500).alias("msg"),
        *[F.lit(0).alias(c) for c in {*ml.NUMERIC_FEATURES, "has_cve_2023_47271_upload", "has_cve_2023_47271_rce", *REQUIRED_TRAINING} - {"id", "label", "method", "uri", "uri_len"}],
    )


def test_folds_carry_what_models_read_and_tokens_are_cut_once(labelled, monkeypatch):
    stored, real = {}, ml.stage

    def watched(df, name, **how):
        stored.setdefault(name, []).append(df)
        return real(df, name, **how)

    monkeypatch.setattr(ml, "stage", watched)
    model, ranking = ml.model_search(labelled, ["id"], folds=2, grid=GRID)
    assert "msg" not in stored["folds"][0].columns
    assert "_tokens" in stored["folds"][0].columns
    plans = [df._jdf.queryExecution().analyzed().toString() for df in stored["vectors"]]
    assert all("AS _tokens#" not in plan for plan in plans)
    assert ranking.first()["roc_auc"] == 1.0
    assert ml.score_batch(model, labelled).where("prediction = label").count() == 60  # rows without tokens

    judged = ml.cross_validate(labelled, ["id"], folds=2, estimator=ml.booster(maxIter=2))
    assert "msg" not in stored["folds"][1].columns
    assert judged.columns == ["id", "fold", "label", "probability", "prediction"]
    assert judged.select("id").distinct().count() == judged.count() == 60


def test_stored_tokens_give_the_same_vectors(labelled):
    features = ml.fit_features(labelled)
    known = ml.uri_tokens().transform(labelled)
    again = ml.fit_features(known)
    shown = [
        {(r.id, *r.v) for r in ml.apply_features(f, df).select("id", vector_to_array("features").alias("v")).collect()}
        for f, df in ((features, labelled), (features, known))
    ]
    assert shown[0] == shown[1]
    assert sorted(features.stages[1].vocabulary) == sorted(again.stages[1].vocabulary)
    words = [dict(zip(f.stages[1].vocabulary, f.stages[2].getScalingVec())) for f in (features, again)]
    assert words[0] == words[1]
