"""Order, rank, metric and learning operators against brute force on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlog.operators import joins as jn
from wardlog.operators import labels as lb
from wardlog.operators import learning as ml
from wardlog.operators import metrics as mt
from wardlog.operators import neighbours as nb
from wardlog.operators import profile as pf
from wardlog.operators import ranking as rk
from wardlog.operators import reports as rp
from wardlog.operators.cooldown import alert_cooldown


def greedy(rows, gap):
    kept, last = [], {}
    for key, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or us - last[key] >= gap:
            kept.append(i)
            last[key] = us
    return sorted(kept)


@pytest.mark.parametrize(
    "count,span_ms,grid_ms,segment_rows",
    [(2000, 2_000_000, 1, 40), (2000, 300_000, 1, 200), (1500, 900_000, 1000, 3), (300, 20_000_000, 250, 1), (500, 100_000, 1, 1_000_000)],
)
def test_cooldown_is_exact(spark, count, span_ms, grid_ms, segment_rows):
    rng = np.random.default_rng(count)
    us = (rng.integers(0, span_ms, count) // grid_ms) * grid_ms * 1000
    pdf = pd.DataFrame({"id": np.arange(count), "us": us, "k": np.where(rng.random(count) < 0.5, "hot", rng.integers(0, 4, count).astype(str))})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us"))
    rows = list(pdf[["k", "us", "id"]].itertuples(index=False, name=None))
    got = sorted(r.id for r in alert_cooldown(df, "ts", ["id"], "k", 10, segment_rows).collect())
    assert got == greedy(rows, 10_000_000)


def test_cooldown_keeps_first_of_equal_instants(spark):
    df = spark.range(9).select("id", F.timestamp_seconds(F.floor(F.col("id") / 3) * 6).alias("ts"), F.lit("x").alias("other"))
    rows = alert_cooldown(df.orderBy(F.desc("id")), "ts", ["id"], None, 10).collect()
    assert sorted((r.id, r.other) for r in rows) == [(0, "x"), (6, "x")]


def test_global_cooldown_and_row_order(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(800), "us": rng.integers(0, 400_000_000, 800)})
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("ts", F.timestamp_micros("us"))
    got = sorted(r.id for r in alert_cooldown(df, "ts", ["id"], None, 10, 20).collect())
    assert got == greedy([("", u, i) for i, u in pdf.itertuples(index=False)], 10_000_000)
    assert alert_cooldown(df.where("id < 0"), "ts", ["id"]).count() == 0


@pytest.mark.parametrize("select_rows", [10, 100, 1_000_000])
def test_exact_quantiles(spark, select_rows, monkeypatch):
    monkeypatch.setattr(rk, "SELECT_ROWS", select_rows)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=4000), "b": np.where(rng.random(4000) < 0.4, 7.0, rng.integers(0, 50, 4000)), "c": np.exp(rng.normal(size=4000) * 9)})
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(pdf).withColumn("n", F.lit(None).cast("double"))
    got = rk.exact_quantiles(df, ["a", "b", "c", "n"], probabilities, accuracy=200)
    for c in "abc":
        assert np.allclose([got[c][p] for p in probabilities], np.quantile(pdf[c], probabilities), rtol=1e-12)
    assert list(got["n"].values()) == [None] * 5


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    rows = rk.hash_rank(df, ["id"], ["label"]).collect()
    for label, n in (("a", 1000), ("b", 2000)):
        assert sorted(r["rank"] for r in rows if r.label == label) == list(range(1, n + 1))
        assert {r.stratum_size for r in rows if r.label == label} == {n}


def test_row_range(spark):
    df = spark.range(0, 5000, 7).orderBy(F.rand(1))
    for select_rows in (5, 100, 1_000_000):
        rk.SELECT_ROWS = select_rows
        assert sorted(r.id for r in rk.row_range(df, "id", 3, 11).collect()) == [7 * i for i in range(2, 11)]
    assert rk.row_range(df, "id", 700, 9999).count() == 715 - 699
    assert rk.row_range(df, "id", 9000, 9999).count() == 0
    far = spark.range(50).select((F.col("id") + 2**62).alias("id"))
    assert sorted(r.id - 2**62 for r in rk.row_range(far, "id", 10, 12).collect()) == [9, 10, 11]
    with pytest.raises(ValueError):
        rk.row_range(df, "id", 0, 3)


def test_split_and_folds_partition_the_rows(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    split = mt.stratified_split(df, ["id"]).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in split} == {(0, "test"): 161, (0, "train"): 641, (1, "test"): 41, (1, "train"): 160}
    folds = mt.stratified_folds(df, ["id"], folds=5).groupBy("fold", "label").count().collect()
    sizes = {(r.fold, r.label): r["count"] for r in folds}
    assert sum(sizes.values()) == 1003 and all(abs(sizes[f, 1] - 201 / 5) <= 1 for f in range(5))
    a = mt.stratified_split(df.repartition(1), ["id"]).where("split = 'test'").select("id")
    b = mt.stratified_split(df.repartition(7), ["id"]).where("split = 'test'").select("id")
    assert a.exceptAll(b).count() == 0
    assert 100 < mt.approx_split(df, ["id"]).where("split = 'test'").count() < 300


def test_auc_with_ties(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 500), "probability": np.round(rng.random(500), 1), "g": rng.integers(0, 2, 500)})
    df = spark.createDataFrame(pdf)

    def brute(part):
        pos, neg = part.probability[part.label == 1].to_numpy(), part.probability[part.label == 0].to_numpy()
        return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))

    assert mt.roc_auc(df).first().roc_auc == pytest.approx(brute(pdf))
    for row in mt.roc_auc(df, by=["g"]).collect():
        assert row.roc_auc == pytest.approx(brute(pdf[pdf.g == row.g]))
    assert mt.roc_auc(df.where("label = 1")).first().roc_auc is None


def test_metrics_without_positives(rows_of):
    df = rows_of([(0, 0, 0.1), (0, 0, 0.2), (1, 0, 0.3)], "label int, prediction int, probability double")
    assert mt.classification_metrics(df).first().asDict() == {"accuracy": 0.666667, "precision": 0.0, "recall": 0.0, "f1": 0.0, "roc_auc": 1.0}
    report = {r["class"]: r for r in mt.classification_report(df).collect()}
    assert report["weighted avg"].support == 3 and report["0"].recall == 1.0


def test_constant_column_has_no_correlation(rows_of):
    df = rows_of([(1.0, 2.0, 0), (1.0, 3.0, 1), (1.0, None, 1)], "a double, b double, y int")
    got = {r.feature: r.correlation for r in pf.correlation_with_label(df, "y", ["a", "b"]).collect()}
    assert got == {"a": None, "b": 1.0}


def test_eda_clean_against_pandas(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.normal(size=400), "b": rng.exponential(size=400), "z": 1.0, "t": rng.choice(["x", None], 400)})
    pdf.loc[rng.integers(0, 400, 40), "a"] = np.nan
    pdf = pd.concat([pdf, pdf.iloc[:50]], ignore_index=True)
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abz"], "t")
    want = pdf.drop_duplicates().dropna(thresh=2)
    for c in "abz":
        want[c] = want[c].fillna(want[c].median())
    keep = pd.Series(True, index=want.index)
    for c in "ab":
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        keep &= want[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    want = want[keep]
    for c in "ab":
        want[c] = (want[c] - want[c].mean()) / want[c].std(ddof=0)
    got = pf.eda_clean(df).toPandas()
    assert len(got) == len(want) and set(got.t) == {"x", ""} and set(got.z) == {0.0}
    for c in "ab":
        assert np.allclose(np.sort(got[c]), np.sort(want[c]))


def test_feedback_last_click_wins(rows_of):
    events = rows_of([(1, 10), (2, 11), (3, None)], "event_id int, attack_event_id int")
    clicks = rows_of(
        [(10, 1, dt.datetime(2026, 1, 1), "attack_no"), (10, 2, dt.datetime(2026, 1, 2), "attack_yes"), (11, 3, dt.datetime(2026, 1, 1), "attack_yes"), (11, 4, dt.datetime(2026, 1, 1), "attack_no")],
        "attack_event_id int, click_id int, clicked_at timestamp, action string",
    )
    rows = {r.event_id: r for r in jn.apply_feedback(events, clicks).collect()}
    assert (rows[1].assessment, rows[1].human_label) == ("yes", None)
    assert (rows[2].assessment, rows[2].human_label, rows[2].label_source) == ("no", 0, "telegram")
    assert (rows[3].assessment, rows[3].labeled_at) == (None, None)


def test_audience_edges(rows_of):
    alerts = rows_of([(1, 0.5), (2, 0.4999), (3, 1.0), (4, 0.95)], "attack_event_id int, probability double")
    users = rows_of(
        [(1, "a", None, None, True), (2, "b", 1.0, True, True), (3, "c", 0.95, False, True), (4, "d", 0.1, True, False), (5, "e", 0.95, True, True)],
        "telegram_chat_id int, email string, min_probability double, is_subscribed boolean, verified boolean",
    )
    got = sorted((r.attack_event_id, r.telegram_chat_id) for r in jn.alert_audience(alerts, users).collect())
    assert got == [(1, 1), (3, 1), (3, 2), (3, 5), (4, 1), (4, 5)]
    assert [r.attack_event_id for r in jn.alerts_without_audience(alerts, users).collect()] == [2]
    assert jn.alerts_without_audience(alerts, users.where("false")).count() == 4


def test_gate(rows_of):
    alerts = rows_of([(1,)], "id int")
    for value, passed in (("1", 0), ("0", 1), ("x", 1)):
        assert jn.notification_gate(alerts, rows_of([(jn.PAUSE_KEY, value)], "state_key string, state_value string")).count() == passed
    assert jn.notification_gate(alerts, rows_of([("other", "1")], "state_key string, state_value string")).count() == 1


def test_versions_and_empty_history(spark, rows_of):
    versions = rows_of([(1, 0.9, 0.8), (2, 0.95, 0.7)], "version int, accuracy double, f1_score double")
    row = jn.compare_versions(versions, 1, 2).first()
    assert (row.accuracy_gain, row.f1_score_gain) == (0.05, -0.1)
    assert jn.compare_versions(versions, 1, 3).count() == 0
    empty = rows_of([], "id int, detected_at timestamp, attack_type string, attacker_ip string, probability double, attack_url string")
    row = rp.status_metrics(empty, empty).first()
    assert (row.overall_logs, row.attack_logs, row.most_attack_type, row.attacks_today) == (0, 0, "N/A", 0)


def test_window_counts_as_of(rows_of):
    at = [dt.datetime(2026, 5, 31, 10), dt.datetime(2026, 5, 31, 0), dt.datetime(2026, 5, 30, 23), dt.datetime(2026, 5, 24, 10), dt.datetime(2026, 5, 24, 9), dt.datetime(2026, 4, 1)]
    df = rows_of([(t,) for t in at], "detected_at timestamp")
    row = rp.attack_window_counts(df, F.lit("2026-05-31 10:00:00").cast("timestamp")).first()
    assert tuple(row) == (6, 2, 4, 5)


def test_merge_matches_columns_by_name(rows_of):
    old = rows_of([("Tue May  5 04:12:06 2026", True, 1), ("Tue May  5 04:12:06 2026", True, 1)], "timestamp string, is_blocked boolean, label int")
    new = rows_of([(9, 1, 1, "2026-05-05 04:12:06"), (9, 0, 0, "2026-05-06 00:00:00")], "model_prediction int, label int, is_blocked int, timestamp string")
    rows = lb.merge_datasets(old, new).collect()
    assert sorted((str(r.timestamp), r.is_blocked, r.label) for r in rows) == [("2026-05-05 04:12:06", True, 1), ("2026-05-06 00:00:00", False, 0)]


def test_export_modes(rows_of):
    with pytest.raises(ValueError):
        lb.export_first_n(rows_of([(1,)], "id int"), 0)
    with pytest.raises(ValueError):
        lb.harmonize_training_columns(rows_of([(1,)], "uri int"))


@pytest.mark.parametrize("block_rows", [2000, 60])
def test_smote_balances_with_convex_rows(spark, block_rows):
    rng = np.random.default_rng(2)
    minority = np.vstack([rng.normal(size=(150, 2)), np.tile([[5.0, 5.0]], (60, 1))])
    rows = [(Vectors.dense(p.tolist()), 1) for p in minority] + [(Vectors.dense([float(i), 0.0]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, ["features", "label"])
    grown = ml.smote_oversample(df, block_rows=block_rows).toPandas()
    made = np.stack(grown.v[grown.synthetic].to_numpy())
    assert grown.groupby("label").size().to_dict() == {0: 900, 1: 900}
    low, high = minority.min(axis=0) - 1e-9, minority.max(axis=0) + 1e-9
    assert ((made >= low) & (made <= high)).all()
    # A third of the minority are copies of one row; their children are copies too.
    same = (np.abs(made - 5.0) < 1e-12).all(axis=1).sum()
    assert same == pytest.approx(690 * 60 / 210, abs=25)
    again = ml.smote_oversample(df.repartition(3), block_rows=block_rows).toPandas()
    assert np.allclose(np.sort(made[:, 0]), np.sort(np.stack(again.v[again.synthetic].to_numpy())[:, 0]))


def plain_nearest(points, names, k):
    """Names and squared distances of the k nearest of each point, ties to the smaller name."""
    found = {}
    for i, p in enumerate(points):
        squares = ((points - p) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((names, squares)) if j != i][:k]
        found[names[i]] = [(names[j], float(squares[j])) for j in order]
    return found


def clustered(rng, n, dims):
    """Clusters of very different size and width, and a dense grid with many ties."""
    centres = rng.normal(scale=30, size=(6, dims))
    parts = [centres[i] + rng.normal(scale=0.1 * 3**i, size=(n // 2 if i == 0 else n // 12, dims)) for i in range(6)]
    return np.unique(np.vstack([*parts, rng.integers(0, 3, size=(n // 12, dims)).astype(float)]), axis=0)


@pytest.mark.parametrize("n,dims,k,block_rows", [(80, 3, 4, 2000), (80, 3, 200, 7), (900, 1, 5, 60), (2600, 300, 5, 800), (1, 2, 5, 10), (2, 2, 5, 1)])
def test_nearest_vectors_are_exact(spark, n, dims, k, block_rows):
    points = clustered(np.random.default_rng(n + dims), n, dims) if n > 10 else np.arange(n * dims, dtype=float).reshape(n, dims)
    names = np.array([f"v{i * 7919 % 100003:06d}" for i in range(len(points))])
    df = spark.createDataFrame([(v, p.tolist()) for v, p in zip(names.tolist(), points)], "vid string, v array<double>")
    got = {name: [] for name in names.tolist()}
    for r in nb.nearest_vectors(df, k, block_rows).collect():
        got[r.vid].append((r.distance, r.near))
    want = plain_nearest(points, names, k)
    assert {v: [(name, d) for d, name in sorted(rows)] for v, rows in got.items()} == want


@pytest.mark.parametrize("dims", [2, 300])
def test_synthetic_rows_lie_between_true_neighbours(spark, dims):
    rng = np.random.default_rng(dims)
    minority = clustered(rng, 2400, dims)
    rows = [(Vectors.dense(p.tolist()), 1) for p in minority] + [(Vectors.dense(np.zeros(dims).tolist()), 0)] * (len(minority) + 150)
    grown = ml.smote_oversample(spark.createDataFrame(rows, ["features", "label"]), block_rows=1500).where("synthetic").collect()
    assert len(grown) == 150
    names = np.arange(len(minority))
    near = plain_nearest(minority, names, 5)
    start = np.repeat(minority, 5, axis=0)
    step = minority[[j for i in names for j, _ in near[i]]] - start
    for made in np.array([r.v for r in grown]):
        share = ((made - start) * step).sum(axis=1) / (step**2).sum(axis=1)
        apart = np.abs(start + share[:, None] * step - made).max(axis=1)
        assert ((apart < 1e-9) & (share >= -1e-9) & (share <= 1 + 1e-9)).any()


def test_weights_and_guard(rows_of):
    df = rows_of([(1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 0, 1), (None, None, 1)], "has_cve_2023_47271_upload int, has_cve_2023_47271_rce int, label int")
    assert [r[0] for r in df.select(mt.cve_sample_weight(F.col("label"))).collect()] == [10.0, 10.0, 1.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        ml.single_class_guard(df.where("label = 1"))


def test_settings_are_seeded():
    assert ml.draw_settings(3, 7) == ml.draw_settings(3, 7) != ml.draw_settings(3, 8)
    assert all(0.001 <= s["stepSize"] <= 0.3 and s["maxIter"] % 50 == 0 for s in ml.draw_settings(20))
    assert len(ml.candidate_grid()) == 23


def test_penalty_follows_the_rows():
    name, estimator, params = ml.candidate_grid({"LogisticRegression": {"C": [10.0]}})[0]
    assert name == "LogisticRegression(C=10.0)" and params(500) == {estimator.regParam: 1 / 5000}


def test_splits_keep_rows_without_label(rows_of):
    df = rows_of([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id int, label int")
    split = mt.stratified_split(df, ["id"]).collect()
    assert len(split) == 40 and sum(r.split == "test" for r in split if r.label is None) == 2
    assert mt.stratified_folds(df, ["id"]).count() == 40


def test_split_moves_no_rows(spark):
    df = spark.range(200).withColumn("label", F.col("id") % 2)
    plan = mt.stratified_split(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("sent", [100, 5])
def test_audience_is_spread_over_tasks(spark, monkeypatch, sent):
    monkeypatch.setattr(jn, "AUDIENCE_ROWS", sent)
    monkeypatch.setattr(jn, "AUDIENCE_BLOCK", 7)
    monkeypatch.setattr(jn, "TASK_PAIRS", 100)
    alerts = spark.range(60, numPartitions=1).select(F.col("id").alias("attack_event_id"), (F.col("id") / 60).alias("probability"))
    users = spark.range(40).select(
        F.col("id").alias("telegram_chat_id"), F.lit("x").alias("email"), (F.col("id") / 40).alias("min_probability"),
        F.lit(True).alias("is_subscribed"), F.lit(True).alias("verified"),
    )
    got = jn.alert_audience(alerts, users)
    assert got.columns == ["attack_event_id", "probability", "telegram_chat_id", "email", "min_probability"]
    assert sorted((r.attack_event_id, r.telegram_chat_id) for r in got.collect()) == [(a, u) for a in range(60) for u in range(40) if a / 60 >= u / 40]
    assert sent < 40 or got.rdd.getNumPartitions() == 24


def test_scores_are_made_once_for_all_metrics(spark, monkeypatch):
    judged = []
    monkeypatch.setattr(ml, "prepare_training", lambda df: df)
    monkeypatch.setattr(ml, "score_batch", lambda model, df, *a, **k: df.withColumns({"probability": F.rand(), "prediction": F.lit(1)}))
    monkeypatch.setattr(ml, "classification_metrics", judged.append)
    ml.evaluate(None, spark.range(20).select((F.col("id") % 2).alias("label")))
    plan = judged[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "rand(" not in plan and judged[0].count() == 20


def test_sample_is_the_first_rows_in_hash_order(spark):
    df = spark.range(300)
    want = {r.id for r in df.orderBy(rk.hash_key(42, "id"), "id").limit(37).collect()}
    assert {r.id for r in rk.sample_rows(df, 37, ["id"]).collect()} == want
    assert rk.sample_rows(df, 999, ["id"]).count() == 300 and rk.sample_rows(df.where("id < 0"), 5, ["id"]).count() == 0


def test_cooldown_with_missing_times(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else 100 + i) for i in range(12)], "id int, s int")
    timed = df.withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in alert_cooldown(timed, "ts", ["id"], None, 5).collect()) == [1, 7]


def test_metric_in_nested_json(rows_of):
    texts = ['{"a": {"f1": 0.5}, "f1": 0.25}', '[{"x": [{"f1": null}, {"f1": 0.75}]}]', '{"f1": "0.125"}', '{"f1": "high"}', "no json", None, "{}", '{"f1": {"f1": 1}}']
    df = rows_of([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", mt.metric_value(F.col("t"), "f1").alias("v")).collect()}
    assert [got[i] for i in range(8)] == [0.25, 0.75, 0.125, None, None, None, None, None]
