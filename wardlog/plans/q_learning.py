"""Queries: splits, metrics, features, training, scoring, search."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlog.functions import scalars as S
from wardlog.operators import boosting as bo
from wardlog.operators import learning as ml
from wardlog.operators import metrics as mt
from wardlog.operators.neighbours import nearest_vectors
from wardlog.plans.driver_log import derived_events
from wardlog.plans.flat_sql import FEATURE_CTE
from wardlog.plans.frames import feature_rows
from wardlog.plans.registry import query, table
from wardlog.session import stage
from wardlog.sources.schemas import NUMERIC_FEATURES


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a label and a stand-in score in steps of 1/1000, so that scores tie."""
    step = F.floor((F.col("event_id") * 7919 % 100000) / 100)
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("event_id") % 7 >= 2).cast("int").alias("label"), (step / F.lit(1000.0)).alias("probability")
    )
    return rows.withColumn("prediction", (F.col("probability") >= 0.4).cast("int"))


# Some labels are missing; NULL is then a class of its own.
HOLES = "holes AS (SELECT event_id, CASE WHEN event_id % 29 <> 3 THEN label END AS label FROM lab)"
LABELLED = """lab AS (SELECT event_id, (event_id % 7 >= 2)::INT AS label, ((event_id * 7919 % 100000) // 100) / 1000.0::DOUBLE AS probability,
  ((event_id * 7919 % 100000) // 100 >= 400)::INT AS prediction FROM events)"""
RANKED_HOLES = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM holes)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM lab)"


def with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_id") % 29 != 3, F.col("label"))
    return labelled_events(spark, sf_dir).select("event_id", known.alias("label"))


@query(
    "stratified_split",
    f"WITH {LABELLED}, {HOLES}, {RANKED_HOLES} SELECT event_id, label, CASE WHEN rk <= ceil(round(n * 0.2::DOUBLE, 9)) THEN 'test' ELSE 'train' END AS split FROM ranked",
)
def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.stratified_split(with_holes(spark, sf_dir), ["event_id"])


@query("stratified_folds", f"WITH {LABELLED}, {HOLES}, {RANKED_HOLES} SELECT event_id, label, ((rk - 1) % 5)::INT AS fold FROM ranked")
def folds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.stratified_folds(with_holes(spark, sf_dir), ["event_id"])


@query(
    "cve_sample_weight",
    f"""WITH {FEATURE_CTE} SELECT event_id, CASE WHEN (has_cve_2023_47271_upload = 1 OR has_cve_2023_47271_rce = 1) AND label = 1 THEN 10.0
    ELSE 1.0 END::DOUBLE AS weight FROM feat""",
)
def weight_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_rows(spark, sf_dir).select("event_id", mt.cve_sample_weight(F.col("label")).alias("weight"))


AUC_PARTS = """cells AS (SELECT {by} probability, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg FROM {src} GROUP BY ALL),
auc AS (SELECT {by} sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
  SELECT *, sum(neg) OVER ({part} ORDER BY probability) - neg AS below FROM cells) {group})"""
COUNTS = """count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"""


@query("confusion_matrix", f"WITH {LABELLED} SELECT {COUNTS} FROM lab")
def confusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_matrix(labelled_events(spark, sf_dir))


@query(
    "classification_metrics",
    f"""WITH {LABELLED}, {AUC_PARTS.format(by="", src="lab", part="", group="")}, c AS (SELECT {COUNTS} FROM lab)
    SELECT round((tp + tn) / (tn + fp + fn + tp)::DOUBLE, 6)::DOUBLE AS accuracy, round(tp / (tp + fp)::DOUBLE, 6)::DOUBLE AS precision,
    round(tp / (tp + fn)::DOUBLE, 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6)::DOUBLE AS f1, round(roc_auc, 6)::DOUBLE AS roc_auc FROM c, auc""",
)
def metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_metrics(labelled_events(spark, sf_dir))


@query(
    "classification_report",
    f"""WITH {LABELLED}, c AS (SELECT {COUNTS} FROM lab),
    k AS (SELECT '0' AS class, tn::DOUBLE AS hit, tn + fn AS predicted, tn + fp AS support FROM c
      UNION ALL SELECT '1', tp::DOUBLE, tp + fp, tp + fn FROM c),
    r AS (SELECT class, hit / predicted AS precision, hit / support AS recall, 2 * hit / (predicted + support) AS f1, support FROM k)
    SELECT class, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support FROM (
      SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r)""",
)
def report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_report(labelled_events(spark, sf_dir))


FOLD_METRICS = ["accuracy", "f1", "precision", "recall", "roc_auc"]


@query(
    "cv_metrics",
    f"""WITH {LABELLED}, {RANKED}, folded AS (SELECT *, (rk - 1) % 5 AS fold FROM ranked),
    {AUC_PARTS.format(by="fold,", src="folded", part="PARTITION BY fold", group="GROUP BY fold")},
    c AS (SELECT fold, {COUNTS} FROM folded GROUP BY fold),
    m AS (SELECT fold, (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
      2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, roc_auc FROM c JOIN auc USING (fold)) """
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}), 6)::DOUBLE AS mean, round(stddev_pop({n}), 6)::DOUBLE AS std FROM m" for n in FOLD_METRICS),
)
def cv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.cv_metrics(mt.stratified_folds(labelled_events(spark, sf_dir), ["event_id"]))


@query(
    "one_hot_method",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '1,0,0,0' WHEN 'click' THEN '0,0,0,1' WHEN 'error' THEN '0,0,1,0' ELSE '0,1,0,0' END AS encoded FROM events""",
)
def one_hot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml import Pipeline

    rows = derived_events(spark, sf_dir).select("event_id", "method")
    encoded = Pipeline(stages=ml.one_hot_method()).fit(rows).transform(rows)
    shown = F.array_join(F.transform(vector_to_array("method_vec"), lambda x: x.cast("int").cast("string")), ",")
    return encoded.select("event_id", shown.alias("encoded"))


@query(
    "uri_tfidf",
    r"""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
    vocab AS (SELECT term, sum(tf) AS total, count(*) AS docs FROM counts GROUP BY 1 ORDER BY total DESC, term LIMIT 300),
    w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + docs)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6)::DOUBLE AS weight FROM w""",
)
def tfidf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ml.uri_tfidf(docs, ["doc_id"], "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows labelled by whether the request carries a hostile payload."""
    rows = feature_rows(spark, sf_dir).drop("tx", "ts", "user_id")
    return rows.withColumn("label", (F.col("event_id") % 24 >= 12).cast("int"))


_SPLITS: dict[tuple[str, str], DataFrame] = {}
_MODELS: dict[tuple[str, str], PipelineModel] = {}


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows, parsed and stored once per application, with their split."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SPLITS:
        _SPLITS[key] = mt.stratified_split(stage(training_rows(spark, sf_dir), "training-rows"), ["event_id"])
    return _SPLITS[key]


def shared_model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """Model with the default settings, trained once per application on the whole training part."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        train = split_rows(spark, sf_dir).where("split = 'train'").drop("split")
        _MODELS[key] = ml.train_attack_model(train)
    return _MODELS[key]


# The numeric inputs, the method as one of four, and unit-length weights of the URI's terms, all of which are in the vocabulary.
VECTOR_SQL = (
    f"WITH {FEATURE_CTE}"
    + r""", tok AS (SELECT event_id, unnest(regexp_extract_all(lower(uri), '[\p{L}\p{N}_]{2,}')) AS term FROM feat),
    cnt AS (SELECT event_id, term, count(*) AS tf FROM tok GROUP BY ALL), vocab AS (SELECT term, count(*) AS docs FROM cnt GROUP BY 1),
    w AS (SELECT event_id, tf * (ln((1 + (SELECT count(*) FROM feat)) / (1 + docs)::DOUBLE) + 1) AS w FROM cnt JOIN vocab USING (term)),
    s AS (SELECT event_id, sum(w) / sqrt(sum(w * w)) AS terms FROM w GROUP BY 1)
    SELECT event_id, (NUMBERS + 4 + (SELECT count(*) FROM vocab))::INT AS width, round(TOTAL + 1 + coalesce(terms, 0), 6)::DOUBLE AS total
    FROM feat LEFT JOIN s USING (event_id)"""
).replace("NUMBERS", str(len(NUMERIC_FEATURES))).replace("TOTAL", " + ".join(c.removesuffix("_pattern") for c in NUMERIC_FEATURES))


@query("feature_vector", VECTOR_SQL)
def vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.feature_vector(split_rows(spark, sf_dir))
    vector = vector_to_array("features")
    return rows.select("event_id", F.size(vector).alias("width"), F.round(F.aggregate(vector, F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def held_out_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = split_rows(spark, sf_dir).where("split = 'test'").drop("split")
    return ml.evaluate(shared_model(spark, sf_dir), test)


@query(
    "train_attack_model",
    """WITH t AS (SELECT event_id % 24 >= 12 AS label, count(*) AS n FROM events GROUP BY 1)
    SELECT sum(ceil(round(n * 0.2::DOUBLE, 9)))::BIGINT AS test_rows, true AS learned FROM t""",
)
def train_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the held-out part, and whether the trained model tells its classes apart there."""
    size = split_rows(spark, sf_dir).where("split = 'test'").agg(F.count("*").alias("test_rows"))
    learned = held_out_metrics(spark, sf_dir).select(((F.col("roc_auc") > 0.9) & (F.col("f1") > 0.8)).alias("learned"))
    return size.join(learned)


@query(
    "score_batch",
    f"""WITH {FEATURE_CTE} SELECT event_id, has_cve_2023_47271_upload = 1 OR has_cve_2023_47271_rce = 1 AS forced, true AS consistent FROM feat""",
)
def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event scored. `consistent`: probability, override, prediction and decision agree."""
    scored = ml.score_batch(shared_model(spark, sf_dir), split_rows(spark, sf_dir).drop("split"))
    forced = (F.col("has_cve_2023_47271_upload") == 1) | (F.col("has_cve_2023_47271_rce") == 1)
    p, hit = F.col("probability"), F.col("prediction") == 1
    agrees = p.between(0, 1) & (hit == ((p >= 0.5) | forced)) & (~forced | (p >= 0.99)) & (F.col("decision") == S.decision(F.col("prediction")))
    return scored.select("event_id", forced.alias("forced"), agrees.alias("consistent"))


@query("feature_importance", "SELECT 10 AS features, true AS ranked")
def importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of named features, and whether their shares are positive and fall."""
    found = ml.feature_importance(shared_model(spark, sf_dir), split_rows(spark, sf_dir))
    order = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("importance"), "feature"))), lambda x: x["feature"])
    shares = (F.sum("importance") <= 1.000001) & (F.min("importance") >= 0) & (F.count_distinct("feature") == F.count("*"))
    return found.agg(F.count("*").cast("int").alias("features"), (shares & (F.size(order) == F.count("*"))).alias("ranked"))


def search_summary(ranking: DataFrame) -> DataFrame:
    """Candidates of a search, and whether their scores are areas in descending order of a total ranking."""
    valid = (F.min("roc_auc") >= 0) & (F.max("roc_auc") <= 1) & (F.count_distinct("candidate") == F.count("*")) & (F.max("roc_auc") > 0.9)
    return ranking.agg(F.count("*").cast("int").alias("candidates"), valid.alias("valid"))


@query("cross_validation")
def cross_validation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over folds of a logistic regression that is fitted anew, with its features, for each fold."""
    estimator = LogisticRegression(maxIter=1000, featuresCol="features", labelCol="label", weightCol="weight")
    return mt.cv_metrics(ml.cross_validate(split_rows(spark, sf_dir).drop("split"), ["event_id"], folds=3, estimator=estimator))


@query("model_search", "SELECT 23 AS candidates, true AS valid")
def model_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 settings of the grid, five folds."""
    ranking = ml.model_search(split_rows(spark, sf_dir).drop("split"), ["event_id"])[1]
    return search_summary(ranking)


@query("hyperparameter_search", "SELECT 25 AS candidates, true AS valid")
def hyper_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 settings drawn from the whole space, five folds."""
    ranking = ml.hyperparameter_search(split_rows(spark, sf_dir).drop("split"), ["event_id"])[1]
    return search_summary(ranking)


@query(
    "smote_oversample",
    """WITH c AS (SELECT (event_type = 'error')::INT AS label, count(*) AS n FROM events GROUP BY 1)
    SELECT label, false AS synthetic, n FROM c
    UNION ALL SELECT 1, true, (SELECT n FROM c WHERE label = 0) - (SELECT n FROM c WHERE label = 1)""",
)
def smote_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("value", "user_id", (F.col("event_type") == "error").cast("int").alias("label"))
    vectors = VectorAssembler(inputCols=["value", "user_id"], outputCol="features").transform(rows)
    grown = ml.smote_oversample(vectors.select("features", "label"))
    return grown.groupBy("label", "synthetic").agg(F.count("*").alias("n"))


@query(
    "nearest_vectors",
    """WITH p AS (SELECT DISTINCT value, user_id::DOUBLE AS user_id FROM events WHERE event_type = 'error'),
    d AS (SELECT a.value, a.user_id, (a.value - b.value) * (a.value - b.value) + (a.user_id - b.user_id) * (a.user_id - b.user_id) AS d
      FROM p a JOIN p b ON a.value <> b.value OR a.user_id <> b.user_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY value, user_id ORDER BY d) AS place FROM d)
    SELECT value, user_id, place, round(d, 6)::DOUBLE AS distance FROM r WHERE place <= 5""",
)
def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every distinct vector of the minority that `smote_oversample` grows."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("value", F.col("user_id").cast("double").alias("user_id")).distinct()
    named = rows.withColumn("vid", F.md5(F.concat_ws(":", "value", "user_id"))).withColumn("v", F.array("value", "user_id"))
    places = Window.partitionBy("vid").orderBy("distance", "near")
    near = nearest_vectors(stage(named, "minority"), 5).withColumn("place", F.row_number().over(places).cast("long"))
    return named.join(near, "vid").select("value", "user_id", "place", F.round("distance", 6).alias("distance"))


# Yes/no features of a text, the same in both dialects.
TEXT_FLAGS = {
    "long": "n_chars >= 2000",
    "digit": "text LIKE '%1%'",
    "link": "text LIKE '%http%'",
    "shout": "text LIKE '%!%'",
    "english": "lang = 'en'",
    "lines": "n_chars >= 8000",
}
NEWTON = bo.Settings(rounds=1, depth=2, rate=0.3, l1=1.0, l2=2.0, gamma=0.05, rows=1, columns=1)


def _newton_level(level: int) -> str:
    """One level of a tree in SQL: at margin 0 the derivatives of a row are 1/2 - y and 1/4."""

    def score(g: str, h: str) -> str:
        return f"power(greatest(abs({g}) - {NEWTON.l1}, 0), 2) / ({h} + {NEWTON.l2})"

    gain = f"0.5 * ({score('lg', 'lh')} + {score('g - lg', 'h - lh')} - {score('g', 'h')}) - {NEWTON.gamma}"
    rows = "SELECT 0 AS node, y, x FROM d" if not level else f"SELECT 2 * node + 1 + x[f + 1] AS node, y, x FROM n{level - 1} JOIN s{level - 1} USING (node) WHERE f IS NOT NULL"
    return f"""n{level} AS (SELECT node, y, x FROM ({rows})),
    c{level} AS (SELECT node, f, sum(0.5::DOUBLE - y) AS g, count(*) / 4.0::DOUBLE AS h, sum(CASE WHEN x[f + 1] = 0 THEN 0.5::DOUBLE - y ELSE 0 END) AS lg,
      count(*) FILTER (x[f + 1] = 0) / 4.0::DOUBLE AS lh FROM (SELECT *, unnest(range({len(TEXT_FLAGS)})) AS f FROM n{level}) GROUP BY ALL),
    g{level} AS (SELECT *, CASE WHEN lh >= 1 AND h - lh >= 1 AND {gain} > 0 AND {level} < {NEWTON.depth} THEN {gain} END AS gain FROM c{level}),
    s{level} AS (SELECT node, g, h, CASE WHEN gain IS NOT NULL THEN f END AS f, gain FROM g{level} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC NULLS LAST, f) = 1)"""


@query(
    "newton_trees",
    "WITH d AS (SELECT quality AS y, ["
    + ", ".join(f"({flag})::INT" for flag in TEXT_FLAGS.values())
    + "] AS x FROM documents JOIN labels USING (doc_id)), "
    + ", ".join(map(_newton_level, range(NEWTON.depth + 1)))
    + f""" SELECT 0 AS tree, node::INT AS node, [{", ".join(f"'{n}'" for n in TEXT_FLAGS)}][f + 1] AS feature, CASE WHEN f IS NOT NULL THEN 1.0::DOUBLE END AS threshold,
    round(coalesce(gain, 0), 9)::DOUBLE AS gain, round(-{NEWTON.rate} * sign(g) * greatest(abs(g) - {NEWTON.l1}, 0) / (h + {NEWTON.l2}), 9)::DOUBLE AS weight
    FROM ({" UNION ALL ".join(f"SELECT * FROM s{level}" for level in range(NEWTON.depth + 1))})""",
)
def newton_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the first second-order tree for the quality of all labelled documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    flags = [F.expr(flag).cast("int").cast("double").alias(name) for name, flag in TEXT_FLAGS.items()]
    rows = docs.select("doc_id", F.col("quality").alias("label"), F.lit(1.0).alias("weight"), *flags)
    vectors = VectorAssembler(inputCols=list(TEXT_FLAGS), outputCol="features").transform(rows)
    model = bo.train(vectors, ["doc_id"], NEWTON, list(TEXT_FLAGS))
    return model.splits(spark).withColumns({c: F.round(c, 9) for c in ("gain", "weight")})


@query("single_class_guard", "SELECT (event_type = 'error')::INT AS label, count(*) AS n FROM events GROUP BY 1")
def guard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "error").cast("int").alias("label"))
    return ml.single_class_guard(rows).groupBy("label").agg(F.count("*").alias("n"))
