"""Training, scoring and model search with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from itertools import product
from math import log2
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from wardlog.functions import scalars as S
from wardlog.operators import boosting as bo
from wardlog.operators.labels import harmonize_training_columns, normalize_scoring_row
from wardlog.operators.metrics import classification_metrics, cve_sample_weight, shuffle_splits, stratified_folds, stratified_split
from wardlog.operators.neighbours import BLOCK_ROWS, nearest_vectors
from wardlog.session import stage
from wardlog.sources.schemas import NUMERIC_FEATURES

# Vocabulary size and token shape of the URI text features.
MAX_TERMS = 300
TOKEN = r"[\p{L}\p{N}_]{2,}"
TOKENS = "_tokens"
# Default booster settings, and the search space of the tuned runs.
BOOSTER = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42}
TABULAR_TREES = 400
GRID = {
    "LogisticRegression": {"C": [0.1, 1.0, 10.0]},
    # An unlimited depth becomes the deepest that Spark allows.
    "RandomForestClassifier": {"numTrees": [100, 200], "maxDepth": [30, 8, 16], "minInstancesPerNode": [1, 3]},
    "GBTClassifier": {"maxIter": [100, 200], "maxDepth": [4, 6], "stepSize": [0.05, 0.1]},
}
SEARCH_SPACE = {
    "maxIter": (100, 1000, 50),
    "maxDepth": (3, 12),
    "stepSize": (0.001, 0.3),
    "subsamplingRate": (0.5, 1.0),
    "featureSubsetStrategy": (0.5, 1.0),
    "minInstancesPerNode": (1, 10),
    "minInfoGain": (0.0, 10.0),
    "regAlpha": (1e-8, 100.0),
    "regLambda": (1e-3, 100.0),
}
# What the names of the search space are to second-order trees: least weights and gains there are sums over a node's rows.
NEWTON_NAMES = {
    "maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "rows", "featureSubsetStrategy": "columns",
    "minInstancesPerNode": "least_weight", "minInfoGain": "gamma", "regAlpha": "l1", "regLambda": "l2", "seed": "seed",
}
FOREST_NAMES = {"numTrees": "rounds", "maxDepth": "depth", "minInstancesPerNode": "least_rows", "seed": "seed"}


def uri_tfidf(df: DataFrame, ids: list[str], text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """TF-IDF weights as rows (ids, term, weight): the most frequent terms, idf ln((1+n)/(1+df))+1, unit length.

    The vocabulary has at most `max_terms` rows, which is what gets broadcast. Ties by term.
    """
    tokens = df.select(*ids, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term"))
    counts = stage(tokens.groupBy(*ids, "term").agg(F.count("*").alias("tf")), "terms")
    vocabulary = (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count("*").alias("docs"))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
    )
    n = df.agg(F.count("*")).scalar()
    idf = vocabulary.select("term", (F.ln((1 + n) / (1 + F.col("docs"))) + 1).alias("idf"))
    weighted = counts.join(F.broadcast(idf), "term").withColumn("_w", F.col("tf") * F.col("idf"))
    # A document holds at most max_terms vocabulary terms, so the window stays small.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*ids)))
    return weighted.select(*ids, "term", (F.col("_w") / norm).alias("weight"))


def one_hot_method(column: str = "method") -> list:
    """Method categories as a vector; an unseen method becomes all zeros."""
    index = StringIndexer(inputCol=column, outputCol=f"{column}_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    return [index, OneHotEncoder(inputCols=[f"{column}_index"], outputCols=[f"{column}_vec"], dropLast=True)]


def uri_tokens(column: str = "uri") -> RegexTokenizer:
    return RegexTokenizer(inputCol=column, outputCol=TOKENS, gaps=False, pattern=TOKEN, toLowercase=True)


def apply_features(features: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with `features`; tokens that are stored with the rows are not cut again."""
    known = TOKENS in df.columns
    return PipelineModel(stages=[s for s in features.stages if not (known and isinstance(s, RegexTokenizer))]).transform(df)


def text_stages(df: DataFrame, column: str = "uri", max_terms: int = MAX_TERMS) -> PipelineModel:
    """Fitted URI stages: tokens, counts, idf + 1, unit length. The +1 is an extra product, as IDF has none.

    Tokens that are stored with the rows are not cut again.
    """
    tokens = uri_tokens(column)
    counts = CountVectorizer(inputCol=TOKENS, outputCol="_counts", vocabSize=max_terms)
    cut = df if TOKENS in df.columns else tokens.transform(df)
    fitted = Pipeline(stages=[counts, IDF(inputCol="_counts", outputCol="_idf")]).fit(cut)
    weights = Vectors.dense(fitted.stages[1].idf.toArray() + 1.0)
    scale = ElementwiseProduct(inputCol="_counts", outputCol="_weighted", scalingVec=weights)
    return PipelineModel(stages=[tokens, fitted.stages[0], scale, Normalizer(inputCol="_weighted", outputCol="uri_vec", p=2.0)])


def fit_features(df: DataFrame, numeric: list[str] | None = None) -> PipelineModel:
    """Fitted preprocessing to `features`: numeric passthrough, one-hot method, URI text."""
    text = text_stages(df)
    encode = Pipeline(stages=one_hot_method()).fit(df)
    assemble = VectorAssembler(inputCols=[*(numeric or NUMERIC_FEATURES), "method_vec", "uri_vec"], outputCol="features", handleInvalid="keep")
    return PipelineModel(stages=[*text.stages, *encode.stages, assemble])


def feature_vector(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Rows with `features`, intermediate columns dropped."""
    ready = normalize_scoring_row(df)
    rows = fit_features(ready, numeric).transform(ready)
    return rows.drop(TOKENS, "_counts", "_weighted", "uri_vec", "method_index", "method_vec")


def single_class_guard(df: DataFrame, label: str = "label") -> DataFrame:
    """The frame itself; raises when the label has fewer than two classes."""
    if df.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2:
        raise ValueError("label needs at least two classes")
    return df


def booster(**overrides) -> GBTClassifier:
    """Boosted trees with the default settings; no L1/L2 terms exist here."""
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **{**BOOSTER, **overrides})


def prepare_training(df: DataFrame) -> DataFrame:
    """Harmonised rows with integer label and sample weight; always weighted."""
    ready = harmonize_training_columns(df)
    ready = ready.withColumn("label", F.coalesce(F.col("label").try_cast("int"), F.lit(0)))
    return ready.withColumn("weight", cve_sample_weight(F.col("label")))


def train_attack_model(df: DataFrame, numeric: list[str] | None = None, smote: bool = False, **overrides) -> PipelineModel:
    """Preprocessing plus second-order boosted trees on labelled rows, fitted on all of them; `overrides` go by `NEWTON_NAMES`.

    Nothing but the vocabulary, and different rows where they are few, reaches the driver.
    """
    ready = single_class_guard(prepare_training(df))
    features = fit_features(ready, numeric)
    return PipelineModel(stages=[*features.stages, NewtonTrees().fit(_vectors(features, ready, smote), {**BOOSTER, **overrides})])


def train_tabular_model(df: DataFrame, numeric: list[str] | None = None) -> PipelineModel:
    """Boosted trees on the numeric columns alone, without URI text and method."""
    ready = single_class_guard(prepare_training(df))
    assemble = VectorAssembler(inputCols=numeric or NUMERIC_FEATURES, outputCol="features", handleInvalid="keep")
    features = PipelineModel(stages=[assemble])
    return PipelineModel(stages=[assemble, booster(maxIter=TABULAR_TREES).fit(_vectors(features, ready, False))])


PATTERN_NAMES = (("has_sqli", "has_sqli_pattern"), ("has_xss", "has_xss_pattern"))


def score_batch(model: PipelineModel, df: DataFrame, threshold: float = 0.5, apply_override: bool = True) -> DataFrame:
    """Adds `probability`, `prediction`, `decision`; an existing label plays no part.

    With the override a 2023 upload signature forces an attack with at least .99.
    """
    rows = df.drop("label")
    named = {new: F.col(old) for old, new in PATTERN_NAMES if old in rows.columns and new not in rows.columns}
    ready = normalize_scoring_row(rows.withColumns(named) if named else rows)
    scored = model.transform(ready).withColumn("probability", vector_to_array("probability")[1])
    hit = S.override_hit(F.col("has_cve_2023_47271_upload"), F.col("has_cve_2023_47271_rce"))
    prediction = S.apply_threshold(F.col("probability"), threshold)
    if apply_override:
        prediction = F.when(hit, F.lit(1)).otherwise(prediction)
        probability = S.override_probability(F.col("probability"), hit)
    else:
        probability = F.col("probability")
    return scored.select(*rows.columns, probability.alias("probability"), prediction.alias("prediction")).withColumn(
        "decision", S.decision(F.col("prediction"))
    )


def evaluate(model: PipelineModel, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of a model on held-out rows, without the override. Scores are stored: the metrics read them several times."""
    labels = prepare_training(test).withColumnRenamed("label", "_label")
    scored = score_batch(model, labels, threshold, apply_override=False).withColumnRenamed("_label", "label")
    return classification_metrics(stage(scored.select("label", "prediction", "probability"), "judged"))


def train_and_evaluate(df: DataFrame, ids: list[str], test_size: float = 0.2, seed: int = 42, **overrides) -> tuple[PipelineModel, DataFrame]:
    """Stratified hold-out, training, and the metrics row of the held-out part."""
    split = stratified_split(df, ids, "label", test_size, seed)
    model = train_attack_model(split.where("split = 'train'").drop("split"), **overrides)
    return model, evaluate(model, split.where("split = 'test'").drop("split"))


def feature_importance(model: PipelineModel, df: DataFrame, top: int = 10) -> DataFrame:
    """Highest gains with feature names from the vector's attributes; text features show their term."""
    importances = model.stages[-1].featureImportances
    terms = {f"uri_vec_{i}": f"uri:{t}" for s in model.stages if isinstance(s, CountVectorizerModel) for i, t in enumerate(s.vocabulary)}
    attributes = PipelineModel(stages=model.stages[:-1]).transform(normalize_scoring_row(df.drop("label")))
    groups = attributes.schema["features"].metadata["ml_attr"]["attrs"]
    labels = {a["idx"]: a.get("name", str(a["idx"])) for attrs in groups.values() for a in attrs}
    names = {i: terms.get(label, label) for i, label in labels.items()}
    pairs = zip(importances.indices.tolist(), importances.values.tolist())
    ranked = sorted(((names.get(i, str(i)), v) for i, v in pairs), key=lambda x: (-x[1], x[0]))[:top]
    return df.sparkSession.createDataFrame(ranked, "feature STRING, importance DOUBLE")


class NewtonTreesModel(Transformer):
    """Second-order trees or a forest as the last stage of a pipeline: adds `probability` of both classes and `prediction`."""

    def __init__(self, model: bo.NewtonModel):
        super().__init__()
        self.model = model

    @property
    def featureImportances(self):
        """Share of each feature in the gains of all splits."""
        total = [0.0] * len(self.model.edges)
        for tree in self.model.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    total[feature] += float(gain)
        every = sum(total) or 1.0
        return Vectors.sparse(len(total), [(i, gain / every) for i, gain in enumerate(total) if gain])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = F.col("probability")
        scored = self.model.score(dataset).withColumn("prediction", (p >= 0.5).cast("double"))
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p)))


class NewtonTrees:
    """Second-order trees as a search's estimator; settings go by the names of `SEARCH_SPACE`."""

    @staticmethod
    def settings(named: dict) -> bo.Settings:
        known = {NEWTON_NAMES[k]: v for k, v in named.items()}
        return bo.Settings(**{**known, "columns": float(known.get("columns", bo.Settings.columns))})

    def fit(self, vectors: DataFrame, named: dict) -> NewtonTreesModel:
        return NewtonTreesModel(bo.fit(vectors, self.settings(named)))


class Forest:
    """A random forest as a search's estimator; settings go by Spark's names."""

    @staticmethod
    def settings(named: dict) -> bo.ForestSettings:
        return bo.ForestSettings(**{FOREST_NAMES[k]: v for k, v in named.items()})

    def fit(self, vectors: DataFrame, named: dict) -> Transformer:
        model = bo.fit(vectors, self.settings(named))
        return NewtonTreesModel(model) if isinstance(model, bo.NewtonModel) else model


Candidate = tuple[str, object, Callable[[int], dict]]


def _vectors(features: PipelineModel, rows: DataFrame, smote: bool) -> DataFrame:
    """Feature rows to fit on; `smote` adds synthetic minority rows of weight 1."""
    made = apply_features(features, rows).select("features", "label", "weight")
    if smote:
        weights = made.groupBy("features", "label").agg(F.max("weight").alias("weight"))
        grown = smote_oversample(made).withColumn("features", array_to_vector("v")).drop("v")
        made = grown.join(weights, ["features", "label"], "left").select("features", "label", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return stage(made, "vectors")


def _dealt(ready: DataFrame, ids: list[str], folds: int) -> DataFrame:
    """Stored rows with fold and URI tokens. Dealing out moves rows, so only columns that models read go along; the
    tokens depend on no fold and are cut once."""
    read = dict.fromkeys([*ids, "label", "weight", "method", "uri", *NUMERIC_FEATURES])
    return stage(uri_tokens().transform(stratified_folds(ready.select(*read), ids, "label", folds)), "folds")


def _fold_scores(rows: DataFrame, folds: int, candidates: list[Candidate], parallelism: int, smote: bool) -> list[float]:
    """Mean AUC of each candidate; vocabulary, weights and encoder are fitted on each fold's training part alone."""
    judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    sums = [0.0] * len(candidates)
    for fold in range(folds):
        part = rows.where(F.col("fold") != fold)
        features = fit_features(part)
        train, valid = _vectors(features, part, smote), _vectors(features, rows.where(F.col("fold") == fold), False)
        n = train.count()

        def score(candidate: Candidate, train: DataFrame = train, valid: DataFrame = valid, n: int = n) -> float:
            _, estimator, settings = candidate
            return judge.evaluate(estimator.fit(train, settings(n)).transform(valid))

        # Second-order trees and forests of all settings are one job.
        trees = [i for i, (_, estimator, _) in enumerate(candidates) if isinstance(estimator, (NewtonTrees, Forest))]
        if trees:
            found = bo.areas(train, valid, [candidates[i][1].settings(candidates[i][2](n)) for i in trees], parallelism)
            for i, auc in zip(trees, found):
                sums[i] += auc
        others = [i for i in range(len(candidates)) if i not in trees]
        if others:
            with ThreadPool(min(parallelism, len(others))) as pool:
                found = pool.map(inheritable_thread_target(rows.sparkSession)(score), [candidates[i] for i in others])
            for i, auc in zip(others, found):
                sums[i] += auc
    return [total / folds for total in sums]


def _search(df: DataFrame, ids: list[str], folds: int, candidates: list[Candidate], parallelism: int, smote: bool) -> tuple[PipelineModel, DataFrame]:
    """The best candidate by mean AUC over stratified folds, fitted on all rows, and the ranking."""
    rows = _dealt(single_class_guard(prepare_training(df)), ids, folds)
    scores = _fold_scores(rows, folds, candidates, parallelism, smote)
    ranking = sorted(((name, float(auc)) for (name, _, _), auc in zip(candidates, scores)), key=lambda x: -x[1])
    _, estimator, settings = candidates[scores.index(max(scores))]
    features = fit_features(rows)
    vectors = _vectors(features, rows, smote)
    best = estimator.fit(vectors, settings(vectors.count()))
    return PipelineModel(stages=[*features.stages, best]), df.sparkSession.createDataFrame(ranking, "candidate STRING, roc_auc DOUBLE")


def candidate_grid(grid: dict[str, dict[str, list]] | None = None) -> list[Candidate]:
    """Every setting of logistic regression, random forest and boosted trees in `grid`.

    `C`, the inverse strength of logistic regression's penalty, is per row: Spark averages the loss, so the penalty is
    1 / (C n). Boosted trees are second-order ones.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    families = {
        "LogisticRegression": LogisticRegression(maxIter=1000, **common),
        "RandomForestClassifier": Forest(),
        "GBTClassifier": NewtonTrees(),
    }
    found: list[Candidate] = []
    for family, options in (grid or GRID).items():
        estimator = families[family]
        for values in product(*options.values()):
            setting = dict(zip(options, values))
            name = f"{family}({', '.join(f'{k}={v}' for k, v in setting.items())})"

            def params(n: int, setting: dict = setting, estimator=estimator) -> dict:
                known = {k: v for k, v in setting.items() if k != "C"}
                penalty = {"regParam": 1.0 / (setting["C"] * max(1, n))} if "C" in setting else {}
                if not isinstance(estimator, LogisticRegression):
                    return known
                return {estimator.getParam(k): v for k, v in {**known, **penalty}.items()}

            found.append((name, estimator, params))
    return found


def model_search(
    df: DataFrame, ids: list[str], folds: int = 5, parallelism: int = 4, grid: dict | None = None, smote: bool = False
) -> tuple[PipelineModel, DataFrame]:
    """Best of three model families by mean AUC over stratified folds, and the ranking."""
    return _search(df, ids, folds, candidate_grid(grid), parallelism, smote)


def cross_validate(
    df: DataFrame, ids: list[str], folds: int = 5, repeats: int = 0, test_size: float = 0.2, estimator=None, smote: bool = False
) -> DataFrame:
    """Predictions of models fitted without the rows they judge: ids, fold, label, probability, prediction.

    With `repeats` the parts are that many stratified shuffle splits, else `folds` folds. Everything, preprocessing and
    synthetic rows included, is fitted on the training part alone. Feed the result to `cv_metrics`.
    """
    ready = single_class_guard(prepare_training(df))
    if repeats:
        splits = [(s.where("split = 'train'"), s.where("split = 'test'")) for s in shuffle_splits(ready, ids, "label", repeats, test_size)]
    else:
        dealt = _dealt(ready, ids, folds)
        splits = [(dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k)) for k in range(folds)]
    judged = []
    for fold, (train, test) in enumerate(splits):
        features = fit_features(train)
        model = (estimator or booster()).fit(_vectors(features, train, smote))
        rows = model.transform(apply_features(features, test)).withColumn("probability", vector_to_array("probability")[1])
        kept = rows.select(*ids, F.lit(fold).alias("fold"), "label", "probability", S.apply_threshold(F.col("probability")).alias("prediction"))
        judged.append(stage(kept, "judged"))
    return reduce(DataFrame.unionByName, judged)


def draw_settings(trials: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """Seeded random settings; the learning rate and the penalties that the space has are drawn on a log scale."""
    space = space or SEARCH_SPACE
    rng = random.Random(seed)
    settings = []
    for _ in range(trials):
        low, high, step = space["maxIter"]
        rate_low, rate_high = space["stepSize"]
        settings.append(
            {
                "maxIter": rng.randrange(low, high + 1, step),
                "maxDepth": rng.randint(*space["maxDepth"]),
                "stepSize": 2 ** rng.uniform(log2(rate_low), log2(rate_high)),
                "subsamplingRate": rng.uniform(*space["subsamplingRate"]),
                "featureSubsetStrategy": f"{rng.uniform(*space['featureSubsetStrategy']):.4f}",
                "minInstancesPerNode": rng.randint(*space["minInstancesPerNode"]),
                "minInfoGain": rng.uniform(*space["minInfoGain"]),
                **{k: 2 ** rng.uniform(*map(log2, space[k])) for k in ("regAlpha", "regLambda") if k in space},
            }
        )
    return settings


def hyperparameter_search(
    df: DataFrame,
    ids: list[str],
    trials: int = 25,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
    space: dict | None = None,
    smote: bool = False,
) -> tuple[PipelineModel, DataFrame]:
    """Best second-order trees among seeded random settings by mean AUC, and the ranking.

    They have the penalties of the space, and a least gain that is a sum over a node's rows. (Spark's trees compare it with the
    mean gain of a row, which is 1 at most: nearly every setting of the space would leave them without a split.)
    """
    estimator = NewtonTrees()
    candidates: list[Candidate] = []
    for setting in draw_settings(trials, seed, space):
        name = ", ".join(f"{k}={v if isinstance(v, (int, str)) else round(v, 5)}" for k, v in setting.items())
        candidates.append((name, estimator, lambda n, setting=setting: {**setting, "seed": seed}))
    return _search(df, ids, folds, candidates, parallelism, smote)


def smote_oversample(
    df: DataFrame, features: str = "features", label: str = "label", k: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds synthetic minority rows until both classes are equal: (features, label, synthetic).

    A new row lies at a random place between a minority row and one of its k nearest, which are exact. Equal vectors
    are handled once with their number of copies: a vector with more than k copies has only copies
    of itself as neighbours, so its new rows equal it.
    """
    sizes = {row[label]: row["n"] for row in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    minority, majority = sorted(sizes, key=lambda c: (sizes[c], -c))[0], max(sizes, key=lambda c: (sizes[c], -c))
    original = df.select(vector_to_array(features).alias("v"), F.col(label).cast("int").alias(label), F.lit(False).alias("synthetic"))
    needed, n = sizes[majority] - sizes[minority], sizes[minority]
    if minority == majority or needed <= 0 or n < 2:
        return original
    k = max(1, min(k, n - 1))
    copied = (
        original.where(F.col(label) == minority)
        .withColumn("vid", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
        .groupBy("vid")
        .agg(F.first("v").alias("v"), F.count("*").alias("copies"))
    )
    distinct = stage(copied, "minority")
    near = nearest_vectors(distinct, k, block_rows)
    sized = near.join(distinct.select(F.col("vid").alias("near"), F.col("v").alias("nv"), F.col("copies").alias("nc")), "near")
    # Slots 1..k of a row's neighbours: its own copies first, then other vectors by distance.
    upto = F.sum("nc").over(Window.partitionBy("vid").orderBy("distance", "near"))
    others = sized.withColumn("upto", upto).select("vid", "nv", (F.col("upto") - F.col("nc")).alias("after"), "upto")
    # Every minority row gives needed // n new rows; the remainder is spread evenly in hash order.
    ordered = Window.partitionBy("_part").orderBy("vid")
    parted = distinct.withColumn("_part", F.left("vid", F.lit(4)))
    offsets = parted.groupBy("_part").agg(F.sum("copies").alias("_c")).select(
        "_part", (F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_c")).alias("_off")
    )
    placed = parted.join(offsets, "_part").withColumn(
        "_before", F.col("_off") + F.sum("copies").over(ordered) - F.col("copies")
    )
    spread = [F.floor(at * F.lit(needed % n) / F.lit(n)) for at in (F.col("_before"), F.col("_before") + F.col("copies"))]
    extra = spread[1] - spread[0]
    births = placed.withColumn("_births", F.col("copies") * (needed // n) + extra).where("_births > 0")
    draws = births.select("vid", "v", "copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_births"))).alias("draw"))

    def chance(salt: str):
        text = F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), "vid", F.col("draw").cast("string")))
        return F.conv(F.left(text, F.lit(12)), 16, 10).cast("double") / float(16**12)

    drawn = draws.withColumn("slot", F.floor(chance("s") * k) + 1).withColumn("share", chance("u"))
    drawn = drawn.withColumn("rest", F.col("slot") - (F.col("copies") - 1))
    matched = drawn.join(
        others, (drawn["vid"] == others["vid"]) & (F.col("rest") > F.col("after")) & (F.col("rest") <= F.col("upto")), "left"
    )
    other = F.coalesce("nv", "v")
    mixed = F.zip_with("v", other, lambda a, b: a + F.col("share") * (b - a))
    made = matched.select(mixed.alias("v"), F.lit(int(minority)).alias(label), F.lit(True).alias("synthetic"))
    return original.unionByName(made)
