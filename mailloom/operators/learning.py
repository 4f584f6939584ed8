"""Text classification: splits, TF-IDF, four classifiers, evaluation and a model registry, all as Spark ML pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAM, HAM = 1.0, 0.0
TEST_SHARE = 0.2
HAM_MOST = 1396
VOCABULARY = 1 << 22
#: Two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"


def clean_labels(rows: DataFrame) -> DataFrame:
    """rows with y, 1 for spam and 0 for ham in any case; rows with other or NULL labels, or NULL text, are left out."""
    label = F.lower(F.trim("label"))
    return rows.where(label.isin("spam", "ham") & F.col("text").isNotNull()).withColumns({"label": label, "y": F.when(label == "spam", SPAM).otherwise(HAM)})


def first_by_hash(rows: DataFrame, key: str, group: str, quota: Column) -> DataFrame:
    """rows with _first: whether a row is among the first of its group by md5 of its key; quota says how many these
    are, as a function of n, the rows of the group. Exact, and the same in any engine that has md5.

    A histogram over the first four digits of the hash finds where each group is cut; only rows in the one bucket that
    the cut goes through are ranked, so no group is sorted as a whole. A NULL key counts as ''."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = rows.withColumns({"_h": h, "_b": F.substring(h, 1, 4)})
    bars = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)  # over at most 65,536 bars
    bars = bars.withColumns({"_to": F.sum("_n").over(own.orderBy("_b")), "n": F.sum("_n").over(own)}).withColumn("_q", quota)
    cuts = bars.where("_to - _n < _q and _to >= _q").select(F.col(group).alias("_g"), F.col("_b").alias("_cut"), (F.col("_q") - F.col("_to") + F.col("_n")).alias("_rest"))
    all_in = bars.groupBy(F.col(group).alias("_g2")).agg((F.max("_q") > F.max("n")).alias("_all"))
    placed = rows.join(cuts, F.col(group).eqNullSafe(F.col("_g")), "left").join(all_in, F.col(group).eqNullSafe(F.col("_g2")), "left")
    clear = placed.where("_cut is null or _b <> _cut").withColumn("_first", F.col("_all") | F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h", key))
    at_cut = placed.where("_b = _cut").withColumn("_first", rank <= F.col("_rest"))
    return clear.unionByName(at_cut).drop("_h", "_b", "_g", "_g2", "_cut", "_rest", "_all")


def split(rows: DataFrame, key: str, share: float = TEST_SHARE) -> DataFrame:
    """rows with is_test: a stratified split. Of each label exactly the share, rounded, is in the test part: the first
    rows by a hash of their key."""
    return first_by_hash(rows, key, "label", F.floor(F.col("n") * share + 0.5)).withColumnRenamed("_first", "is_test")


def at_most(rows: DataFrame, key: str, condition: Column, most: int = HAM_MOST) -> DataFrame:
    """rows of which those with the condition are thinned to `most`, the first by a hash of their key."""
    marked = rows.withColumn("_group", F.coalesce(condition, F.lit(False)))
    return first_by_hash(marked, key, "_group", F.when(F.col("_group"), F.lit(most)).otherwise(F.col("n") + 1).cast("bigint")).where("_first").drop("_first", "_group")


def _tokens(bigrams: bool) -> list:
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD, gaps=False, toLowercase=True)
    if not bigrams:
        return [words, SQLTransformer(statement="SELECT *, words AS terms FROM __THIS__")]
    return [words, NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]


def fit(rows: DataFrame, classifier, bigrams: bool, least_documents: int, normalise: bool = True) -> PipelineModel:
    """TF-IDF (smoothed, plus one, unit length) and the classifier on top, fitted. rows: text, y."""
    counts = Pipeline(stages=[*_tokens(bigrams), CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(least_documents), vocabSize=VOCABULARY), IDF(inputCol="counts", outputCol="idf")]).fit(rows)
    idf = counts.stages[-1]
    weights = ElementwiseProduct(inputCol="counts", outputCol="weighted", scalingVec=Vectors.dense([x + 1 for x in idf.idf.toArray()]))
    unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    stages: list[Transformer] = [*counts.stages[:-1], weights, unit]
    return PipelineModel(stages=[*stages, classifier.fit(PipelineModel(stages).transform(rows))])


def complement_bayes(rows: DataFrame) -> PipelineModel:
    return fit(rows, NaiveBayes(modelType="complement", labelCol="y", smoothing=1.0), True, 2)


def multinomial_bayes(rows: DataFrame) -> PipelineModel:
    """On as many ham rows as spam usually has; see predict() for the class priors."""
    some = at_most(rows, "text", F.col("y") == HAM)
    model = fit(some, NaiveBayes(modelType="multinomial", labelCol="y", smoothing=1.0), True, 2)
    n = {r["y"]: r["count"] for r in some.groupBy("y").count().collect()}
    # Spark smooths the class priors; the factors take that back out
    factors = [n.get(float(i), 0) / max(sum(n.values()), 1) / math.exp(x) for i, x in enumerate(model.stages[-1].pi.toArray())]
    fix = SQLTransformer(statement=f"SELECT *, array({', '.join(f'{x!r}D' for x in factors)}) AS prior_fix FROM __THIS__")
    return PipelineModel(stages=[*model.stages, fix])


def logistic(rows: DataFrame) -> PipelineModel:
    n = max(rows.count(), 1)
    return fit(rows, LogisticRegression(labelCol="y", maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False), True, 2)


def decision_tree(rows: DataFrame) -> PipelineModel:
    """Classes weigh alike, whatever their sizes."""
    weights = {r["y"]: r["weight"] for r in class_weights(rows).collect()}
    weighed = rows.withColumn("w", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("y")), F.lit(1.0)))
    return fit(weighed, DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=10, minInstancesPerNode=5, seed=42, maxMemoryInMB=512), False, 5)


#: name -> (file, trainer)
REGISTRY: dict[str, tuple[str, Callable[[DataFrame], PipelineModel]]] = {
    "nb_complement": ("nb_complement", complement_bayes),
    "nb_multinomial": ("nb_multinomial", multinomial_bayes),
    "logistic_regression": ("logistic_regression", logistic),
    "decision_tree": ("decision_tree", decision_tree),
}


def load_or_train(name: str, folder: str, rows: DataFrame) -> PipelineModel:
    """The saved model, or a new one that is saved. An unknown name raises ValueError."""
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(REGISTRY)}")
    file, trainer = REGISTRY[name]
    path = f"{folder}/{file}"
    try:
        return PipelineModel.load(path)
    except Exception as e:  # noqa: BLE001
        if "does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e) and not isinstance(e, FileNotFoundError) and Path(path).exists():
            raise
    model = trainer(rows)
    model.write().overwrite().save(path)
    return model


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with verdict (Phishing or Legitimate), percent (of the verdict, 0 to 100) and shown ("NN.NN")."""
    scored = model.transform(rows)
    p = vector_to_array(F.col("probability"))
    if "prior_fix" in scored.columns:
        fixed = F.zip_with(p, F.col("prior_fix"), lambda x, y: x * y)
        total = F.aggregate(fixed, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(fixed, lambda x: x / total)
    best = F.array_max(p)
    spam = F.get(p, F.lit(1)) > F.get(p, F.lit(0))
    drop = [c for c in scored.columns if c not in rows.columns]
    out = scored.withColumns({"verdict": F.when(spam, "Phishing").otherwise("Legitimate"), "percent": F.round(best * 100, 2)})
    return out.drop(*drop).withColumn("shown", F.format_string("%.2f", "percent"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(y, n, weight): weight = rows / (classes * rows of the class)."""
    n = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # over as many rows as there are classes
    return n.select("y", "n", (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))


def report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1, accuracy) per label; 0 where undefined. One small aggregation."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # over as many rows as there are pairs of labels
    whole = Window.partitionBy(F.lit(1))
    accuracy = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole)
    labels = cells.withColumn("accuracy", accuracy).select(F.explode(F.array("t", "p")).alias("label"), "t", "p", "n", "accuracy").distinct()
    w = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    same = labels.groupBy("label").agg(w((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("hit"), w(F.col("t") == F.col("label")).alias("support"), w(F.col("p") == F.col("label")).alias("given"), F.max("accuracy").alias("accuracy"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = same.withColumns({"precision": ratio(F.col("hit"), F.col("given")), "recall": ratio(F.col("hit"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).select("label", "support", "precision", "recall", "f1", "accuracy")


def document_frequency(rows: DataFrame, least: int = 2) -> DataFrame:
    """(term, df, idf) of the words of two or more letters or digits in at least `least` texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    n = rows.count()
    df = rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    return df.select("term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def first_of_equal(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row, that of the smallest key, for each combination of the columns."""
    w = Window.partitionBy(*columns).orderBy(key)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_rules(predictions: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """predictions (key, verdict, percent) beside the rules' label, score and explanations (as rules_...), and
    whether both agree that a message is dangerous. One join on the key."""
    rules = scored.select(key, F.col("label").alias("rules_label"), F.col("score").alias("rules_score"), F.col("explanations").alias("rules_explanations"))
    agree = (F.col("verdict") == "Phishing") == (F.col("rules_label") != "LOW")
    return predictions.join(rules, key, "left").withColumn("agree", agree)
