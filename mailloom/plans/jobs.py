"""Jobs over whole tables or folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators import learning, scoring
from mailloom.plans.ship import ship
from mailloom.plans.storage import cut
from mailloom.sources import messages


def train_all(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Train and save every registered model on rows (text, label); (model, label, precision, recall, f1, accuracy, ...)
    on the part held out by a hash of the text."""
    split = cut(learning.split(learning.clean_labels(rows), "text").select("text", "label", "y", "is_test"))
    out = None
    for name, (file, trainer) in learning.REGISTRY.items():
        model = trainer(split.where("not is_test"))
        model.write().overwrite().save(f"{folder}/{file}")
        guess = F.when(F.col("verdict") == "Phishing", "spam").otherwise("ham")
        told = learning.predict(model, split.where("is_test").select("text", "label")).withColumn("guess", guess)
        one = learning.report(told, "label", "guess").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def score_folder(spark: SparkSession, source: str, target: str, form: str = "parquet") -> None:
    """Parse every .eml under source, score it and write the result; a message that fails has its parse_error."""
    emails = messages.read_eml(ship(spark), source).drop("attachments").withColumnRenamed("attachments_text", "attachments")
    messages.write(scoring.score(emails), target, form)
