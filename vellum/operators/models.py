"""Model interfaces: experts as functions of frames, Spark ML forests, ordered vectors.

External models (convolutional and recurrent networks, the printed-text engine)
arrive as score columns; an expert that isn't enabled or has no input says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics


@dataclass(frozen=True)
class Expert:
    """A registered recogniser: adds ``scores`` (array<double>) to crops."""

    name: str
    recognize: Callable[[DataFrame], DataFrame] | None = None
    enabled: bool = False
    settings: dict = field(default_factory=dict)

    def run(self, crops: DataFrame, labels: list[str], most: int = 5) -> DataFrame:
        """crop_id, attempted, status and ranked candidates of each crop."""
        none = F.array().cast("array<struct<rank:int,class_id:int,label:string,confidence:double>>")
        if not self.enabled or self.recognize is None:
            return crops.select("crop_id", F.lit(False).alias("attempted"), F.lit("disabled" if self.recognize else "not_implemented").alias("status"), none.alias("candidates"))
        scored = self.recognize(crops)
        top = metrics.top_k(F.col("scores"), most)
        names = F.array(*map(F.lit, labels))
        ranked = F.transform(top, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["class_id"].cast("int").alias("class_id"), F.get(names, x["class_id"].cast("int")).alias("label"), x["score"].alias("confidence")))
        bad = F.col("scores").isNull()
        return scored.select("crop_id", F.lit(True).alias("attempted"), F.when(bad, "failed").otherwise("completed").alias("status"), F.when(bad, none).otherwise(ranked).alias("candidates"))


def ordered(features: Column, names: list[str]) -> Column:
    """A map of features as a vector in the persisted order; a missing name is an error
    and further ones are ignored."""
    return F.array(*[F.coalesce(features[n], F.raise_error(F.lit(f"missing feature: {n}")).cast("double")) for n in names])


def forest(rows: DataFrame, trees: int = 20, depth: int = 8, seed: int = 7, least_rows: int = 10) -> RandomForestClassificationModel:
    """A random forest on (class, vector); too few rows or one class is an error."""
    n, classes = rows.agg(F.count("*"), F.countDistinct("class")).first()
    if n < least_rows or classes < 2:
        raise ValueError(f"{n} rows of {classes} classes don't suffice")
    data = rows.select(F.col("class").cast("double").alias("label"), array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)


def predicted(model: RandomForestClassificationModel, rows: DataFrame, key: str) -> DataFrame:
    """key, class (if there), said, and the probabilities of all classes."""
    keep = [c for c in (key, "class") if c in rows.columns]
    data = rows.select(*keep, array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return model.transform(data).select(*keep, F.col("prediction").cast("int").alias("said"), vector_to_array("probability").alias("scores"))


def importances(model: RandomForestClassificationModel, names: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(names, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))
