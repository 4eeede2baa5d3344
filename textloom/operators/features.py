"""The four features of a text, and the boosted trees over them."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import vocabulary

NAMES = ("pmi_score", "burstiness", "rttr", "entropy")


def statistical(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with burstiness, rttr and entropy; words are found once. Texts without words have 0 everywhere."""
    return vocabulary.measured(rows, text, None, True)


def extract(rows: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with all four features, in one pass if the vocabulary can be sent to the tasks."""
    weights = vocabulary.weights_of(words)
    if weights is None:
        return statistical(vocabulary.score(rows, words, text=text), text)
    return vocabulary.measured(rows, text, weights, True)


def class_averages(featured: DataFrame, position: str, first: int = 1000, label: str = "label") -> DataFrame:
    """Mean features of the first rows of each label."""
    from pyspark.sql import Window

    ranked = featured.withColumn("__n", F.row_number().over(Window.partitionBy(label).orderBy(position))).where(F.col("__n") <= first)
    return ranked.groupBy(label).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("burstiness", "rttr", "entropy")])


class Detector:
    """Gradient-boosted trees over the four features."""

    def __init__(self, rounds: int = 200, depth: int = 4, rate: float = 0.05, seed: int = 42):
        self.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
        self.model: GBTClassificationModel | None = None

    @staticmethod
    def _vectors(featured: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(featured)

    def train(self, featured: DataFrame) -> Detector:
        rows = self._vectors(featured.select(*NAMES, F.col("label").cast("double").alias("label"))).select("features", "label").persist()
        try:
            self.model = self.trees.fit(rows)
        finally:
            rows.unpersist()
        return self

    def _trained(self) -> GBTClassificationModel:
        if self.model is None:
            raise RuntimeError("the model isn't trained")
        return self.model

    def predict(self, featured: DataFrame) -> DataFrame:
        """``featured`` with probability (of class 1) and predicted (1 above 0.5)."""
        out = self._trained().transform(self._vectors(featured))
        p = vector_to_array(F.col("probability"))[1]
        return out.withColumn("p", p).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("p", "probability").withColumn("predicted", (F.col("probability") > 0.5).cast("int"))

    def importance(self) -> dict[str, float]:
        if self.model is None:
            return {}
        return dict(sorted(zip(NAMES, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1]))

    def save(self, path: str) -> None:
        self._trained().write().overwrite().save(path)

    def load(self, path: str) -> Detector:
        self.model = GBTClassificationModel.load(path)
        return self
