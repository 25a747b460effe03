"""The fleet: many datasets of different width held in three tables.

``datasets``  one row per dataset: dataset_id, source, pos, name, task_type, domain, url
``features``  one row per column: dataset_id, feat_id, feat, is_num
``samples``   one row per sample: dataset_id, row_id, num ARRAY<DOUBLE>, txt ARRAY<STRING>,
              y_str, y_num, batch

A sample keeps its numeric columns in one array and its text columns in another, numeric
columns first in ``feat_id`` order. Row-wise rules then need no shuffle at all, and
column-wise rules explode the arrays right below a map-side aggregation, so cells are
never exchanged between executors before they are reduced.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve.session import written

DATASET_COLUMNS = ["dataset_id", "source", "pos", "name", "task_type", "domain", "url"]
SAMPLE_COLUMNS = ["dataset_id", "row_id", "num", "txt", "y_str", "y_num", "batch"]


@dataclass
class Fleet:
    datasets: DataFrame
    features: DataFrame
    samples: DataFrame

    def cells(self) -> DataFrame:
        """Tall form: one row per (dataset, sample, column), missing cells kept as NULL."""
        return self.numeric_cells().unionByName(self.text_cells())

    def numeric_cells(self, *keep: str) -> DataFrame:
        base = ["dataset_id", *(keep or ("row_id",))]
        cells = self.samples.select(*base, F.posexplode("num").alias("feat_id", "num"))
        if keep:
            return cells
        return cells.select(
            "dataset_id", "row_id", "feat_id", F.lit(True).alias("is_num"),
            "num", F.lit(None).cast("string").alias("str"))

    def text_cells(self) -> DataFrame:
        cells = self.samples.select(
            "dataset_id", "row_id", F.size("num").alias("shift"),
            F.posexplode("txt").alias("p", "str"))
        return cells.select(
            "dataset_id", "row_id", (F.col("shift") + F.col("p")).alias("feat_id"),
            F.lit(False).alias("is_num"), F.lit(None).cast("double").alias("num"), "str")

    def targets(self) -> DataFrame:
        return self.samples.select("dataset_id", "row_id", "y_str", "y_num", "batch")

    def by_task(self, only: str | None = None) -> "Fleet":
        """Targets as the task reads them: numbers are class names in classification, numeric
        text is a number in regression. ``only`` keeps the samples of "classification" or of
        "regression" (without classification). The flags are written, a row per dataset: while
        that table is small the wide samples aren't exchanged."""
        task = F.col("task_type")
        kind = self.datasets.select("dataset_id", task.contains("classification").alias("_clf"), task.contains("regression").alias("_reg"))
        if only is not None:
            kind = kind.where(F.col("_clf") if only == "classification" else F.col("_reg") & ~F.col("_clf"))
        kind = written(kind, "kinds")
        label = F.coalesce("y_str", F.when(F.col("_clf"), F.col("y_num").cast("string")))
        number = F.coalesce("y_num", F.when(F.col("_reg") & ~F.col("_clf"), F.expr("try_cast(y_str AS DOUBLE)")))
        samples = (self.samples.join(kind, "dataset_id", "left" if only is None else "inner").withColumn("_label", label).withColumn("y_num", number)
                   .withColumn("y_str", F.col("_label")).select(*self.samples.columns))
        return Fleet(self.datasets, self.features, samples)

    def only(self, ids: DataFrame) -> "Fleet":
        """The part of the fleet whose ``dataset_id`` is in ``ids``."""
        ids = ids.select("dataset_id").distinct()
        return replace(
            self,
            datasets=self.datasets.join(ids, "dataset_id", "left_semi"),
            features=self.features.join(ids, "dataset_id", "left_semi"),
            samples=self.samples.join(ids, "dataset_id", "left_semi"),
        )


def clean(column):
    """Missing values have one form: NaN becomes NULL on the way in."""
    return F.nullif(column.cast("double"), F.lit(float("nan")))


def melt(df: DataFrame, dataset_id: str, id_col: str, y_col: str | None = None,
         batch_col: str | None = None):
    """Wide frame to (features, samples) of one dataset; types decide number or text."""
    taken = {id_col, y_col, batch_col}
    kinds = dict(df.dtypes)
    numeric_types = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def numeric(name):
        return kinds[name] in numeric_types or kinds[name].startswith("decimal")

    numbers = [c for c in df.columns if c not in taken and numeric(c)]
    texts = [c for c in df.columns if c not in taken and not numeric(c)]
    q = lambda c: F.col("`%s`" % c.replace("`", "``"))
    y_is_num = y_col is not None and numeric(y_col)
    samples = df.select(
        F.lit(dataset_id).alias("dataset_id"), q(id_col).cast("bigint").alias("row_id"),
        (F.array(*[clean(q(c)) for c in numbers]) if numbers
         else F.array().cast("array<double>")).alias("num"),
        (F.array(*[q(c).cast("string") for c in texts]) if texts
         else F.array().cast("array<string>")).alias("txt"),
        (q(y_col).cast("string") if y_col else F.lit(None).cast("string")).alias("y_str"),
        (clean(q(y_col)) if y_is_num else F.lit(None).cast("double")).alias("y_num"),
        (q(batch_col).cast("string") if batch_col
         else F.lit(None).cast("string")).alias("batch"))
    features = feature_rows(df.sparkSession, {dataset_id: (numbers, texts)})
    return features, samples


def feature_rows(spark, names) -> DataFrame:
    """``features`` rows from {dataset_id: (numeric names, text names)}."""
    rows = []
    for dataset_id, (numbers, texts) in names.items():
        rows += [(dataset_id, i, c, True) for i, c in enumerate(numbers)]
        rows += [(dataset_id, len(numbers) + i, c, False) for i, c in enumerate(texts)]
    return spark.createDataFrame(
        rows, "dataset_id string, feat_id int, feat string, is_num boolean")
