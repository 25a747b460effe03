"""Column profiles and moments. Cells come straight from the sample arrays, so each map
task folds them into one row per (dataset, column) before anything is exchanged."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet
from fleetsieve.functions.stats import r6, ratio
from fleetsieve.functions.text import fails_number

COLUMN = ["dataset_id", "feat_id"]


def numeric_summary(fleet: Fleet) -> DataFrame:
    """Counts, moments and extremes of every numeric column in one pass over the cells; profile and
    moments both follow from it."""
    return fleet.numeric_cells("row_id").groupBy(*COLUMN).agg(
        F.count("*").alias("n"), F.count("num").alias("n_present"),
        F.avg("num").alias("mean"), F.var_pop("num").alias("var"),
        F.min("num").alias("lo"), F.max("num").alias("hi"),
        F.skewness("num").alias("skew"), F.kurtosis("num").alias("kurt"))


def numeric_profile(fleet: Fleet, summary: DataFrame | None = None) -> DataFrame:
    found = numeric_summary(fleet) if summary is None else summary
    return found.select(*COLUMN, F.lit(True).alias("is_num"), "n", "n_present", "mean", "var", "lo", "hi",
                        (F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))).alias("constant"),
                        F.lit(False).alias("mixed"))


def text_profile(fleet: Fleet) -> DataFrame:
    cells = fleet.text_cells()
    return cells.groupBy(*COLUMN).agg(
        F.count("*").alias("n"), F.count("str").alias("n_present"),
        F.coalesce(F.min("str") == F.max("str"), F.lit(True)).alias("constant"),
        F.coalesce(F.bool_or(fails_number(F.col("str"))), F.lit(False)).alias("mixed"))


def column_profile(fleet: Fleet, summary: DataFrame | None = None) -> DataFrame:
    """One row per column of every dataset. Whether a column is constant only needs its
    extremes, so the costly distinct count is a separate operator."""
    return (numeric_profile(fleet, summary).unionByName(text_profile(fleet)
                                                        .withColumn("is_num", F.lit(False)),
                                                        allowMissingColumns=True)
            .withColumn("missing", F.col("n") - F.col("n_present"))
            .withColumn("missing_rate", ratio(F.col("n") - F.col("n_present"), F.col("n"))))


def distinct_counts(fleet: Fleet) -> DataFrame:
    """Exact distinct non-null values per column in two aggregation levels."""
    cells = fleet.cells().select(*COLUMN, F.coalesce(F.col("num").cast("string"), "str").alias("v"))
    return (cells.where(F.col("v").isNotNull()).distinct()
            .groupBy(*COLUMN).agg(F.count("*").alias("n_unique")))


def column_moments(fleet: Fleet, summary: DataFrame | None = None) -> DataFrame:
    """Mean, sample deviation, biased skewness, biased excess kurtosis of every numeric
    column with two values and spread."""
    found = numeric_summary(fleet) if summary is None else summary
    n, var = F.col("n_present"), F.col("var")
    return (found.where((n >= 2) & (F.col("lo") < F.col("hi")) & (var > 0))
            .select(*COLUMN, n.alias("n"), "mean", F.sqrt(var * n / F.nullif(n - 1, F.lit(0))).alias("std"), "skew", "kurt"))


MOMENTS = ["mean", "std", "skew", "kurt"]


def fingerprint(datasets: DataFrame, moments: DataFrame) -> DataFrame:
    """28 numbers per dataset: seven summaries of each of the four moments over columns.
    A dataset without usable columns gets zeros."""
    shares = F.array(*map(F.lit, V.FINGERPRINT_QUANTILES))
    aggs = []
    for m in MOMENTS:
        aggs += [F.percentile(m, shares).alias(f"{m}_q"), F.avg(m).alias(f"{m}_avg"),
                 F.stddev_pop(m).alias(f"{m}_sd")]
    blocks = moments.groupBy("dataset_id").agg(*aggs)
    parts = [F.concat(F.coalesce(f"{m}_q", F.array(*[F.lit(0.0)] * 5)),
                      F.array(F.coalesce(f"{m}_avg", F.lit(0.0)), F.coalesce(f"{m}_sd", F.lit(0.0))))
             for m in MOMENTS]
    return (datasets.select("dataset_id", "source").join(blocks, "dataset_id", "left")
            .select("dataset_id", "source", F.concat(*parts).alias("vec")))


def fingerprint_rows(prints: DataFrame) -> DataFrame:
    return prints.select("source", "dataset_id", F.posexplode("vec").alias("dim", "v"))


def top_variance(profile: DataFrame, k: int | None = V.MAX_HEAVY_FEATURES) -> DataFrame:
    """The k most variable numeric columns per dataset; ties go to the lower column.
    ``None`` keeps all."""
    if k is None:
        return profile.where("is_num")
    order = Window.partitionBy("dataset_id").orderBy(F.col("var").desc_nulls_last(), "feat_id")
    return (profile.where("is_num").withColumn("var_rank", F.row_number().over(order))
            .where(F.col("var_rank") <= k))


def class_counts(fleet: Fleet) -> DataFrame:
    return (fleet.targets().where(F.col("y_str").isNotNull())
            .groupBy("dataset_id", F.col("y_str").alias("cls")).agg(F.count("*").alias("n")))


def bin_number(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1, last bin closed, one bin when the range is empty."""
    place = F.floor(F.try_divide(v - lo, hi - lo) * bins)
    return F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")


def target_histogram(fleet: Fleet, bins: int = V.REGRESSION_BINS) -> DataFrame:
    y = fleet.targets().where(F.col("y_num").isNotNull()).select("dataset_id", "y_num")
    ends = y.groupBy("dataset_id").agg(F.min("y_num").alias("lo"), F.max("y_num").alias("hi"))
    return (y.join(ends, "dataset_id")
            .groupBy("dataset_id", bin_number(F.col("y_num"), F.col("lo"), F.col("hi"), bins).alias("bin"))
            .agg(F.count("*").alias("n")))
