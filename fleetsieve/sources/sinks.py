"""Tables written between phases and at the end of a run."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet
from fleetsieve.operators.weights import correlation, default_weights, impute_median, minmax, results_table


def write_fleet(fleet: Fleet, path: str, mode: str = "error") -> None:
    """The fleet as Parquet, partitioned by source. Samples of a dataset are kept together
    by the sort inside each file, so row-group statistics prune a read of few datasets."""
    where = fleet.datasets.select("dataset_id", "source")
    fleet.datasets.write.mode(mode).parquet(f"{path}/datasets")
    fleet.features.write.mode(mode).parquet(f"{path}/features")
    (fleet.samples.join(where, "dataset_id").sortWithinPartitions("source", "dataset_id")
     .write.mode(mode).partitionBy("source").parquet(f"{path}/samples"))


def read_fleet(spark, path: str) -> Fleet:
    return Fleet(spark.read.parquet(f"{path}/datasets"), spark.read.parquet(f"{path}/features"),
                 spark.read.parquet(f"{path}/samples").drop("source"))


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_weights(pointed: DataFrame, n_datasets: int, path: str, source: str, mode: str = "error") -> None:
    """One JSON record: derivation date, number of datasets, source and a weight per rule."""
    per_rule = [F.max(F.when(F.col("rule") == r, F.col("final_pts"))).alias(r) for r in V.RULES]
    (pointed.agg(*per_rule).select(F.current_date().cast("string").alias("derived_at"), F.lit(n_datasets).alias("n_datasets"),
                                   F.lit(source).alias("source"), *V.RULES).write.mode(mode).json(path))


def load_weights(spark, path: str | None = None) -> DataFrame:
    """rule, w from a frozen record, the expert points where there is none. Only rules in the
    record are used."""
    from pyspark.errors import AnalysisException
    if path is None:
        return default_weights(spark)
    try:
        frozen = spark.read.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return default_weights(spark)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("w")) for r in V.RULES if r in frozen.columns])
    return frozen.select(F.explode(rows).alias("p")).select("p.*").where(F.col("w").isNotNull())


def write_calibration(scores: DataFrame, pointed: DataFrame, n_datasets: int, path: str, source: str) -> None:
    write_weights(pointed, n_datasets, f"{path}/critic_weights", source)
    write_csv(results_table(pointed), f"{path}/critic_results")
    write_csv(correlation(minmax(impute_median(scores))).withColumn("r", F.round("r", 4)), f"{path}/critic_correlations")
