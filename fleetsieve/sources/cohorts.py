"""Datasets carved out of cohorts: case against control, one label against healthy, traits,
replicated measurements, marker matrices."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.sampling import sample_n
from fleetsieve.functions.text import strip
from fleetsieve.session import written


def case_control(meta: DataFrame, healthy=V.HEALTHY_CONDITIONS, skipped=V.SKIPPED_CONDITIONS,
                 min_cases=V.MIN_CASES, min_controls=V.MIN_CONTROLS) -> DataFrame:
    """sample, study, label, side: cases of each condition and the controls of the studies
    that hold at least one of them, for all conditions in one join. ``meta`` has sample,
    study, condition. What samples meet, a row per label or per study and label, is written, so while
    it is small no label's samples meet in one task."""
    known = meta.select("sample", "study", F.lower(strip(F.col("condition"))).alias("label"))
    cases = known.where(~F.col("label").isin(*healthy, *skipped))
    controls = known.where(F.col("label").isin(*healthy)).select("sample", "study")
    wanted = written(cases.select("study", "label").distinct(), "wanted")
    matched = controls.join(wanted, "study").select("sample", "study", "label", F.lit("healthy").alias("side"))
    both = cases.withColumn("side", F.lit("disease")).unionByName(matched)
    sizes = both.groupBy("label").agg(F.count_if(F.col("side") == "disease").alias("n_cases"),
                                      F.count_if(F.col("side") == "healthy").alias("n_controls"))
    enough = sizes.where((F.col("n_cases") >= min_cases) & (F.col("n_controls") >= min_controls))
    return both.join(written(enough.withColumn("n_each", F.least("n_cases", "n_controls")), "enough"), "label")


def balanced(sides: DataFrame, seed: str = "0", salts: int = 1) -> DataFrame:
    """Equal numbers of cases and controls per label, drawn in md5 order."""
    return sample_n(sides, ["label", "side"], "n_each", seed, "sample", salts)


def one_vs_healthy(labels: DataFrame, healthy=V.HEALTHY_CODES, min_cases=V.MIN_CASES, blocks: int = 64) -> DataFrame:
    """sample, disease, label: for each frequent disease its patients and all healthy ones.
    Each healthy sample is repeated once per frequent disease, which is the output itself;
    the list of diseases is a table that meets one of ``blocks`` parts of them at a time."""
    known = labels.select("sample", F.trim("disease").alias("disease"))
    is_healthy = F.col("disease").isin(*healthy)
    frequent = (known.where(~is_healthy).groupBy("disease").agg(F.count("*").alias("n"))
                .where(F.col("n") >= min_cases).select("disease"))
    frequent = written(frequent, "frequent")
    listed = frequent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ill = known.join(frequent, "disease", "left_semi").select("sample", "disease", F.lit("disease").alias("label"))
    well = (known.where(is_healthy).select("sample", F.pmod(F.hash("sample"), F.lit(blocks)).alias("block"))
            .join(listed, "block").select("sample", "disease", F.lit("healthy").alias("label")))
    return ill.unionByName(well)


def prevalent_markers(markers: DataFrame, share=V.MIN_PREVALENCE) -> DataFrame:
    """Features that are 0/1 in every sample and 1 in at least ``share`` of them.
    ``markers`` has feature, sample, value (text)."""
    return (markers.groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") == "1").alias("ones"),
        F.count_if(F.col("value") == "0").alias("zeros"))
        .where((F.col("ones") + F.col("zeros") == F.col("n")) & (F.col("ones") >= F.col("n") * share)))


def trait_datasets(meta: DataFrame, traits=V.TRAITS, id_col: str = "sample") -> DataFrame:
    """trait, sample, value for every listed trait that is a column, rows with a value."""
    have = [t for t in traits if t in meta.columns]
    tall = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).cast("double").alias("value")) for t in have])
    return (meta.select(id_col, F.explode(tall).alias("p")).select(id_col, "p.*")
            .where(F.col("value").isNotNull()))


def collapse_replicates(measurements: DataFrame, key: str, value: str, by=()) -> DataFrame:
    """One row per key with the exact median of its measurements. Equal measurements are
    counted together first, so a key measured very often stays a short list."""
    counted = (measurements.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(value).isNotNull())
               .groupBy(*by, key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w")))
    return counted.groupBy(*by, key).agg(F.percentile("v", F.lit(0.5), F.col("w")).alias(value))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Labels by falling frequency, then by label."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), col))
