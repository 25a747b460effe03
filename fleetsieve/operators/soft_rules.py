"""Soft rules S1..S6: one row per dataset, score in [0, 1] or NULL when not applicable."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet
from fleetsieve.functions.ranking import average_rank
from fleetsieve.functions.stats import clamp01, ratio
from fleetsieve.operators import profile as P
from fleetsieve.session import written

BLOCK = 2048


# ------------------------------------------------------------------ S1 uniqueness
def standardised(prints: DataFrame, pool: str = "source") -> DataFrame:
    """Unit vectors of the pool-standardised fingerprints (NULL when the norm is zero)."""
    whole = [pool] if pool == "source" else []
    rows = P.fingerprint_rows(prints)
    stats = rows.groupBy(*whole, "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    pools = (stats.groupBy(*whole)
             .agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("pool")))
    joined = prints.join(pools, whole) if whole else prints.crossJoin(F.broadcast(pools))
    z = joined.select("source", "dataset_id", F.zip_with(
        "vec", "pool", lambda v, p: (v - p["m"]) / (p["s"] + 1e-9)).alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    return z.withColumn("norm", norm).select(
        "source", "dataset_id",
        F.when(F.col("norm") > 0, F.transform("z", lambda x: x / F.col("norm"))).alias("unit"))


def max_cosine(units: DataFrame, pool: str = "source", block: int = BLOCK) -> DataFrame:
    """Largest cosine of each vector to another one of its pool, floored at 0.

    Vectors are dealt into blocks of bounded size; every pair of blocks is one matrix
    product in one task which hands back a single number per vector, so neither a large
    pool nor its pairs ever meet in one place."""
    units = units.where(F.col("unit").isNotNull()).withColumn("pool", F.lit("all") if pool != "source"
                                                              else F.col("source"))
    sizes = units.groupBy("pool").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("dataset_id"), F.col("blocks")).cast("int")
    dealt = (units.join(sizes, "pool").withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("pool", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"),
                     "mine", "dataset_id", "unit"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["mine"] == pdf["b1"]]
        right = pdf[pdf["mine"] == pdf["b2"]]
        if left.empty or right.empty:
            return pd.DataFrame(columns=["dataset_id", "best"], dtype=object)
        cos = np.stack(left["unit"].to_list()) @ np.stack(right["unit"].to_list()).T
        if left["mine"].iloc[0] == right["mine"].iloc[0]:
            np.fill_diagonal(cos, -np.inf)
        out = pd.concat([
            pd.DataFrame({"dataset_id": left["dataset_id"].to_numpy(), "best": cos.max(axis=1)}),
            pd.DataFrame({"dataset_id": right["dataset_id"].to_numpy(), "best": cos.max(axis=0)})])
        return out.groupby("dataset_id", as_index=False)["best"].max()

    return (dealt.groupBy("pool", "b1", "b2").applyInPandas(best, "dataset_id string, best double")
            .groupBy("dataset_id").agg(F.greatest(F.max("best"), F.lit(0.0)).alias("max_similarity")))


def s1_uniqueness(prints: DataFrame, pool: str = "source") -> DataFrame:
    near = max_cosine(standardised(prints, pool), pool)
    sim = F.coalesce("max_similarity", F.lit(0.0))
    return prints.select("dataset_id", "source").join(near, "dataset_id", "left").select(
        "dataset_id", "source", sim.alias("max_similarity"), clamp01(1.0 - sim).alias("score"))


# ------------------------------------------------------- S2 duplicated samples
def row_digest(*seed):
    """128-bit digest of a whole sample: all columns and the target, missing equal missing.
    NaN never occurs after ingest, so it can stand for a missing number in the hash."""
    num = F.transform("num", lambda x: F.coalesce(x, F.lit(float("nan"))))
    txt = F.transform("txt", lambda x: F.coalesce(x, F.lit("\u0000")))
    y = F.coalesce("y_str", F.lit("\u0000"))
    yn = F.coalesce("y_num", F.lit(float("nan")))
    return F.xxhash64(num, txt, y, yn), F.xxhash64(F.lit(1), yn, y, txt, num)


def s2_sample_duplication(fleet: Fleet) -> DataFrame:
    a, b = row_digest()
    groups = (fleet.samples.select("dataset_id", a.alias("h1"), b.alias("h2"))
              .groupBy("dataset_id", "h1", "h2").agg(F.count("*").alias("n")))
    found = groups.groupBy("dataset_id").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_groups"))
    share = F.coalesce(ratio(F.col("n_duplicate_rows"), F.col("n_rows")), F.lit(0.0))
    return fleet.datasets.select("dataset_id").join(found, "dataset_id", "left").select(
        "dataset_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                        for c in ("n_rows", "n_duplicate_rows", "n_duplicate_groups")],
        share.alias("duplicate_fraction"), (1.0 - share).alias("score"))


# ------------------------------------------------------------- S3 data quality
def quality_parts(profile: DataFrame) -> DataFrame:
    """Completeness, non-constant share and consistency of every dataset in one pass."""
    return profile.groupBy("dataset_id").agg(
        F.count("*").alias("n_features"),
        F.count_if(F.col("missing") > 0).alias("n_cols_with_missing"),
        F.avg("missing_rate").alias("mean_missing_rate"),
        F.max("missing_rate").alias("max_missing_rate"),
        (1.0 - F.avg("missing_rate")).alias("c_miss"),
        F.count_if("constant").alias("n_constant"),
        (1.0 - ratio(F.count_if("constant"), F.count("*"))).alias("c_const"),
        F.count_if("mixed").alias("n_mixed"),
        (1.0 - ratio(F.count_if("mixed"), F.count("*"))).alias("c_consist"))


def s3_data_quality(datasets: DataFrame, parts: DataFrame, outliers: DataFrame | None = None,
                    weights=None) -> DataFrame:
    """Weighted mean over the sub-metrics that apply; ``outliers`` has dataset_id, c_out."""
    weights = weights or V.QUALITY_WEIGHTS
    joined = datasets.select("dataset_id").join(parts, "dataset_id", "left")
    joined = (joined.join(outliers.select("dataset_id", "c_out"), "dataset_id", "left")
              if outliers is not None else joined.withColumn("c_out", F.lit(None).cast("double")))
    top = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0)
                  for k, w in weights.items()), F.lit(0.0))
    return joined.select("dataset_id", *weights, F.try_divide(top, bottom).alias("score"))


# ------------------------------------------------------------ S4 target leakage
def _with_means(counts: DataFrame, profile: DataFrame, k: int) -> DataFrame:
    """Counts per distinct value as ``v``, means in place of missing values, for the k most
    variable non-constant columns. Only reduced counts meet the profile, never cells."""
    kept = P.top_variance(profile, k).where(~F.col("constant")).select("dataset_id", "feat_id", "mean")
    return (counts.join(kept, ["dataset_id", "feat_id"])
            .withColumn("v", F.coalesce("num", "mean")).drop("num", "mean"))


def auc_per_feature(fleet: Fleet, profile: DataFrame, k: int | None = None) -> DataFrame:
    """Per column the most extreme one-vs-rest AUC over classes as 2*min(AUC, 1-AUC)."""
    fleet = fleet.by_task("classification")
    cells = fleet.numeric_cells("y_str").where(F.col("y_str").isNotNull())
    counts = cells.groupBy("dataset_id", "feat_id", "num", "y_str").agg(F.count("*").alias("w"))
    counts = _with_means(counts, profile, k)
    ranked = average_rank(counts, ["dataset_id", "feat_id"], "v", "w", "rank")
    per_class = ranked.groupBy("dataset_id", "feat_id", "y_str").agg(
        F.sum(F.col("w") * F.col("rank")).alias("rank_sum"), F.sum("w").alias("n_pos"))
    every = Window.partitionBy("dataset_id", "feat_id")
    n_neg = F.sum("n_pos").over(every) - F.col("n_pos")
    auc = F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0,
                       (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return (per_class.withColumn("n_neg", n_neg).withColumn("auc", auc)
            .groupBy("dataset_id", "feat_id")
            .agg(F.coalesce(F.least(F.min(2.0 * F.least(F.col("auc"), 1.0 - F.col("auc"))), F.lit(1.0)),
                            F.lit(1.0)).alias("stat")))


def spearman_per_feature(fleet: Fleet, profile: DataFrame, k: int | None = None) -> DataFrame:
    """Per column 1 - |rank correlation with a numeric target|, 1 when undefined."""
    fleet = fleet.by_task("regression")
    targets = (fleet.samples.select("dataset_id", "y_num").where(F.col("y_num").isNotNull())
               .groupBy("dataset_id", "y_num").agg(F.count("*").alias("w")))
    ry = written(average_rank(targets, ["dataset_id"], "y_num", "w", "ry"), "target-ranks")
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    totals = ry.groupBy("dataset_id").agg(F.sum("w").alias("n"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"))
    # the target is ranked once per dataset, so a cell only adds its target rank to the sum of
    # its value: cells shrink to distinct values in the map tasks
    cells = (fleet.samples.join(ry.select("dataset_id", "y_num", "ry"), ["dataset_id", "y_num"])
             .select("dataset_id", "ry", F.posexplode("num").alias("feat_id", "num")))
    counts = cells.groupBy("dataset_id", "feat_id", "num").agg(F.count("*").alias("w"), F.sum("ry").alias("of_y"))
    column = ["dataset_id", "feat_id"]
    ranked = average_rank(_with_means(counts, profile, k), column, "v", "w", "rx")
    sums = ranked.groupBy(*column).agg(
        F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(F.col("of_y") * x).alias("sxy")).join(totals, "dataset_id")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
                    * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")))
    rho = F.when(spread > 0, F.try_divide(cov, spread)).otherwise(0.0)
    return sums.select(*column, (1.0 - F.abs(rho)).alias("stat"))


def feature_stats(fleet: Fleet, profile: DataFrame, k: int | None = None) -> DataFrame:
    profile = written(profile, "profile")
    return auc_per_feature(fleet, profile, k).unionByName(spearman_per_feature(fleet, profile, k))


def s4_leakage(datasets: DataFrame, stats: DataFrame) -> DataFrame:
    agg = stats.groupBy("dataset_id").agg(
        F.min("stat").alias("top_stat"), F.percentile("stat", F.lit(0.5)).alias("median_stat"),
        F.count("*").alias("n_features_scored"))
    gap = F.col("median_stat") - F.col("top_stat")
    return datasets.select("dataset_id").join(agg, "dataset_id", "left").select(
        "dataset_id", "top_stat", "median_stat", gap.alias("gap"),
        F.coalesce("n_features_scored", F.lit(0)).alias("n_features_scored"),
        F.when(gap.isNotNull(), F.greatest(F.lit(0.0), 1.0 - gap)).alias("score"))


def top_leaks(stats: DataFrame, features: DataFrame, k: int = 5) -> DataFrame:
    """The k most predictive columns of every dataset, by name."""
    order = Window.partitionBy("dataset_id").orderBy("stat", "feat_id")
    return (stats.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
            .join(features.select("dataset_id", "feat_id", "feat"), ["dataset_id", "feat_id"]))


# ------------------------------------------------------------- S5 class balance
def s5_class_balance(fleet: Fleet, bins: int = V.REGRESSION_BINS) -> DataFrame:
    fleet = fleet.by_task()
    tasks = fleet.datasets.select("dataset_id", F.col("task_type").contains("classification").alias("clf"))
    counts = (P.class_counts(fleet).select("dataset_id", "n", F.lit(True).alias("clf"))
              .unionByName(P.target_histogram(fleet, bins).select("dataset_id", "n", F.lit(False).alias("clf"))))
    entropy = F.sum(F.col("n") * F.ln("n"))
    total = F.sum("n")
    sums = counts.groupBy("dataset_id", "clf").agg(
        F.count("*").alias("k"), (F.ln(total) - entropy / total).alias("entropy"))
    return tasks.join(sums, ["dataset_id", "clf"], "left").select(
        "dataset_id", F.coalesce("k", F.lit(0)).alias("k"), "entropy",
        F.when(F.col("k") >= 2, F.try_divide("entropy", F.ln("k"))).otherwise(0.0).alias("score"))


# ------------------------------------------------------------- S6 batch effects
def s6_batch_effect(fleet: Fleet) -> DataFrame:
    """1 - normalised mutual information of target and batch; NULL without batches."""
    y = F.coalesce("y_str", F.col("y_num").cast("string"))
    table = (fleet.targets().where(F.col("batch").isNotNull() & y.isNotNull())
             .groupBy("dataset_id", y.alias("y"), "batch").agg(F.count("*").alias("n")))

    def entropy(*by):
        counts = table.groupBy("dataset_id", *by).agg(F.sum("n").alias("n"))
        return counts.groupBy("dataset_id").agg(
            (F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("h"))

    hy, hb, hj = entropy("y"), entropy("batch"), entropy("y", "batch")
    joined = (hy.withColumnRenamed("h", "hy").join(hb.withColumnRenamed("h", "hb"), "dataset_id")
              .join(hj.withColumnRenamed("h", "hj"), "dataset_id"))
    mi = F.greatest(F.col("hy") + F.col("hb") - F.col("hj"), F.lit(0.0))
    mean = (F.col("hy") + F.col("hb")) / 2.0
    nmi = F.when(mean < 1e-15, 1.0).otherwise(F.try_divide(mi, mean))
    return fleet.datasets.select("dataset_id").join(
        joined.select("dataset_id", nmi.alias("nmi")), "dataset_id", "left"
    ).select("dataset_id", "nmi", (1.0 - F.col("nmi")).alias("score"))


def soft_scores(**rules: DataFrame) -> DataFrame:
    """Tall score table from one frame per rule."""
    out = None
    for name, df in rules.items():
        part = df.select("dataset_id", F.lit(name).alias("rule"), "score")
        out = part if out is None else out.unionByName(part)
    return out
