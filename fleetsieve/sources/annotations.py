"""Sample annotations to classification targets.

``lines``  one row per annotation line: study, sample, sample_pos, line_pos, line
``texts``  one row per sample: study, sample, sample_pos, text (all its free text)"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.stats import ratio
from fleetsieve.functions.text import contains_any, key_value, strip


def attributes(lines: DataFrame) -> DataFrame:
    """Every ``key: value`` line as study, sample, seen, key, value; other lines are dropped."""
    key, value = key_value(F.col("line"))
    return (lines.select("study", "sample", F.struct("sample_pos", "line_pos").alias("seen"),
                         key.alias("key"), value.alias("value")).where(F.col("key").isNotNull()))


def first_values(attrs: DataFrame) -> DataFrame:
    """The first value of each key of a sample."""
    return attrs.groupBy("study", "sample", "key").agg(F.min_by("value", "seen").alias("value"))


def score_characteristics(attrs: DataFrame, low=V.LABEL_MIN_CLASSES, high=V.LABEL_MAX_CLASSES) -> DataFrame:
    """Score of each key of a study as a classification target: number of values, balance,
    coverage, doubled for phenotype words and cut to a tenth for technical words."""
    by_value = attrs.groupBy("study", "key", "value").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    filled = strip(F.col("value")) != ""
    n = F.when(filled, F.col("n"))
    keys = by_value.groupBy("study", "key").agg(
        F.count(n).alias("n_unique"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.sum(n).alias("filled"), F.sum("n").alias("total"), F.min("seen").alias("seen"))
    raw = F.col("n_unique") * ratio(F.col("least"), F.col("most")) * ratio(F.col("filled"), F.col("total"))
    raw = raw * F.when(contains_any(F.col("key"), V.PHENOTYPE_WORDS), 2.0).otherwise(1.0)
    raw = raw * F.when(contains_any(F.col("key"), V.TECHNICAL_WORDS), 0.1).otherwise(1.0)
    return keys.select("study", "key", "seen", "n_unique",
                       F.when(F.col("n_unique").between(low, high), raw).otherwise(0.0).alias("score"))


def best_target(scores: DataFrame) -> DataFrame:
    """The best key of each study; the first seen wins ties, none when nothing scores."""
    order = Window.partitionBy("study").orderBy(F.col("score").desc(), "seen")
    return (scores.where(F.col("score") > 0).withColumn("rn", F.row_number().over(order))
            .where(F.col("rn") == 1).select("study", F.col("key").alias("target")))


def tumor_normal_studies(texts: DataFrame) -> DataFrame:
    """Studies in which both a tumor and a normal word occur."""
    return (texts.groupBy("study").agg(
        F.bool_or(F.col("text").rlike(V.TUMOR_PATTERN)).alias("t"),
        F.bool_or(F.col("text").rlike(V.NORMAL_PATTERN)).alias("n"))
        .where(F.col("t") & F.col("n")).select("study", F.lit(True).alias("both")))


def sample_labels(texts: DataFrame, attrs: DataFrame, targets: DataFrame) -> DataFrame:
    """One label per sample: tumor or normal by its text, else its value of the target key."""
    chosen = (first_values(attrs).join(targets, "study").where(F.col("key") == F.col("target"))
              .select("study", "sample", F.nullif("value", F.lit("")).alias("value")))
    joined = (texts.join(tumor_normal_studies(texts), "study", "left")
              .join(chosen, ["study", "sample"], "left"))
    label = (F.when(F.col("both") & F.col("text").rlike(V.TUMOR_PATTERN), "tumor")
             .when(F.col("both") & F.col("text").rlike(V.NORMAL_PATTERN), "normal")
             .otherwise(F.col("value")))
    return joined.select("study", "sample", label.alias("label")).where(F.col("label").isNotNull())


def study_summary(texts: DataFrame, attrs: DataFrame, platforms: DataFrame, shown: int = 20) -> DataFrame:
    """Per usable study: first platform, its probe count, number of classes, first labels.
    ``platforms`` has study, pos, platform, n_probes."""
    values = (attrs.join(best_target(score_characteristics(attrs)), "study")
              .where((F.col("key") == F.col("target")) & (F.col("value") != ""))
              .select("study", "value").distinct())
    # only studies whose label count is in range keep a label list, so lists stay short
    few = (values.groupBy("study").agg(F.count("*").alias("k"))
           .where(F.col("k").between(V.LABEL_MIN_CLASSES, V.LABEL_MAX_CLASSES)))
    labels = (values.join(few, "study").groupBy("study")
              .agg(F.array_sort(F.collect_list("value")).alias("found")))
    first = platforms.groupBy("study").agg(
        F.min_by("platform", "pos").alias("platform"), F.min_by("n_probes", "pos").alias("n_features"))
    both = tumor_normal_studies(texts)
    classes = F.when(F.col("both"), F.array(F.lit("normal"), F.lit("tumor"))).otherwise(F.col("found"))
    return (texts.select("study").distinct().join(both, "study", "left").join(labels, "study", "left")
            .join(first, "study", "left").withColumn("classes", classes).where(F.col("classes").isNotNull())
            .select("study", F.coalesce("platform", F.lit("")).alias("platform"),
                    F.nullif("n_features", F.lit(0)).alias("n_features"), F.size("classes").alias("n_classes"),
                    F.array_join(F.slice("classes", 1, shown), ", ").alias("class_labels")))


def auto_target_field(attrs: DataFrame, min_group=V.FIELD_MIN_GROUP, max_groups=V.FIELD_MAX_GROUPS) -> DataFrame:
    """dataset_id, sample, label: the alphabetically first usable metadata field that splits
    the samples into 2..max_groups groups of at least min_group; smaller groups are dropped.
    ``attrs`` has dataset_id, sample, key, value."""
    from fleetsieve.sources.catalogs import keep_field
    usable = attrs.where(keep_field(F.col("key")) & F.col("value").isNotNull() & (F.col("value") != "")).select(
        "dataset_id", "sample", "key", F.lower(strip(F.col("value"))).alias("label"))
    groups = (usable.groupBy("dataset_id", "key", "label").agg(F.count("*").alias("n"))
              .where(F.col("n") >= min_group))
    field = (groups.groupBy("dataset_id", "key").agg(F.count("*").alias("k"))
             .where(F.col("k").between(2, max_groups)).groupBy("dataset_id").agg(F.min("key").alias("key")))
    big = groups.join(field, ["dataset_id", "key"], "left_semi").select("dataset_id", "key", "label")
    return usable.join(big, ["dataset_id", "key", "label"], "left_semi").select(
        "dataset_id", "sample", F.col("key").alias("field"), "label")


def resolve_sample_ids(analyses: DataFrame) -> DataFrame:
    """Run or assembly id to sample id and instrument. The last analysis wins for both;
    analyses without a sample are skipped. ``analyses`` has study, pos, sample, run,
    assembly, instrument."""
    known = analyses.where(F.col("sample").isNotNull())
    refs = (known.select("study", "pos", "sample", F.explode(F.array("run", "assembly")).alias("ref"))
            .where(F.col("ref").isNotNull()).groupBy("study", "ref").agg(F.max_by("sample", "pos").alias("sample")))
    batch = known.groupBy("study", "sample").agg(F.max_by(
        F.coalesce(F.nullif("instrument", F.lit("")), F.lit("na")), "pos").alias("batch"))
    return refs.join(batch, ["study", "sample"], "left").select(
        "study", "ref", "sample", F.lower(F.coalesce("batch", F.lit("na"))).alias("batch"))
