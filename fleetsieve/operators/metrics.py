"""Quality metrics of out-of-fold predictions, for all datasets in the same jobs.

``preds``   dataset_id, row_id, y, yhat (strings for classes, doubles for regression)
``scores``  dataset_id, row_id, y, cls, score: one row per class of the prediction

Class metrics come from the confusion table and threshold metrics from counts per distinct
score, so rows are reduced in the map tasks before the first exchange."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve.functions.ranking import SPLIT, running_total, with_neighbours
from fleetsieve.functions.stats import normal_quantile, ratio
from fleetsieve.session import written

# Fixed value: smallest denominator of the relative error.
EPSILON = 2.220446049250313e-16


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("dataset_id", "y", "yhat").agg(F.count("*").alias("n"))


def per_class(table: DataFrame) -> DataFrame:
    """tp, true and predicted counts, precision, recall, f1 of every class."""
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("y").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("tp")),
                    F.struct(F.col("yhat").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"),
                             F.lit(0).cast("bigint").alias("tp")))
    sums = (table.select("dataset_id", F.explode(sides).alias("s")).select("dataset_id", "s.*")
            .groupBy("dataset_id", "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select("dataset_id", "cls", "tp", "t", "p", zero(ratio(F.col("tp"), F.col("p"))).alias("precision"),
                       zero(ratio(F.col("tp"), F.col("t"))).alias("recall"),
                       zero(ratio(2 * F.col("tp"), F.col("t") + F.col("p"))).alias("f1"))


def classification_metrics(preds: DataFrame) -> DataFrame:
    c = per_class(confusion(preds))
    n, tp, t, p = F.sum("t"), F.sum("tp"), F.col("t").cast("double"), F.col("p").cast("double")
    seen = F.col("t") > 0
    agg = c.groupBy("dataset_id").agg(
        ratio(tp, n).alias("accuracy"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        n.cast("double").alias("s"), tp.cast("double").alias("c"), F.sum(t * p).alias("tp_"),
        F.sum(t * t).alias("tt"), F.sum(p * p).alias("pp"), F.count_if(seen).alias("k"))
    root = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    chance = F.try_divide(F.lit(1.0), F.col("k"))
    return agg.select(
        "dataset_id", "accuracy", "balanced_accuracy", "precision", "recall", "f1",
        F.coalesce(F.when(root > 0, F.try_divide(F.col("c") * F.col("s") - F.col("tp_"), root)), F.lit(0.0)).alias("mcc"),
        F.try_divide(F.col("balanced_accuracy") - chance, 1.0 - chance).alias("adj_balanced_accuracy"),
        F.col("k").alias("n_classes"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """All label pairs of a dataset with zeros. The grid is opened from each dataset's own
    short label list."""
    labels = preds.groupBy("dataset_id").agg(F.array_sort(F.collect_set("y")).alias("labels"))
    grid = (labels.select("dataset_id", "labels", F.explode("labels").alias("y"))
            .select("dataset_id", "y", F.explode("labels").alias("yhat")))
    return (grid.join(confusion(preds), ["dataset_id", "y", "yhat"], "left")
            .select("dataset_id", "y", "yhat", F.coalesce("n", F.lit(0)).alias("n")))


def threshold_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score of the classes that are evaluated: the
    larger of two classes, or every class one against the rest."""
    kinds = scores.groupBy("dataset_id").agg(
        F.count_distinct("y").alias("k"), F.max("y").alias("top"))
    hit = F.col("cls") == F.col("y")
    counts = scores.groupBy("dataset_id", "cls", "score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    return (counts.join(kinds, "dataset_id").where((F.col("k") != 2) | (F.col("cls") == F.col("top")))
            .drop("top"))


def roc_auc(scores: DataFrame, split: int = SPLIT) -> DataFrame:
    """Rank-sum AUC, macro over classes; NULL where a class has no positives or negatives."""
    counts = threshold_counts(scores)
    cum = running_total(counts, ["dataset_id", "cls"], "score", "neg", "below", split)
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    each = cum.groupBy("dataset_id", "cls", "k").agg(
        F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))
    return each.groupBy("dataset_id").agg(
        F.when((F.count("auc") == F.count("*")) & (F.max("k") >= 2), F.avg("auc")).alias("roc_auc"))


def average_precision(scores: DataFrame, split: int = SPLIT) -> DataFrame:
    """Sum of recall steps times precision over distinct thresholds, macro over classes."""
    each = (pr_points(scores, split).groupBy("dataset_id", "cls")
            .agg(F.sum(F.col("pos") * F.col("precision")).alias("s"), F.sum("pos").alias("p")))
    return each.groupBy("dataset_id").agg(
        F.avg(F.coalesce(ratio(F.col("s"), F.col("p")), F.lit(0.0))).alias("pr_auc"))


def _cumulated(counts: DataFrame, split):
    counts = counts.withColumn("n", F.col("pos") + F.col("neg"))
    return running_total(counts, ["dataset_id", "cls"], "score", ["pos", "n"], ["tp", "seen"], split, descending=True, stored=True)


def pr_points(scores: DataFrame, split: int = SPLIT) -> DataFrame:
    """dataset_id, cls, score, pos, precision, recall at every distinct threshold."""
    counts = written(threshold_counts(scores), "thresholds")
    totals = counts.groupBy("dataset_id", "cls").agg(F.sum("pos").alias("all_pos"))
    return _cumulated(counts, split).join(totals, ["dataset_id", "cls"]).select(
        "dataset_id", "cls", "score", "pos", ratio(F.col("tp"), F.col("seen")).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("all_pos")), F.lit(1.0)).alias("recall"))


def roc_points(scores: DataFrame, split: int = SPLIT, drop_intermediate: bool = True) -> DataFrame:
    """dataset_id, cls, score, fpr, tpr; points on a straight line between their neighbours
    are left out, and the origin is the point with no score."""
    counts = written(threshold_counts(scores), "thresholds")
    totals = counts.groupBy("dataset_id", "cls").agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    cum = _cumulated(counts, split).select("dataset_id", "cls", "score", "tp", (F.col("seen") - F.col("tp")).alias("fp"))
    if drop_intermediate:
        near = with_neighbours(cum, ["dataset_id", "cls"], "score", ["tp", "fp"], split, descending=True)
        bend = lambda c: (F.col(f"after_{c}") - F.col(c)) - (F.col(c) - F.col(f"before_{c}"))
        cum = (near.where(bend("tp").isNull() | (bend("tp") != 0) | (bend("fp") != 0))
               .select("dataset_id", "cls", "score", "tp", "fp"))
    start = totals.select("dataset_id", "cls", F.lit(None).cast("double").alias("score"),
                          F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    return cum.unionByName(start).join(totals, ["dataset_id", "cls"]).select(
        "dataset_id", "cls", "score", ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("all_pos")).alias("tpr"))


def median_error(preds: DataFrame, split: int = SPLIT) -> DataFrame:
    """dataset_id, median_ae: the middle absolute error, or the mean of the two in the middle."""
    counted = (preds.select("dataset_id", F.abs(F.col("yhat") - F.col("y")).alias("e")).where("e is not null")
               .groupBy("dataset_id", "e").agg(F.count("*").alias("w")))
    counted = written(counted, "errors")
    sizes = counted.groupBy("dataset_id").agg(F.sum("w").alias("n"))
    cum = running_total(counted, ["dataset_id"], "e", "w", "upto", split, stored=True).join(sizes, "dataset_id")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("e")))
    return cum.groupBy("dataset_id").agg(
        ((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2.0).alias("median_ae"))


def regression_metrics(preds: DataFrame, split: int = SPLIT) -> DataFrame:
    return error_totals(preds).join(median_error(preds, split), "dataset_id", "left").select(
        "dataset_id", "r2", "rmse", "mae", "median_ae", "mape", "max_error")


def error_totals(preds: DataFrame) -> DataFrame:
    """The metrics that are plain sums and maxima."""
    e = F.col("yhat") - F.col("y")
    agg = preds.groupBy("dataset_id").agg(
        F.sum(e * e).alias("sse"), F.var_pop("y").alias("v"), F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(EPSILON))).alias("mape"), F.max(F.abs(e)).alias("max_error"))
    flat = F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return agg.select("dataset_id", F.when(F.col("v") == 0, flat).otherwise(
        1.0 - F.try_divide("sse", F.col("v") * F.col("n"))).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "mape", "max_error")


def density2d(points: DataFrame, bins: int = 60) -> DataFrame:
    """``density`` = points in the cell of an equal-width grid; x and y are columns. Cells
    are closed below when counting; a point on an inner edge looks up the cell before it."""
    ends = points.groupBy("dataset_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide = lambda lo, hi: (F.when(F.col(lo) == F.col(hi), F.col(lo) - 0.5).otherwise(F.col(lo)),
                           F.when(F.col(lo) == F.col(hi), F.col(hi) + 0.5).otherwise(F.col(hi)))

    def place(v, lo, hi):
        a, b = wide(lo, hi)
        share = (F.col(v) - a) / (b - a) * bins
        return (F.least(F.floor(share), F.lit(bins - 1)).cast("int"),
                F.greatest(F.ceil(share) - 1, F.lit(0)).cast("int"))

    (xc, xl), (yc, yl) = place("x", "x0", "x1"), place("y", "y0", "y1")
    cells = points.join(ends, "dataset_id").select(
        *points.columns, xc.alias("cx"), yc.alias("cy"), xl.alias("lx"), yl.alias("ly"))
    counts = cells.groupBy("dataset_id", F.col("cx").alias("lx"), F.col("cy").alias("ly")).agg(
        F.count("*").alias("density"))
    return cells.join(counts, ["dataset_id", "lx", "ly"], "left").select(
        *points.columns, F.coalesce("density", F.lit(0)).alias("density"))


def residuals(preds: DataFrame) -> DataFrame:
    return preds.select("dataset_id", "row_id", (F.col("yhat") - F.col("y")).alias("residual"))


def qq_points(res: DataFrame, split: int = SPLIT) -> DataFrame:
    """dataset_id, place, theoretical, residual, slope, intercept: ordered residuals against
    normal quantiles at the order-statistic medians, with the least-squares line."""
    sizes = res.groupBy("dataset_id").agg(F.count("*").alias("n"))
    counted = written(res.groupBy("dataset_id", "residual").agg(F.count("*").alias("w")), "residuals")
    cum = running_total(counted, ["dataset_id"], "residual", "w", "upto", split, stored=True)
    n = F.col("n")
    placed = cum.join(sizes, "dataset_id").withColumn(
        "place", F.explode(F.sequence(F.col("upto") - F.col("w") + 1, F.col("upto"))))
    last = F.pow(F.lit(0.5), 1.0 / n)
    median = (F.when(F.col("place") == n, last).when(F.col("place") == 1, 1.0 - last)
              .otherwise((F.col("place") - 0.3175) / (n + 0.365)))
    points = placed.select("dataset_id", "place", normal_quantile(median).alias("theoretical"), "residual")
    line = points.groupBy("dataset_id").agg(
        F.regr_slope("residual", "theoretical").alias("slope"), F.regr_intercept("residual", "theoretical").alias("intercept"))
    return points.join(line, "dataset_id")


def insights(clf: DataFrame, aucs: DataFrame, reg: DataFrame) -> DataFrame:
    """dataset_id, place, text: short readings of the headline metrics."""
    ba, r2 = F.col("balanced_accuracy"), F.col("r2")
    first = clf.select("dataset_id", F.lit(0).alias("place"), F.format_string(
        "Balanced accuracy %.2f - %s", ba, F.when(ba > 0.9, "highly learnable").when(ba < 0.3, "weak/hard")
        .otherwise("moderately learnable")).alias("text"))
    second = aucs.where(F.col("roc_auc").isNotNull()).select(
        "dataset_id", F.lit(1).alias("place"), F.format_string("ROC-AUC %.2f class separability", "roc_auc").alias("text"))
    third = reg.select("dataset_id", F.lit(0).alias("place"), F.format_string(
        "R^2 %.2f - %s", r2, F.when(r2 > 0.75, "strong signal").when(r2 < 0.1, "weak/hard target")
        .otherwise("moderate signal")).alias("text"))
    return first.unionByName(second).unionByName(third)
