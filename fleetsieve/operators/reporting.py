"""Run records: per-dataset rule table, runtimes, funnel flows, soft-score table, report join."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet


def rule_stats(records: DataFrame, results: DataFrame, data_phase_only: bool = False) -> DataFrame:
    """One wide row per record: A1..A6 as ``pass`` or ``fail: reason``, seconds, status.

    ``records`` has dataset_id, source, name, domain, url; ``results`` has dataset_id, rule,
    passed, reason and optionally phase and runtime_s."""
    if data_phase_only and "phase" in results.columns:
        results = results.where(F.col("phase") == "data")
    seconds = F.col("runtime_s") if "runtime_s" in results.columns else F.lit(None).cast("double")
    shown = results.select("dataset_id", "rule", "passed", F.when(F.col("passed"), "pass").otherwise(
        F.concat(F.lit("fail: "), F.coalesce("reason", F.lit("")))).alias("cell"), F.round(seconds, 6).alias("sec"))
    cells = []
    for rule in V.HARD_RULES:
        mine = F.col("rule") == rule
        cells += [F.max(F.when(mine, F.col("cell"))).alias(rule), F.max(F.when(mine, F.col("sec"))).alias(f"{rule}_time")]
    wide = shown.groupBy("dataset_id").agg(*cells, F.bool_and("passed").alias("ok"))
    status = F.when(F.col("ok").isNull(), "error").when(F.col("ok"), "accepted").otherwise("rejected")
    return records.join(wide, "dataset_id", "left").withColumn("status", status).drop("ok")


def rule_runtimes(stats: DataFrame) -> DataFrame:
    """Mean seconds of each rule over the calls that happened."""
    tall = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_time").alias("sec")) for r in V.HARD_RULES])
    return (stats.select(F.explode(tall).alias("p")).select("p.*").where(F.col("sec").isNotNull())
            .groupBy("rule").agg(F.round(F.avg("sec"), 3).alias("mean_seconds")))


def loader_runtimes(timings: DataFrame) -> DataFrame:
    return timings.groupBy("source", "phase").agg(
        F.round(F.avg("seconds"), 2).alias("mean_seconds"), F.count("*").alias("n"))


def funnel_flows(stats: DataFrame, rules=V.HARD_RULES) -> DataFrame:
    """(start, end, n): source to the rules in order to Accepted, failures to Rejected. The
    first record of a dataset counts (smallest ``pos``), and a rule that did not run passes."""
    have = [r for r in rules if r in stats.columns]
    stage = {r: f"{r} {V.HARD_RULE_NAMES[r]}" for r in have}
    first = stats.groupBy("dataset_id").agg(F.min_by(F.struct("source", *have), "pos").alias("r")).select("r.*")
    stops = F.array(*[F.coalesce(F.col(r).startswith("fail"), F.lit(False)) for r in have])
    at = F.array_position(stops, True).cast("int")
    names = F.array(*[F.lit(stage[r]) for r in have], F.lit("Accepted"))
    steps = F.when(at > 0, at).otherwise(len(have))
    walk = F.concat(F.array(F.struct(F.col("source").alias("start"), F.element_at(names, 1).alias("end"))),
                    F.transform(F.sequence(F.lit(1), steps), lambda i: F.struct(
                        F.element_at(names, i).alias("start"),
                        F.when((at > 0) & (i == at), "Rejected").otherwise(F.element_at(names, i + 1)).alias("end"))))
    return (first.select(F.explode(walk).alias("e")).groupBy("e.start", "e.end").agg(F.count("*").alias("n")))


def funnel_nodes(flows: DataFrame) -> DataFrame:
    sides = F.array(F.struct(F.col("start").alias("node"), F.col("n").alias("o"), F.lit(0).cast("bigint").alias("i")),
                    F.struct(F.col("end").alias("node"), F.lit(0).cast("bigint").alias("o"), F.col("n").alias("i")))
    return (flows.select(F.explode(sides).alias("s")).select("s.*").groupBy("node")
            .agg(F.greatest(F.sum("o"), F.sum("i")).alias("n")))


def soft_stats(fleet: Fleet, scores: DataFrame) -> DataFrame:
    """Shape, number of classes (classification only) and S1..S6 of every dataset."""
    fleet = fleet.by_task()
    shape = fleet.samples.groupBy("dataset_id").agg(
        F.count("*").alias("n_rows"), F.max(F.size("num") + F.size("txt")).alias("n_features"))
    classes = (fleet.targets().where(F.col("y_str").isNotNull()).groupBy("dataset_id", "y_str").count()
               .groupBy("dataset_id").agg(F.count("*").alias("n_classes")))
    wide = scores.groupBy("dataset_id").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("score"))).alias(r) for r in V.RULES])
    clf = F.col("task_type").contains("classification")
    return (fleet.datasets.select("dataset_id", "source", "name", "url", "task_type").join(shape, "dataset_id", "left")
            .join(classes, "dataset_id", "left").join(wide, "dataset_id", "left")
            .withColumn("n_classes", F.when(clf, F.coalesce("n_classes", F.lit(0)))))


def tall_scores(stats: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in V.RULES if r in stats.columns])
    return stats.select("dataset_id", F.explode(rows).alias("p")).select("dataset_id", "p.*")


def report_join(metrics: DataFrame, composites: DataFrame, stats: DataFrame) -> DataFrame:
    """Metrics with composite and, only where a composite exists, the soft scores."""
    soft = composites.join(stats.select("dataset_id", *V.RULES), "dataset_id", "left")
    return metrics.join(soft, "dataset_id", "left")


def pending(work: DataFrame, done: DataFrame, key: str = "dataset_id") -> DataFrame:
    """What is not finished yet: the resume step of every incremental run."""
    return work.join(done.select(key).distinct(), key, "left_anti")
