"""Sources, sinks, streams and whole runs over data derived from the driver tables."""
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.stats import r6 as R
from fleetsieve.operators import metadata_rules as M
from fleetsieve.operators import weights as W
from fleetsieve.plans import curation
from fleetsieve.session import scratch, written
from fleetsieve.sources import sinks
from fleetsieve.sources import staged
from fleetsieve.streaming import arrivals
from fleetsieve.workload.candidates import CAND, candidates
from fleetsieve.workload.fixture import NAMES, fleet, fleet_sql, read
from fleetsieve.workload.models import SIGNAL
from fleetsieve.workload.registry import query
from fleetsieve.workload.scores import SOFT_SQL, greedy, score_table
from fleetsieve.workload.sql import r6, with_ctes

FLEET = fleet_sql()


@query("io1_read_staged", with_ctes(fleet_sql("ev", "or"), f"""SELECT dataset_id, feat_id, count(*) AS n, count(num) AS n_present,
  {r6('sum(num) / 1000')} AS total, count(DISTINCT coalesce(y_str, y_num::VARCHAR)) AS n_targets FROM cells WHERE is_num GROUP BY 1, 2"""))
def io1(spark, sf):
    f = fleet(spark, sf, "ev", "or")
    root = scratch(spark, "staged")
    for d in ["ev-click", "ev-error", "ev-purchase", "ev-signup", "ev-view"]:
        staged.write_staged(f.samples, root, d, NAMES["ev"][0], "y_num")
    for d in "12345":
        staged.write_staged(f.samples, root, f"or-{d}", NAMES["or"][0])
    back = staged.read_staged(spark, root)
    y = F.coalesce("y_str", F.col("y_num").cast("string"))
    return back.samples.select("dataset_id", y.alias("y"), F.posexplode("num").alias("feat_id", "num")).groupBy("dataset_id", "feat_id").agg(
        F.count("*").alias("n"), F.count("num").alias("n_present"), R(F.sum("num") / 1000).alias("total"), F.count_distinct("y").alias("n_targets"))


@query("io8_write_fleet", with_ctes(FLEET, "SELECT source, dataset_id, count(*) AS n FROM samples JOIN datasets USING (dataset_id) GROUP BY 1, 2"))
def io8(spark, sf):
    path = scratch(spark, "fleet")
    sinks.write_fleet(fleet(spark, sf), path)
    back = sinks.read_fleet(spark, path)
    return (back.samples.groupBy("dataset_id").agg(F.count("*").alias("n"))
            .join(back.datasets.select("dataset_id", "source"), "dataset_id").select("source", "dataset_id", "n"))


@query("io9_write_results", with_ctes(SOFT_SQL, f"""SELECT dataset_id, {r6('fraction')} AS composite_fraction, coalesce(fraction >= 0.6, FALSE) AS passed FROM composites"""))
def io9(spark, sf):
    path = scratch(spark, "results")
    sinks.write_csv(W.ranked(W.composite(score_table(fleet(spark, sf)), W.default_weights(spark))), path)
    back = spark.read.option("header", "true").schema("dataset_id string, composite_fraction double, composite_score double, passed boolean").csv(path)
    return back.select("dataset_id", R(F.col("composite_fraction")).alias("composite_fraction"), "passed")


@query("w9_load_weights", with_ctes(SOFT_SQL, "SELECT rule, fp::DOUBLE AS w FROM fpoints"))
def w9(spark, sf):
    path = scratch(spark, "calibration")
    curation.calibrate(score_table(fleet(spark, sf)), path)
    return sinks.load_weights(spark, f"{path}/critic_weights")


@query("st1_stream_candidates", with_ctes(CAND, "SELECT dataset_id, rule, passed, reason FROM ran"))
def st1(spark, sf):
    landed, out = scratch(spark, "landed"), scratch(spark, "streamed")
    c = candidates(spark, sf)
    c.unionByName(c.withColumn("pos", F.col("pos") + 1_000_000).withColumn("name", F.lit("synthetic repeat"))).write.parquet(landed)
    stream = spark.readStream.schema(c.schema).parquet(landed)
    arrivals.stream_candidates(stream, out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("dataset_id", "rule", "passed", "reason")


FILE_ROWS = 1_000_000


def batch_files(rows, batches=4):
    """Files of one of ``batches``, so that one holds about ``FILE_ROWS`` at most."""
    return max(1, -(-rows // (batches * FILE_ROWS)))


@query("st2_stream_row_hashes", "SELECT dataset_id, status, matched FROM (" + greedy("FALSE") + ")")
def st2(spark, sf):
    landed = scratch(spark, "landed")
    f = fleet(spark, sf)
    placed = f.samples.join(f.datasets.select("dataset_id", F.col("pos").cast("bigint").alias("pos")), "dataset_id")
    manifest = written(placed.groupBy("dataset_id", "pos").agg(F.count("*").alias("n_rows")), "manifest")
    # four batches of files of bounded size: datasets begin in one and end in another
    files = batch_files(manifest.agg(F.sum("n_rows")).first()[0] or 0)
    placed.select("dataset_id", "pos", "num").repartitionByRange(4 * files, "pos", F.xxhash64("num")).write.parquet(landed)
    stream = spark.readStream.schema("dataset_id string, pos long, num array<double>").option("maxFilesPerTrigger", files).parquet(landed)
    decisions = scratch(spark, "decisions")
    arrivals.stream_row_hashes(stream, manifest, scratch(spark, "state"), decisions, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(decisions).select("dataset_id", "status", "matched")


@query("curation_run")
def curation_run(spark, sf):
    f = fleet(spark, sf)
    made = f.samples.groupBy("dataset_id").agg(F.count("*").cast("int").alias("n_samples"), F.max(F.size("num") + F.size("txt")).alias("n_features"))
    c = f.datasets.join(made, "dataset_id").select(
        "dataset_id", "source", F.col("pos").cast("bigint").alias("pos"), "name", "n_samples", "n_features", "task_type",
        F.lit("cc0").alias("licence"), "url", F.array(F.lit("public")).alias("tags"), "domain")
    run = curation.curate(c, f, scratch(spark, "run"), signal=SIGNAL, min_rows=100, min_features=4)
    return run.scores
