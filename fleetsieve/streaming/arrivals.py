"""Candidates and samples that arrive over time.

The state of both streams is a results table, one folder per micro-batch. A replayed batch
overwrites its own folder, so results are written exactly once."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.operators import duplicates as D
from fleetsieve.operators import metadata_rules as M
from fleetsieve.fleet import Fleet
from fleetsieve.session import cut


def _earlier(spark, path: str, schema, batch_id: int) -> DataFrame:
    """What batches before this one have written, empty before the first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch_id)


def stream_candidates(stream: DataFrame, results: str, checkpoint: str, **limits):
    """Metadata rules on arriving candidates; the first row of a dataset counts, ever."""
    keys = "dataset_id string, batch_id long"

    def batch(df: DataFrame, batch_id: int):
        spark = df.sparkSession
        rest = [c for c in df.columns if c != "dataset_id"]
        first = df.groupBy("dataset_id").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("dataset_id", "r.*")
        seen = _earlier(spark, results, keys, batch_id).select("dataset_id").distinct()
        new = first.join(seen, "dataset_id", "left_anti")
        M.run_metadata_rules(new, **limits).write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


HASHES = "dataset_id string, pos long, h long, batch_id long"


def stream_row_hashes(stream: DataFrame, manifest: DataFrame, state: str, decisions: str, checkpoint: str,
                      threshold: float = V.OVERLAP_THRESHOLD, ordered: bool = True):
    """Datasets whose rows arrive over any number of batches: rejected when they overlap an accepted one,
    else their row hashes join the pool. ``stream`` has dataset_id and num.

    ``manifest`` has dataset_id, pos and n_rows. A dataset's row hashes are held, and its rows counted, until
    n_rows are there; then it is decided, once. With ``ordered`` it also waits for every dataset of a smaller
    pos, so the decisions are those of all rows at once, however they are cut into batches; without, it is
    held against whatever was decided before. Rows of a dataset that the manifest doesn't name wait for good,
    rows beyond n_rows that come after the decision change nothing. ``state`` keeps the folders counts, held
    and pool; a batch writes its own part of each, which a replay overwrites."""
    facts = manifest.select("dataset_id", F.col("pos").cast("bigint").alias("pos"), "n_rows")

    def batch(df: DataFrame, batch_id: int):
        spark = df.sparkSession
        own = lambda name: f"{state}/{name}/batch_id={batch_id}"
        so_far = lambda name, columns: _earlier(spark, f"{state}/{name}", f"{columns}, batch_id long", batch_id + 1)
        df.groupBy("dataset_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(own("counts"))
        D.sorted_row_hashes(Fleet(None, None, df)).write.mode("overwrite").parquet(own("held"))

        counts = so_far("counts", "dataset_id string, n long").groupBy("dataset_id").agg(F.sum("n").alias("n"))
        decided = _earlier(spark, decisions, "dataset_id string, batch_id long", batch_id).select("dataset_id").distinct()
        waiting = cut(facts.join(decided, "dataset_id", "left_anti").join(counts, "dataset_id", "left").select(
            "dataset_id", "pos", (F.coalesce("n", F.lit(0)) >= F.col("n_rows")).alias("whole")))
        first = waiting.where("NOT whole").agg(F.min("pos")).first()[0] if ordered else None
        ready = waiting.where("whole" if first is None else F.col("whole") & (F.col("pos") < first)).select("dataset_id", "pos")
        if ready.isEmpty():
            return

        hashes = cut(so_far("held", "dataset_id string, h long").select("dataset_id", "h").join(ready, "dataset_id").distinct())
        known = _earlier(spark, f"{state}/pool", HASHES, batch_id).select("dataset_id", "pos", "h")
        size = lambda d, n: d.groupBy("dataset_id", "pos").agg(F.count("*").alias(n))
        # whatever is in the pool comes first here, also a dataset of a greater pos
        met = (known.select(F.col("pos").alias("a"), "h").join(hashes.select(F.col("pos").alias("b"), "h"), "h")
               .groupBy("a", "b").agg(F.count("*").alias("shared")) if not ordered
               else D.shared_rows(known.select("pos", "h"), hashes.select("pos", "h")))
        a = size(known, "sa").select(F.col("pos").alias("a"), F.col("dataset_id").alias("matched"), "sa")
        b = size(hashes, "sb").select(F.col("pos").alias("b"), "dataset_id", "sb")
        hits = cut(met.join(a, "a").join(b, "b").where(F.col("shared") / F.least("sa", "sb") > threshold)
                   .groupBy("dataset_id").agg(F.min_by("matched", "a").alias("matched")))
        datasets = cut(ready.withColumn("source", F.lit("stream")).join(hits, "dataset_id", "left_anti"))
        free = hashes.join(hits, "dataset_id", "left_anti")
        chosen = cut(D.select_fleet(datasets, free.select("dataset_id", "h"), threshold, None, None, exempt=()))
        accepted = chosen.where("status = 'accepted'").select("dataset_id")
        (free.join(accepted, "dataset_id", "left_semi").select("dataset_id", "pos", "h")
         .write.mode("overwrite").parquet(own("pool")))
        out = chosen.select("dataset_id", "status", "matched").unionByName(
            hits.select("dataset_id", F.lit("rejected").alias("status"), "matched"))
        out.write.mode("overwrite").parquet(f"{decisions}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
