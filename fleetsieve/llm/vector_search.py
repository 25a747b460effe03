"""Exact top-k inner products with a vector-approximation file.

Every vector's components become integers and each component is coded in one byte, its cell between
the least and the greatest value of its dimension. The coded table is a fifth of the vectors and is
scanned once for each block of queries: the cells bound every inner product from both sides. Only
candidates whose upper bound reaches the k-th largest lower bound of their query go on. Their exact
vectors are then read in order of the bound: first the k most promising of each query, which gives a
sure k-th score, then those whose bound still reaches it. The rest can't be in the result.

Queries are read in blocks of at most `block` rows, the only data that is sent to all tasks.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetsieve.session import cut, scratch

CELLS = 256
LIMIT = float(1 << 53)
LONG = (1 << 63) - 1


def integers(vector: Column, scale=1024) -> Column:
    """floor(scale * x) of each component, as array<bigint>; null for a vector that is null or has a null or
    non-finite component. A finite one of 2^53 or more after scaling, where doubles are no longer exact integers
    and sums of products may not fit 38 digits, is an error: no finite vector is left out in silence."""
    size = lambda x: F.abs(x.cast("double")) * scale
    scaled = F.transform(vector, lambda x: F.when(size(x) < LIMIT, F.floor(x.cast("double") * scale)).otherwise(
        F.raise_error(F.lit("a vector component is beyond 2^53 after scaling")).cast("bigint")))
    sound = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(sound, scaled)


def build(vectors: DataFrame, vec_id="vec_id", vector="embedding", scale=1024, copies=11) -> tuple[DataFrame, DataFrame, tuple]:
    """(approximations, exact vectors, grid): a written table (row, vec_id, code), the rows with exact
    integers, and least value, cell width and largest magnitude of each dimension. Shorter vectors count as padded with
    zeros; `row` tells rows with equal ids apart. Of equal vectors only the `copies` smallest ids are
    coded: for k results ties beyond the (k + 1)-th can't win, one of them being the query itself."""
    spark = vectors.sparkSession
    exact = vectors.select(F.col(vec_id).alias("vec_id"), integers(F.col(vector), scale).alias("exact")).filter("exact is not null")
    width = exact.agg(F.max(F.size("exact"))).first()[0] or 0
    padded = exact.withColumn("exact", F.concat("exact", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("exact"))))
    padded = cut(padded.withColumn("row", F.monotonically_increasing_id()))
    edges = padded.select(F.posexplode("exact").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim").collect() if width else []
    lo = np.array([e["lo"] for e in edges], np.int64)
    step = np.array([max(1, -(-(e["hi"] - e["lo"] + 1) // CELLS)) for e in edges], np.int64)
    peak = np.array([max(abs(e["lo"]), abs(e["hi"])) for e in edges], float)

    def code(batches):
        for b in batches:
            n = b.num_rows
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width) if width else np.zeros((n, 0), np.int64)
            codes = ((x - lo) // step).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in codes], pa.binary())], names=["row", "vec_id", "code"])

    kind = padded.schema["vec_id"].dataType.simpleString()
    folder = scratch(spark, "approximations")
    tied = F.row_number().over(Window.partitionBy("exact").orderBy("vec_id", "row"))
    kept = padded.withColumn("nth", tied).filter(F.col("nth") <= copies)
    kept.select("row", "vec_id", "exact").mapInArrow(code, f"row bigint, vec_id {kind}, code binary").write.parquet(folder)
    return spark.read.parquet(folder), padded, (lo, step, peak)


def _bounds(codes: DataFrame, ids: np.ndarray, queries: np.ndarray, grid, k: int, kind: str) -> DataFrame:
    """(query_row, row, low, high) of the candidates that a task can't rule out. The k-th best lower bound of each
    query is carried through the task. Bounds are widened by what the sums of doubles may be off."""
    lo, step, peak = grid
    mid = lo + (step - 1) / 2.0
    rounding = (len(lo) + 8) * 2.0 ** -51 * (np.abs(queries) @ (peak + step))
    slack = np.abs(queries) @ ((step - 1) / 2.0) + rounding  # of every bound of a query

    def run(batches):
        best = np.full((len(ids), k), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows = part.column(0).to_numpy()
                cells = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(rows), len(lo))
                centre = queries @ (cells * step + mid).T
                centre[ids[:, None] == rows[None, :]] = -np.inf
                best = np.partition(np.hstack([best, centre]), len(rows), axis=1)[:, len(rows):]  # the k largest so far
                floor = best.min(axis=1) - slack
                q, r = np.nonzero((centre + slack[:, None] >= floor[:, None]) & np.isfinite(centre))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rows[r]), pa.array(centre[q, r] - slack[q]), pa.array(centre[q, r] + slack[q])], names=["query_row", "row", "low", "high"])

    return codes.select("row", "code").mapInArrow(run, "query_row bigint, row bigint, low double, high double")


def top_k(vectors: DataFrame, is_query, vec_id="vec_id", vector="embedding", k=10, scale=1024, block=1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each query row, ties to the smaller id.

    `is_query` is a condition on the column vec_id. Rows that hold no sound vector take no part. Rows
    with equal ids are rows of their own, so a copy of a query under its id is a candidate for it; ties
    of equal ids go in any order. Fewer candidates than k give fewer rows, an empty table none. Ranks are
    those of the exact scores, summed as decimals where longs might not hold them; a score beyond a long is
    shown as the nearest long.
    """
    spark = vectors.sparkSession
    codes, exact, grid = build(vectors, vec_id, vector, scale, k + 1)
    kind = exact.schema["vec_id"].dataType.simpleString()
    asked = exact.filter(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("exact").alias("query"))
    n = asked.count()
    blocks, out = -(-n // block), []
    by_bound = Window.partitionBy("query_row").orderBy(F.col("low").desc(), "row")
    by_high = Window.partitionBy("query_row").orderBy(F.col("high").desc(), "row")
    by_score = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    peak = grid[2]
    kept = "bigint" if float(peak @ peak) < LONG / 2 else "decimal(38,0)"
    product = (lambda a, b: a * b) if kept == "bigint" else (lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(kept))
    score = F.aggregate(F.zip_with("query", "exact", product), F.lit(0).cast(kept), lambda a, x: (a + x).cast(kept))
    shown = F.greatest(F.least("score", F.lit(LONG).cast(kept)), F.lit(-LONG).cast(kept)).cast("bigint")

    def scored(pairs):
        found = pairs.join(exact, "row").join(asked, "query_row")
        return found.select("query_row", "query_id", "row", "vec_id", score.alias("score"))

    for part in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_row"), F.lit(blocks)) == part).select("query_row", "query").toArrow()
        ids = own["query_row"].to_numpy()
        if not len(ids):
            continue
        queries = np.array(own["query"].to_pylist(), float).reshape(len(ids), -1)
        near = cut(_bounds(codes, ids, queries, grid, k, kind))
        floor = near.withColumn("n", F.row_number().over(by_bound)).filter(F.col("n") == k).select("query_row", F.col("low").alias("floor"))
        near = near.join(floor, "query_row", "left").filter("floor is null or high >= floor")
        near = cut(near.withColumn("n", F.row_number().over(by_high)).select("query_row", "row", "high", "n"))
        first = cut(scored(near.filter(F.col("n") <= k)))
        sure = first.groupBy("query_row").agg(F.min("score").alias("sure"), F.count("*").alias("have")).filter(F.col("have") == k)
        rest = near.filter(F.col("n") > k).join(sure, "query_row").filter("high >= sure").select("query_row", "row")
        best = first.unionByName(scored(rest)).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        out.append(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", shown.alias("score")))
    if not out:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    folder = scratch(spark, "top-k")
    for x in out:
        x.write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
