"""Deterministic draws ordered by md5(seed|id): equal on any partitioning."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsieve.session import written


def draw_key(seed: str, *ids) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") if isinstance(i, str)
                                                  else i.cast("string") for i in ids])
                 .cast("binary"))


def sample_n(df: DataFrame, group, n, seed: str, row_id: str = "row_id",
             salts: int = 16) -> DataFrame:
    """The first ``n`` rows per group in md5 order; ``n`` is a number or a column name.

    Draws are dealt into ``salts`` * 256 cells in their order. A group's rows in cells below the one
    that holds its last wanted row are kept unranked, and only the rows of that cell are ranked, so
    no group ever meets in one task, whatever ``n``. A column ``n`` has one value a group. ``None``
    for ``n`` keeps all rows. The rows are written once.
    """
    if n is None:
        return df
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    cell = F.floor(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("bigint") * salts / (1 << 24))
    keyed = written(df.withColumn("_draw", draw_key(seed, row_id)).withColumn("_cell", cell), "drawn")
    parts = keyed.groupBy(*group, "_cell").agg(F.count("*").alias("_n"), F.max(limit).alias("_limit"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = F.when(F.col("_before") + F.col("_n") >= F.col("_limit"), F.struct(F.col("_cell").alias("cell"), F.col("_before").alias("before")))
    edges = parts.groupBy(*[F.col(g).alias(f"_of_{g}") for g in group]).agg(F.max("_limit").alias("_most"), F.min(last).alias("_edge"))
    edges = written(edges.where("_most > 0"), "edges")
    met = keyed.join(edges, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]))
    order = Window.partitionBy(*group).orderBy("_draw", row_id)
    ranked = (met.where("_cell = _edge.cell").withColumn("_rn", F.row_number().over(order))
              .where("_rn <= _most - _edge.before"))
    return met.where("_edge IS NULL OR _cell < _edge.cell").select(*df.columns).unionByName(ranked.select(*df.columns))
