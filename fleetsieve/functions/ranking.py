"""Running totals, average ranks and neighbours over groups of any size.

All work on pre-aggregated distinct values with a weight, which are written once. A group with
more distinct values than ``split`` is cut into consecutive value ranges first: each range is
totalled on its own and shifted by the ranges below it, so no task ever sorts a whole hot group.
Rows move in one exchange, on (group, range); cut points and shifts exist for cut groups only, are
written as well, and are broadcast only where their written size allows it.
Groups of any size take this one plan. The cut points are approximate percentiles of a
hash-chosen sample of the values, a sketch of bounded size; any cut points give the same
exact answer.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsieve.session import written

CUT_POINTS = 255
SPLIT = 100_000
SAMPLE_STRIDE = 256


def _below(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts``, at most CUT_POINTS, are below ``value``: a binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CUT_POINTS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def _with_ranges(df: DataFrame, group, value: str, split: int, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows with the ``_range`` of their value, and the cut points of the groups that are cut."""
    rows = df if stored else written(df, "ranked")
    sampled = F.pmod(F.xxhash64(value), F.lit(SAMPLE_STRIDE)) == 0
    shares = [i / (CUT_POINTS + 1) for i in range(1, CUT_POINTS + 1)]
    large = rows.groupBy(*group).agg(F.count("*").alias("_m")).where(F.col("_m") > split).drop("_m")
    points = rows.where(sampled).groupBy(*group).agg(
        F.percentile_approx(value, F.array(*map(F.lit, shares)), F.lit(2000)).alias("_cuts"))
    cuts = written(large.join(points, group, "left"), "cuts")
    below = _below(F.col("_cuts"), F.col(value))
    ranged = (rows.join(cuts, group, "left")
              .withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(below))
              .drop("_cuts"))
    return ranged, cuts


def _totalled(df: DataFrame, group, value: str, weights: dict, split: int, descending: bool,
              stored: bool = False) -> DataFrame:
    """:func:`running_total` with the ``_range`` of each row."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranged, cuts = _with_ranges(df, group, value, split, stored)
    totals = (ranged.join(cuts.select(*group), group, "left_semi")
              .groupBy(*group, "_range").agg(*[F.sum(w).alias(f"_of_{out}") for w, out in weights.items()]))
    place = F.col("_range").desc() if descending else F.col("_range").asc()
    before = (Window.partitionBy(*group).orderBy(place)
              .rowsBetween(Window.unboundedPreceding, -1))
    shifts = written(totals.select(*group, "_range", *[F.sum(f"_of_{out}").over(before).alias(f"_below_{out}") for out in weights.values()]), "shifts")
    inside = (Window.partitionBy(*group, "_range").orderBy(order)
              .rangeBetween(Window.unboundedPreceding, 0))
    moved = {out: F.col(out) + F.coalesce(f"_below_{out}", F.lit(0)) for out in weights.values()}
    return (ranged.withColumns({out: F.sum(w).over(inside) for w, out in weights.items()})
            .join(shifts, [*group, "_range"], "left")
            .withColumns(moved).drop(*[f"_below_{out}" for out in weights.values()]))


def running_total(df: DataFrame, group, value: str, weight, out,
                  split: int = SPLIT, descending: bool = False, stored: bool = False) -> DataFrame:
    """``out`` = weight of all values up to and including this one; ties move together.
    Lists in ``weight`` and ``out`` total several weights in the same pass.
    ``stored``: ``df`` reads a written table already and isn't written again."""
    weights = {weight: out} if isinstance(weight, str) else dict(zip(weight, out))
    return _totalled(df, list(group), value, weights, split, descending, stored).drop("_range")


def average_rank(df: DataFrame, group, value: str, weight: str, out: str,
                 split: int = SPLIT) -> DataFrame:
    """Average rank of each value when every row counts ``weight`` times."""
    totalled = _totalled(df, list(group), value, {weight: "_upto"}, split, False)
    ties = Window.partitionBy(*group, "_range", value)  # equal values share a range: no second exchange
    return (totalled.withColumn("_ties", F.sum(weight).over(ties))
            .withColumn(out, (F.col("_upto") * 2 - F.col("_ties") + 1) / 2.0)
            .drop("_upto", "_ties", "_range"))


def with_neighbours(df: DataFrame, group, value: str, columns, split: int = SPLIT,
                    descending: bool = False) -> DataFrame:
    """Adds ``before_<c>`` and ``after_<c>``: the columns of the rows next to this one in the
    order of ``value``, which is distinct in a group; NULL beyond the ends."""
    group = list(group)
    ranged, _ = _with_ranges(df, group, value, split)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    row = F.struct(*columns)
    low, high = F.min_by(row, value), F.max_by(row, value)
    ends = ranged.groupBy(*group, "_range").agg(
        (high if descending else low).alias("_first"), (low if descending else high).alias("_last"))
    ranges = Window.partitionBy(*group).orderBy(way("_range"))
    ends = ends.select(*group, "_range", F.lag("_last").over(ranges).alias("_left"),
                       F.lead("_first").over(ranges).alias("_right"))
    inside = Window.partitionBy(*group, "_range").orderBy(way(value))
    near = (ranged.withColumn("_before", F.lag(row).over(inside)).withColumn("_after", F.lead(row).over(inside))
            .join(ends, [*group, "_range"]))
    sides = {f"{side}_{c}": F.coalesce(own, edge)[c]
             for side, own, edge in (("before", F.col("_before"), F.col("_left")), ("after", F.col("_after"), F.col("_right")))
             for c in columns}
    return near.withColumns(sides).drop("_range", "_before", "_after", "_left", "_right")
