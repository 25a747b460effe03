"""Ranges of values are found by halving, with the same place as by counting."""
import random

from pyspark.sql import functions as F

from fleetsieve.functions import ranking


def test_place_among_cut_points_is_the_count_of_smaller_ones(spark):
    rnd = random.Random(1)
    rows = []
    for n in (0, 1, 2, 7, 254, ranking.CUT_POINTS):
        cuts = sorted(float(rnd.randint(0, 90)) for _ in range(n))
        rows += [(cuts, v) for v in [-1.0, 91.0, None, float("nan"), float("inf"), *map(float, range(0, 91, 7)), *cuts[:3], *cuts[-3:]]]
    df = spark.createDataFrame(rows, "cuts array<double>, v double")
    counted = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    assert df.where(ranking._below(F.col("cuts"), F.col("v")) != counted).count() == 0


def test_groups_that_are_cut_rank_as_whole_ones_even_with_no_value_drawn(spark):
    rows = [(g, float(v), w) for g, n in ((None, 40), (1, 60), (2, 3)) for v in range(n) for w in (1, 2)]
    df = spark.createDataFrame(rows, "g int, v double, w long")
    found = lambda split: sorted(map(repr, ranking.average_rank(df, ["g"], "v", "w", "r", split).collect()))
    assert found(10) == found(1000)
