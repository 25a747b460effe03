"""Row caps, groups in ranges, several part files, numeric classes, datasets that arrive in pieces."""
import numpy as np
from pyspark.sql import functions as F

from fleetsieve.functions import ranking as R
from fleetsieve.functions.ranking import running_total
from fleetsieve.operators import forests as T
from fleetsieve.operators import metrics as E
from fleetsieve.operators import signal as G
from fleetsieve.operators import soft_rules as S
from fleetsieve.sources import cohorts as K
from fleetsieve.sources import staged


def test_no_cap_keeps_all_rows(spark):
    rows = spark.range(60).select(F.lit("d").alias("dataset_id"), F.col("id").alias("row_id"))
    assert G.cap_rows(rows, None).count() == 60
    assert G.cap_rows(rows, 7).count() == 7


def test_many_ranges_give_the_same_totals(spark):
    rows = spark.range(5000).select(F.lit("d").alias("g"), (F.col("id") % 997).cast("double").alias("v"), F.lit(1).alias("w")).groupBy("g", "v").agg(F.sum("w").alias("w"))
    one = {r["v"]: r["t"] for r in running_total(rows, ["g"], "v", "w", "t").collect()}
    many = {r["v"]: r["t"] for r in running_total(rows, ["g"], "v", "w", "t", split=10).collect()}
    assert one == many


def test_part_files_pair_their_rows(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        data = spark.range(1000, numPartitions=4)
        root = tmp_path / fmt
        for role, col in (("X", F.col("id").cast("double").alias("a")), ("y", (F.col("id") * 2.0 + 0.5).alias("t"))):
            data.select(col).write.option("header", "true").format(fmt).save(f"{root}/one/{role}.{fmt}")
        rows = staged.read_staged(spark, str(root)).samples.collect()
        assert len(rows) == 1000 and len({r["row_id"] for r in rows}) == 1000
        assert all(r["y_num"] == r["num"][0] * 2 + 0.5 for r in rows)


def test_numeric_classes_count_as_classes(make_fleet):
    fleet = make_fleet({"a": ("classification", [([float(i)], [], None, float(i % 2), None) for i in range(20)])})
    assert S.s5_class_balance(fleet).first()["score"] > 0.999999


def test_a_label_copy_is_trivial_and_noise_needs_no_ceiling(make_fleet):
    noise = lambda i, k: float((i * 7919 + k * 104729) % 1009)
    fleet = make_fleet({
        "copy": ("classification", [([float(i % 2), noise(i, 1)], [], "ab"[i % 2], None, None) for i in range(80)]),
        "noise": ("classification", [([noise(i, 2), noise(i, 3)], [], "ab"[int(noise(i, 5)) % 2], None, None) for i in range(80)])})
    asked = []

    def ceilings(rows):
        asked.extend(r["dataset_id"] for r in rows.select("dataset_id").distinct().collect())
        return T.ceilings(rows, 5, 3)

    found = {r["dataset_id"]: r for r in G.signal_test(fleet, ceilings, 20).collect()}
    assert asked == ["copy"]
    assert not found["copy"]["passed"] and found["copy"]["reason"].startswith("trivial")
    assert not found["noise"]["passed"]


def test_neighbours_and_medians_over_many_ranges(spark):
    values = [(d, float(i * 10 % 1001), i) for d in "ab" for i in range(1001)]
    rows = spark.createDataFrame(values, "g string, v double, w int")
    for descending in (False, True):
        one, many = (sorted(map(tuple, R.with_neighbours(rows, ["g"], "v", ["w"], split, descending).collect()), key=str) for split in (10**6, 5))
        assert one == many and sum(x[3] is None for x in one) == sum(x[4] is None for x in one) == 2
    preds = spark.createDataFrame([("a", i, 0.0, float(i * i % 83)) for i in range(200)] + [("b", i, 1.0, float(i)) for i in range(7)] + [("c", 0, None, 1.0)],
                                  "dataset_id string, row_id long, y double, yhat double")
    expected = {"a": float(np.median([i * i % 83 for i in range(200)])), "b": float(np.median([abs(i - 1) for i in range(7)]))}
    for split in (10**6, 3):
        assert {r["dataset_id"]: r["median_ae"] for r in E.median_error(preds, split).collect()} == expected


def test_folds_are_even_within_labels(spark):
    rows = spark.createDataFrame([("d", i, "x" if i % 3 else None, [1.0]) for i in range(3000)], "dataset_id string, row_id long, label string, x array<double>")
    found = G.assign_folds(rows, 5)
    assert found.columns == [*rows.columns, "fold"] and found.count() == 3000
    assert sorted(r["count"] for r in found.groupBy("label", "fold").count().collect()) == [200] * 5 + [400] * 5


def test_healthy_samples_meet_every_frequent_disease(spark):
    labels = spark.createDataFrame([(i, "healthy" if i < 30 else "a" if i < 60 else " b " if i < 90 else None) for i in range(100)], "sample long, disease string")
    found = K.one_vs_healthy(labels, ("healthy",), 30).groupBy("disease", "label").count().collect()
    assert {(r["disease"], r["label"]): r["count"] for r in found} == {(d, x): 30 for d in "ab" for x in ("disease", "healthy")}
