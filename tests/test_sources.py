"""Readers, reshaping, metrics and functions on small inputs."""
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetsieve.functions.stats import normal_quantile
from fleetsieve.functions.text import bit_vector, char_fingerprint, to_number
from fleetsieve.operators import metrics as E
from fleetsieve.sources import annotations as A
from fleetsieve.sources import cohorts as K
from fleetsieve.sources import matrices as X
from fleetsieve.sources import sinks, staged


def test_staged_folders(spark, tmp_path):
    for name, fmt, withy in [("one", "csv", True), ("deep/two", "parquet", True), ("three", "csv", False)]:
        d = tmp_path / name
        d.mkdir(parents=True)
        x = pd.DataFrame({"a": [1.0, 2.0, None], "b": [3, 4, 5]})
        y = pd.DataFrame({"target": ["u", "v", "u"]})
        if fmt == "csv":
            x.to_csv(d / "X.csv", index=False)
            (y.to_csv(d / "y.csv", index=False) if withy else pd.DataFrame({"other": [9, 8, 7], "label": ["p", "q", "p"]}).to_csv(d / "side.csv", index=False))
        else:
            x.to_parquet(d / "X.parquet", index=False)
            y.to_parquet(d / "y.parquet", index=False)
    f = staged.read_staged(spark, str(tmp_path))
    got = {(r["dataset_id"], r["row_id"]): (r["num"], r["y_str"]) for r in f.samples.collect()}
    assert got[("one", 0)] == ([1.0, 3.0], "u") and got[("deep/two", 2)] == ([None, 5.0], "u") and got[("three", 1)] == ([2.0, 4.0], "q")
    assert len(got) == 9 and {r["feat"] for r in f.features.collect()} == {"a", "b"}


def test_weights_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([("S1", 12), ("S4", 48)], "rule string, final_pts int")
    sinks.write_weights(pts, 3, str(tmp_path / "w"), "test")
    assert {r["rule"]: r["w"] for r in sinks.load_weights(spark, str(tmp_path / "w")).collect()} == {"S1": 12.0, "S4": 48.0}
    assert {r["rule"] for r in sinks.load_weights(spark, str(tmp_path / "absent")).collect()} == {"S1", "S2", "S3", "S4", "S5"}


def test_text_files_in_order(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("!note\nid\tdescription\ts1\ts2\ng1\tx\t1\t5d\ng2\ty\t\t2e1\n")
    got = {(r["feature"], r["sample"]): r["value"] for r in X.feature_major(X.text_lines(spark, str(tmp_path)), comment="!").collect()}
    assert got == {("g1", "s1"): 1.0, ("g1", "s2"): None, ("g2", "s1"): None, ("g2", "s2"): 20.0}


def test_labels_need_both_kinds(spark):
    texts = spark.createDataFrame([("all", 1, 1, "primary tumor"), ("all", 2, 2, "tumor"), ("mix", 3, 3, "tumor"), ("mix", 4, 4, "healthy")],
                                  "study string, sample int, sample_pos int, text string")
    attrs = A.attributes(spark.createDataFrame([("all", 1, 1, 0, "grade: I"), ("all", 2, 2, 0, "Grade: II"), ("all", 2, 2, 1, "junk")],
                                               "study string, sample int, sample_pos int, line_pos int, line string"))
    got = {r["sample"]: r["label"] for r in A.sample_labels(texts, attrs, A.best_target(A.score_characteristics(attrs))).collect()}
    assert got == {1: "I", 2: "II", 3: "tumor", 4: "normal"}


def test_median_of_replicates(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 1.0), ("m", 4.0), ("m", 6.0), ("k", 2.0), (None, 3.0)], "s string, v double")
    assert {r["s"]: r["v"] for r in K.collapse_replicates(df, "s", "v").collect()} == {"m": 2.5, "k": 2.0}


@pytest.mark.parametrize("text,value", [("5d", None), (" 5 ", 5.0), ("-1.5e3", -1500.0), ("nan", None), ("", None), (".5", 0.5), ("x", None)])
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == value


def test_fingerprint_bits(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",)], "t string").select("t", char_fingerprint(F.col("t"), 64).alias("h"))
    for r in df.select("h", bit_vector(F.col("h"), 64).alias("v")).collect():
        assert [i for i, v in enumerate(r["v"]) if v] == r["h"] and len(r["v"]) == 64


def test_normal_quantile(spark):
    ps = [0.001, 0.01, 0.02425, 0.3, 0.5, 0.8, 0.98, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()
    assert all(abs(g[0] - statistics.NormalDist().inv_cdf(p)) < 1e-7 for g, p in zip(got, ps))


def test_metrics_by_hand(spark):
    preds = spark.createDataFrame([("d", i, y, p) for i, (y, p) in enumerate(zip("aaabbb", "aabbba"))], "dataset_id string, row_id int, y string, yhat string")
    m = E.classification_metrics(preds).first()
    assert m["accuracy"] == pytest.approx(4 / 6) and m["adj_balanced_accuracy"] == pytest.approx(1 / 3) and m["mcc"] == pytest.approx(1 / 3)
    scores = spark.createDataFrame([("d", i, y, "b", s) for i, (y, s) in enumerate(zip("aabb", [.1, .4, .35, .8]))],
                                   "dataset_id string, row_id int, y string, cls string, score double")
    assert E.roc_auc(scores).first()["roc_auc"] == pytest.approx(0.75)
    assert E.average_precision(scores).first()["pr_auc"] == pytest.approx(0.8333333333)
    one = scores.where("y = 'a'")
    assert E.roc_auc(one).first()["roc_auc"] is None


def test_stream_equals_batch(spark, tmp_path):
    from fleetsieve.operators import metadata_rules as M
    from fleetsieve.streaming.arrivals import stream_candidates
    schema = "dataset_id string, source string, pos long, name string, n_samples int, n_features int, task_type string, licence string, tags array<string>"
    rows = [(f"d{i}", "uci", i, "toy" if i % 3 == 0 else "n", 100 + i * 10, 2000, "regression", "mit", []) for i in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[k * 4:k * 4 + 4] + ([rows[0]] if k else []), schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream_candidates(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cols = ["dataset_id", "rule", "passed", "reason"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(cols).collect())
    assert got == sorted(tuple(r) for r in M.run_metadata_rules(spark.createDataFrame(rows, schema)).select(cols).collect())
