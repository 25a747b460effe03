"""Metadata and data rules on hand-computed cases, both sides of every threshold."""
import pytest
from pyspark.sql import functions as F

from fleetsieve.operators import data_rules as A
from fleetsieve.operators import metadata_rules as M

SCHEMA = ("dataset_id string, source string, pos long, name string, n_samples int, n_features int, "
          "task_type string, licence string, tags array<string>")


def verdict(spark, column, **row):
    base = dict(dataset_id="d", source="uci", pos=0, name="n", n_samples=150, n_features=1000,
                task_type="classification", licence="mit", tags=[])
    base.update(row)
    df = spark.createDataFrame([tuple(base[k.split()[0]] for k in SCHEMA.split(", "))], SCHEMA)
    r = df.select(column.alias("r")).first()["r"]
    return None if r is None else (r["passed"], r["reason"])


@pytest.mark.parametrize("task,want", [
    ("Supervised-Classification ", (True, "")), ("unknown", None), (" UNKNOWN ", None),
    ("clustering", (False, "task_type='clustering' not accepted")), ("my regression task", (True, ""))])
def test_a1(spark, task, want):
    assert verdict(spark, M.a1_task_type(F.col("task_type")), task_type=task) == want


@pytest.mark.parametrize("row,want", [
    (dict(name="Toyota prices"), (False, "name looks synthetic: 'Toyota prices'")),
    (dict(name="Toyota prices", source="GEO_array"), (True, "")),
    (dict(tags=["ok", "make_moons"]), (False, "tag looks synthetic: 'make_moons'")), (dict(), (True, ""))])
def test_a2(spark, row, want):
    assert verdict(spark, M.a2_synthetic(F.col("source"), F.col("name"), F.col("tags")), **row) == want


@pytest.mark.parametrize("n,p,want", [
    (150, 1000, (True, "")), (149, 999, (False, "N=149 < 150; P=999 < 1000")), (None, None, None),
    (None, 1000, (True, "")), (10, None, (False, "N=10 < 150"))])
def test_a4(spark, n, p, want):
    assert verdict(spark, M.a4_dimensions(F.col("n_samples"), F.col("n_features")), n_samples=n, n_features=p) == want


@pytest.mark.parametrize("licence,passed", [
    (None, True), ("", True), (" ", False), ("CC0", True), ("CC BY 4.0", True), ("cc-by-nc-4.0", False), ("limited use", True),
    ("publication", True), ("Non Commercial", False), ("CC BY-ND 4.0", False), ("proprietary", False)])
def test_a5(spark, licence, passed):
    assert verdict(spark, M.a5_licence(F.col("licence")), licence=licence)[0] is passed


def test_chain_stops_at_first_failure_and_honours_skips(spark):
    rows = [("a", "uci", 0, "n", 10, 2000, "clustering", "mit", []), ("b", "tcga", 1, "toy", 10, 2, "classification", "mit", []),
            ("c", "uci", 2, "n", 10, 2000, "classification", "mit", []), ("d", "gp", 3, "n", 1, 1, "x", "x", [])]
    got = M.run_metadata_rules(spark.createDataFrame(rows, SCHEMA)).orderBy("pos", "step").collect()
    assert [(r["dataset_id"], r["rule"], r["passed"]) for r in got] == [
        ("a", "A1", False), ("b", "A1", True), ("b", "A2", True), ("b", "A5", True),
        ("c", "A1", True), ("c", "A2", True), ("c", "A4", False)]


def test_target_rules(make_fleet):
    f = make_fleet({
        "constant": ("classification", [([1.0], [], "a", None, None)] * 3),
        "empty": ("classification", [([1.0], [], None, None, None)] * 3),
        "known": ("classification", [([1.0], [], c, None, None) for c in "ab"]),
        "few": ("unknown", [([1.0], [], None, float(i % 50), None) for i in range(60)]),
        "many": ("unknown", [([1.0], [], None, float(i), None) for i in range(51)])})
    got = {r["dataset_id"]: (r["passed"], r["reason"], r["inferred_task"]) for r in A.a1_target(f).collect()}
    assert got == {"constant": (False, "target has only 1 unique values", None), "empty": (False, "target has only 0 unique values", None),
                   "few": (True, "", "classification"), "many": (True, "", "regression")}
    gated = {(r["dataset_id"], r["rule"]): r["passed"] for r in A.gate(f, None, 3, 1).collect()}
    assert gated[("constant", "A1")] is False and ("constant", "A4") not in gated
    assert gated[("known", "A4")] is False and gated[("few", "A4")] is True
