"""The source registry, targets found beside X, and whole runs."""
import os

import pytest
from pyspark.sql import functions as F

from fleetsieve.fleet import Fleet
from fleetsieve.operators import reporting as RP
from fleetsieve.plans import curation
from fleetsieve.sources import assembly as Z
from fleetsieve.sources import registry as G
from fleetsieve.sources import staged


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Activities, plant matrices and staged folders of a few rows, and a source whose files are missing."""
    root = str(tmp_path_factory.mktemp("landed"))
    spark.range(60).select(F.concat(F.lit("T"), (F.col("id") % 2).cast("string")).alias("target"), F.lit("p").alias("name"),
                           F.concat(F.lit("CCO"), (F.col("id") % 20).cast("string")).alias("smiles"), F.col("id").cast("double").alias("pchembl")).write.parquet(f"{root}/chembl/activities")
    os.makedirs(f"{root}/plants/matrices")
    with open(f"{root}/plants/matrices/1-Glycine_max_combined_output.tsv", "w") as out:
        out.write("run\tg1\tg2\n" + "".join(f"E{i}\t{i}\t{'NA' if i % 2 else i * 2}\n" for i in range(8)))
    for kind, head in (("tissue", "experiment\tcategory"), ("age", "experiment\ttime_in_days")):
        os.makedirs(f"{root}/plants/{kind}")
        with open(f"{root}/plants/{kind}/t.tsv", "w") as out:
            out.write(head + "\n" + "".join(f"E{i}\t{'leaf' if i < 5 else ''}\n" for i in range(8)))
    for d in "ab":
        spark.range(30).select("id", (F.col("id") * 2.5).alias("x")).coalesce(1).write.parquet(f"{root}/local/{d}/X.parquet")
    spark.range(30).select((F.col("id") % 3).cast("string").alias("target")).coalesce(1).write.option("header", "true").csv(f"{root}/local/a/y.csv")
    spark.range(30).select(F.lit(0.5).alias("other"), (F.col("id") % 2).cast("string").alias("outcome")).coalesce(1).write.option("header", "true").csv(f"{root}/local/b/info.csv")
    return root


def test_listing_skips_what_fails_and_keeps_the_limit(spark, landed):
    got = G.list_candidates(spark, landed, ["plants", "local", "gp", "nowhere"], max_per_source=None)
    assert {(r["source"], r["dataset_id"]) for r in got.candidates.collect()} == {("plants", "plants-Glycine_max-tissue"), ("local", "a"), ("local", "b")}
    errors = {r["source"]: r["error"] for r in got.timings.collect()}
    assert set(errors) == {"plants", "local", "gp"} and errors["gp"] and not errors["local"]
    assert RP.loader_runtimes(got.timings).where("phase = 'scrape'").count() == 3
    assert G.list_candidates(spark, landed, ["plants"], max_per_source=1).candidates.count() == 1


def test_fetch_unites_the_sources_of_its_candidates(spark, landed):
    wanted = spark.createDataFrame([("plants", "plants-Glycine_max-tissue"), ("chembl", "T1"), ("gp", "gp-rice-FT")], "source string, dataset_id string")
    got = G.fetch(spark, landed, wanted)
    rows = {(r["dataset_id"], r["n"]) for r in got.fleet.samples.groupBy("dataset_id").agg(F.count("*").alias("n")).collect()}
    assert rows == {("plants-Glycine_max-tissue", 5), ("T1", 10)}
    assert [r["dataset_id"] for r in got.fleet.datasets.orderBy("pos").collect()] == ["T1", "plants-Glycine_max-tissue"]
    assert {r["source"] for r in got.timings.where("error is not null").collect()} == {"gp"}
    plant = got.fleet.samples.where("dataset_id like 'plants%' and y_str = 'leaf'").collect()
    assert sorted(r["num"][1] is None for r in plant) == [False, False, False, True, True]


def test_a_found_target_is_not_written(spark, landed):
    before = sorted(x for _, _, files in os.walk(f"{landed}/local") for x in files)
    fleet = staged.read_staged(spark, f"{landed}/local")
    assert {(r["dataset_id"], r["k"], r["n"]) for r in fleet.samples.groupBy("dataset_id").agg(
        F.count_distinct("y_str").alias("k"), F.count("*").alias("n")).collect()} == {("a", 3, 30), ("b", 2, 30)}
    assert all(r["y_str"] == str(int(r["num"][0]) % 2) for r in fleet.samples.where("dataset_id = 'b'").collect())
    assert sorted(x for _, _, files in os.walk(f"{landed}/local") for x in files) == before


def test_widen_places_cells_and_leaves_gaps(spark):
    tall = spark.createDataFrame([("m", "s1", "b", 2.0), ("m", "s1", "a", 1.0), ("m", "s2", "c", None), ("m", "s2", "c", 4.0), ("k", "s1", "z", 9.0)],
                                 "matrix string, sample string, feature string, value double")
    rows, features = Z.widen(tall)
    assert {(r["matrix"], r["sample"]): r["num"] for r in rows.collect()} == {("m", "s1"): [1.0, 2.0, None], ("m", "s2"): [None, None, 4.0], ("k", "s1"): [9.0]}
    assert {(r["matrix"], r["feat_id"], r["feat"]) for r in features.collect()} == {("m", 0, "a"), ("m", 1, "b"), ("m", 2, "c"), ("k", 0, "z")}


def _run_fleet(make_fleet, spark):
    rows = lambda k, n: [([float(i * k % 17), float(i)], ["t"], "ab"[i % 2], None, None) for i in range(n)]
    fleet = make_fleet({"one": ("classification", rows(3, 60)), "two": ("unknown", rows(5, 60)), "copy": ("classification", rows(3, 60)), "tiny": ("classification", rows(7, 4))}, source="openml")
    candidates = fleet.datasets.select("dataset_id", "source", F.col("pos").cast("bigint").alias("pos"), "name", F.lit(60).alias("n_samples"), F.lit(3).alias("n_features"),
                                       "task_type", F.lit("cc0").alias("licence"), "url", F.array(F.lit("public")).alias("tags"), "domain")
    return candidates, fleet


def test_a_whole_run_from_candidates_to_scores(spark, make_fleet, tmp_path):
    candidates, fleet = _run_fleet(make_fleet, spark)
    rules = {k: curation.SOFT_RULES[k] for k in ("S2", "S5")}
    run = curation.curate(candidates, fleet, str(tmp_path / "out"), signal=None, min_rows=20, min_features=2, soft_rules=rules)
    status = {r["dataset_id"]: r["status"] for r in run.selection.collect()}
    assert "tiny" not in status and status["one"] == "accepted" and status["copy"] != "accepted"
    assert {r["dataset_id"] for r in run.scores.collect()} == {k for k, v in status.items() if v == "accepted"}
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out/critic_scores").count() == run.scores.count()
    scores = curation.rescore(fleet, rules=rules)
    assert scores.select("rule").distinct().count() == 2
    assert curation.calibrate(curation.score_fleet(fleet, {k: curation.SOFT_RULES[k] for k in ("S2", "S4", "S5")})).count() > 0
