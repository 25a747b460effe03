"""Work that no longer meets in one task, or moves wider than it was given."""
import threading

from pyspark.sql import functions as F

from fleetsieve.functions.sampling import draw_key, sample_n
from fleetsieve.sources import assembly as Z
from fleetsieve.sources import registry as G
from fleetsieve.workload import flows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_draw_ranks_only_the_cell_of_its_last_row(spark):
    rows = [("a", i, 700) for i in range(2000)] + [("b", i, 30) for i in range(20)] + [(None, i, 5) for i in range(40)] + [("z", 1, 0), ("n", 1, None)]
    df = spark.createDataFrame(rows, "g string, id bigint, k int")
    drawn = sample_n(df, ["g"], "k", "0", "id", salts=1)
    order = [r["id"] for r in spark.range(2000).orderBy(draw_key("0", "id")).collect()]
    want = {("a", i) for i in order[:700]} | {("b", i) for i in range(20)} | {(None, i) for i in [x for x in order if x < 40][:5]}
    got = [(r["g"], r["id"]) for r in drawn.collect()]
    assert set(got) == want and len(got) == len(want) and drawn.columns == df.columns
    below, ranked = _plan(drawn).split("Window", 1)
    assert "_edge" in ranked and "_edge" in below  # the window stands above the filter on the one cell


def test_sparse_rows_become_wide_after_their_joins(spark):
    tall = spark.createDataFrame([("m", f"s{i}", f"f{j:05d}", float(i)) for i in range(3) for j in (0, 7, 400 * i + 9)] + [("m", "s0", "f00000", float("nan"))],
                                 "matrix string, sample string, feature string, value double")
    rows, features = Z.gathered(tall)
    datasets = spark.createDataFrame([("d", "s", 0, "d", "regression", "", "", "m")], "dataset_id string, source string, pos bigint, name string, task_type string, domain string, url string, matrix string")
    labels = spark.createDataFrame([("d", f"s{i}", 1.0 * i) for i in range(3)], "dataset_id string, sample string, y_num double")
    made = Z.build(datasets, rows, features, labels).samples
    assert "ArrowEvalPython" not in _plan(made) and _plan(made).index("array_repeat") < _plan(made).index("Join")
    wide = {r["y_num"]: r["num"] for r in made.collect()}
    assert wide == {0.0: [None, 0.0, 0.0, None, None], 1.0: [1.0, 1.0, None, 1.0, None], 2.0: [2.0, 2.0, None, None, 2.0]}
    joined = Z.build(datasets, rows.withColumn("num", F.array(F.lit(5.0))), features, labels).samples
    assert all(len(r["num"]) == 6 and r["num"][-1] == 5.0 for r in joined.collect())


def test_a_long_marker_line_is_dealt_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "PIECE", 4)
    (tmp_path / "markers").mkdir()
    (tmp_path / "markers" / "x.txt").write_text("disease\t" + "\t".join("abcdefghi") + "\nm1\t" + "\t".join("010101010") + "\nempty\n")
    tall, ill = G._markers(spark, str(tmp_path))
    assert {(r["sample"], r["disease"]) for r in ill.collect()} == {(str(i), x) for i, x in enumerate("abcdefghi")}
    assert {(r["feature"], r["sample"], r["value"]) for r in tall.collect()} == {("m1", str(i), x) for i, x in enumerate("010101010")}
    assert "Generate explode" not in _plan(tall)  # the lines were parsed once, the pieces are a table


def test_files_of_a_batch_follow_the_rows():
    assert flows.batch_files(0) == flows.batch_files(4 * flows.FILE_ROWS) == 1
    assert flows.batch_files(4 * flows.FILE_ROWS + 1) == 2 and flows.batch_files(400 * flows.FILE_ROWS) == 100


def test_sources_are_fetched_side_by_side_in_the_registrys_order(spark, make_fleet):
    both = threading.Barrier(2, timeout=60)

    def source(name):
        def made(session, root):
            both.wait()
            return make_fleet({name: ("regression", [([1.0], [], None, 1.0, None)])}, source=name)
        return G.Source(None, made)

    got = G.fetch(spark, "none", registry={"b": source("b"), "a": source("a")})
    assert [r["source"] for r in got.timings.where("error is null").collect()] == ["b", "a"]
    assert [r["dataset_id"] for r in got.fleet.datasets.orderBy("pos").collect()] == ["b", "a"]
