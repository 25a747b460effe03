"""Soft rules, weights, duplicates: hand-made fleets, edge cases and invariants."""
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.ranking import average_rank, running_total
from fleetsieve.operators import duplicates as D
from fleetsieve.operators import outliers as O
from fleetsieve.operators import profile as P
from fleetsieve.operators import signal as G
from fleetsieve.operators import soft_rules as S
from fleetsieve.operators import weights as W


def by_id(df, col="score"):
    return {r["dataset_id"]: r[col] for r in df.collect()}


def rows(nums, ys=None, y_nums=None, batch=None, txt=()):
    n = len(nums)
    return [(list(nums[i]), list(txt), ys[i] if ys else None, y_nums[i] if y_nums else None, batch[i] if batch else None) for i in range(n)]


def test_duplicates_completeness_consistency(make_fleet):
    f = make_fleet({
        "dup": ("classification", [([1.0, None], ["1"], "a", None, None), ([None, 1.0], ["1"], "a", None, None),
                                   ([1.0, None], ["1"], "a", None, None), ([-0.0, 2.0], ["x"], "b", None, None)])})
    s2 = S.s2_sample_duplication(f).first()
    assert (s2["n_rows"], s2["n_duplicate_rows"], s2["n_duplicate_groups"], s2["score"]) == (4, 2, 1, 0.5)
    q = S.quality_parts(P.column_profile(f)).first()
    assert q["n_features"] == 3 and q["n_mixed"] == 1 and q["n_cols_with_missing"] == 2
    assert q["max_missing_rate"] == 0.5 and abs(q["c_miss"] - (1 - (0.25 + 0.5) / 3)) < 1e-12
    only = S.s3_data_quality(f.datasets, S.quality_parts(P.column_profile(f))).first()
    assert abs(only["score"] - (.35 * q["c_miss"] + .25 * q["c_const"] + .10 * q["c_consist"]) / .70) < 1e-12


def test_leak_on_any_class_is_caught(make_fleet):
    ys = [c for c in "abcd" for _ in range(10)]
    rng = random.Random(1)
    nums = [["abcd".index(c) + 0.0, rng.random(), rng.random(), 7.0] for c in ys]
    f = make_fleet({"leak": ("classification", rows(nums, ys)), "one": ("classification", rows(nums, ["a"] * 40))})
    profile = P.numeric_profile(f)
    stats = {(r["dataset_id"], r["feat_id"]): r["stat"] for r in S.feature_stats(f, profile).collect()}
    assert stats[("leak", 0)] == 0.0 and ("leak", 3) not in stats and stats[("one", 0)] == 1.0
    assert by_id(S.s4_leakage(f.datasets, S.feature_stats(f, profile)))["leak"] < 0.5


def test_spearman_and_balance(make_fleet):
    x = [[float(i), float(-i * i)] for i in range(20)]
    f = make_fleet({"r": ("regression", rows(x, y_nums=[float(i) for i in range(20)])),
                    "flat": ("regression", rows(x, y_nums=[3.0] * 20)), "c": ("classification", rows(x[:4], ["a", "a", "b", None]))})
    stat = {(r["dataset_id"], r["feat_id"]): r["stat"] for r in S.spearman_per_feature(f, P.numeric_profile(f)).collect()}
    assert abs(stat[("r", 0)]) < 1e-12 and abs(stat[("r", 1)]) < 1e-12 and stat[("flat", 0)] == 1.0
    s5 = by_id(S.s5_class_balance(f))
    assert abs(s5["r"] - 1.0) < 1e-12 and s5["flat"] == 0.0
    p = 2 / 3
    assert abs(s5["c"] + (p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(2)) < 1e-12


def test_batch_effect(make_fleet):
    x = [[1.0]] * 8
    f = make_fleet({"same": ("classification", rows(x, list("aabbaabb"), batch=list("11221122"))),
                    "free": ("classification", rows(x, list("abababab"), batch=list("11221122"))), "none": ("classification", rows(x, list("aabbaabb")))})
    got = by_id(S.s6_batch_effect(f))
    assert abs(got["same"]) < 1e-12 and abs(got["free"] - 1) < 1e-12 and got["none"] is None


def test_uniqueness_of_pool_sizes(make_fleet):
    rng = random.Random(2)
    draw = lambda k: rows([[rng.gauss(0, k), rng.random(), 5.0] for _ in range(30)], ["a"] * 30)
    one = draw(1)
    f = make_fleet({"a": ("classification", one), "b": ("classification", one), "c": ("classification", draw(9)), "lone": ("classification", one)},
                   {"a": "s", "b": "s", "c": "s", "lone": "t"})
    prints = P.fingerprint(f.datasets, P.column_moments(f))
    got = by_id(S.s1_uniqueness(prints))
    assert got["lone"] == 1.0 and got["a"] < 1e-9 and got["b"] < 1e-9 and got["c"] == 1.0
    small = by_id(S.max_cosine(S.standardised(prints), block=1), "max_similarity")
    assert abs(small["a"] - 1) < 1e-9 and small["c"] == 0.0


def test_split_ranking_equals_window_ranking(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("g%d" % (i % 2), float(rng.randint(0, 4000)), 1) for i in range(6000)], "g string, v double, w int")
    df = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    plain = {(r["g"], r["v"]): r["rank"] for r in average_rank(df, ["g"], "v", "w", "rank").collect()}
    split = {(r["g"], r["v"]): r["rank"] for r in average_rank(df, ["g"], "v", "w", "rank", split=100).collect()}
    assert plain == split
    down = {(r["g"], r["v"]): r["t"] for r in running_total(df, ["g"], "v", "w", "t", descending=True).collect()}
    assert down == {(r["g"], r["v"]): r["t"] for r in running_total(df, ["g"], "v", "w", "t", 100, True).collect()}


def overlap(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def greedy(sets, sources, total, per_source):
    taken, out = [], {}
    for i, s in enumerate(sets):
        full = (total is not None and len(taken) >= total) or (
            per_source is not None and sum(sources[t] == sources[i] for t in taken) >= per_source)
        hit = next((t for t in taken if overlap(sets[t], s) > V.OVERLAP_THRESHOLD), None)
        out[f"d{i}"] = ("skipped", None) if full else ("accepted", None) if hit is None else ("rejected", f"d{hit}")
        if out[f"d{i}"][0] == "accepted":
            taken.append(i)
    return out


@pytest.mark.parametrize("total,per_source,batch", [(None, None, 4), (7, 3, 3), (5, None, 2), (None, 2, 50)])
def test_selection_equals_brute_force(spark, total, per_source, batch):
    rng = random.Random(5)
    base = [set(rng.sample(range(60), rng.randint(1, 12))) for _ in range(18)]
    sets = base + [set(base[0]), set(base[3]), set(base[0]) | {99}, {1}, {1}, {2}]
    sources = ["s%d" % rng.randint(0, 3) for _ in sets]
    sources[len(base)] = sources[0]
    ds = spark.createDataFrame([(f"d{i}", sources[i], i) for i in range(len(sets))], "dataset_id string, source string, pos int")
    hs = spark.createDataFrame([(f"d{i}", h) for i, s in enumerate(sets) for h in s], "dataset_id string, h long")
    got = D.select_fleet(ds, hs, max_total=total, max_per_source=per_source, exempt=(), batch=batch)
    assert {r["dataset_id"]: (r["status"], r["matched"]) for r in got.collect()} == greedy(sets, sources, total, per_source)


def test_row_hashes_ignore_column_and_row_order(make_fleet):
    f = make_fleet({"a": ("x", rows([[1.0, 2.0, None], [0.0, 5.0, 6.0]])), "b": ("x", rows([[6.0, -0.0, 5.0], [None, 2.0, 1.0]])),
                    "wide": ("x", rows([[1.0, 2.0, None, None]]))})
    got = {}
    for r in D.sorted_row_hashes(f).collect():
        got.setdefault(r["dataset_id"], set()).add(r["h"])
    assert got["a"] == got["b"] and not got["a"] & got["wide"]


def test_interleave_is_round_robin(spark):
    df = spark.createDataFrame([("a1", "a", 0), ("a2", "a", 1), ("b1", "b", 2), ("a3", "a", 3), ("c1", "c", 4), ("b2", "b", 5)],
                               "dataset_id string, source string, pos long")
    assert [r["dataset_id"] for r in D.interleave(df).orderBy("turn").collect()] == ["a1", "b1", "c1", "a2", "b2", "a3"]


def test_points_always_total_sixty(spark):
    rng = random.Random(7)
    for trial in range(2):
        scores = spark.createDataFrame([(f"d{i}", r, None if r == "S6" and i % 2 else rng.random() if r != "S5" else 0.5)
                                        for i in range(12) for r in V.RULES], "dataset_id string, rule string, score double")
        got = {r["rule"]: r for r in W.points(W.critic_weights(spark, scores)).collect()}
        assert sum(r["final_pts"] for r in got.values()) == 60 and sum(r["critic_pts"] for r in got.values()) == 60
        assert got["S5"]["final_pts"] == 5 and got["S5"]["verdict"] == "AGREE" and got["S5"]["critic_pts"] == 0
    flat = spark.createDataFrame([(f"d{i}", r, 0.5) for i in range(4) for r in V.RULES], "dataset_id string, rule string, score double")
    assert {r["rule"]: r["final_pts"] for r in W.points(W.critic_weights(spark, flat)).collect()} == {**V.AHP_POINTS, "S6": 0}


def test_composite_leaves_missing_scores_out(spark):
    s = spark.createDataFrame([("a", "S1", 1.0), ("a", "S4", None), ("b", "S1", None), ("c", "S4", 0.6)], "dataset_id string, rule string, score double")
    got = {r["dataset_id"]: r for r in W.composite(s, W.default_weights(spark)).collect()}
    assert got["a"]["composite_fraction"] == 1.0 and got["b"]["composite_fraction"] is None and got["b"]["passed"] is False
    assert got["c"]["passed"] is True


def test_outliers_and_tree_invariants(make_fleet):
    rng = random.Random(11)
    near = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(300)]
    far = [[rng.choice([-1, 1]) * (60 + rng.random()) for _ in range(4)] for _ in range(6)]
    f = make_fleet({"far": ("x", rows(near + far)), "text": ("x", [([], ["t"], None, None, None)] * 3)})
    got = {r["dataset_id"]: r for r in O.outlier_share(f, trees=30, block_rows=100).collect()}
    assert 6 <= got["far"]["n_outliers"] < 150 and got["far"]["n_rows"] == 306 and got["text"]["c_out"] == 1.0


def test_signal_decisions(make_fleet, spark):
    rng = random.Random(13)
    ys = [c for c in "ab" for _ in range(60)]
    good = rows([[(c == "a") * 2 + rng.gauss(0, 1), rng.random()] for c in ys], ys)
    noise = rows([[rng.random(), rng.random()] for _ in ys], ys)
    reg = rows([[float(i), rng.random()] for i in range(90)], y_nums=[i + rng.gauss(0, 5) for i in range(90)])
    tiny = rows([[1.0], [2.0]], ["a", "b"])
    f = make_fleet({"good": ("classification", good), "noise": ("unknown", noise), "reg": ("regression", reg), "tiny": ("classification", tiny)})
    got = {r["dataset_id"]: r for r in G.signal_test(f, n_permutations=40).collect()}
    assert got["good"]["passed"] and got["reg"]["passed"] and not got["noise"]["passed"]
    assert got["good"]["p_value"] == pytest.approx(1 / 41) and got["tiny"]["reason"].startswith("fewer than 2 classes")
    t = spark.createDataFrame([("nan", True, float("nan"), 0.01), ("weak", True, 0.09, 0.01), ("fifty", True, 0.408, 0.01), ("triv", True, 0.5, 0.01)],
                              "dataset_id string, clf boolean, real_score double, p_value double")
    c = spark.createDataFrame([("triv", 0.9995)], "dataset_id string, ceiling_score double")
    verdicts = {r["dataset_id"]: (r["passed"], r["reason"].split(" ")[0]) for r in G.decide(t, c).collect()}
    assert verdicts == {"nan": (False, "adj_balanced_accuracy"), "weak": (False, "signal"), "fifty": (True, "not"), "triv": (False, "trivial:")}
