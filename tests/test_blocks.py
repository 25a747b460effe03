"""Signal scores from sums of blocks, and datasets that arrive in pieces."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsieve.operators import signal as G
from fleetsieve.streaming.arrivals import stream_row_hashes

SCHEMA = "dataset_id string, pos long, num array<double>"


def noise(i, k):
    return float((i * 7919 + k * 104729) % 1009)


@pytest.fixture(scope="module")
def prepared(make_fleet):
    return G.prepare_signal(make_fleet({
        "sides": ("classification", [([float(i % 2) + noise(i, 1) / 900, noise(i, 2)], [], "ab"[i % 2], None, None) for i in range(300)]),
        "chance": ("classification", [([noise(i, 3), noise(i, 4)], [], "abc"[int(noise(i, 9)) % 3], None, None) for i in range(300)]),
        "line": ("regression", [([noise(i, 5), noise(i, 6)], [], None, 1e6 + 2 * noise(i, 5) + noise(i, 7), None) for i in range(300)]),
        "flat": ("regression", [([noise(i, 8), 1.0], [], None, 7.0, None) for i in range(100)])}))


def by_hand(rows, folds=3):
    x, fold = np.array([r["x"] for r in rows]), np.array([r["fold"] for r in rows])
    scores = []
    for f in range(folds):
        train, test = fold != f, fold == f
        if rows[0]["clf"]:
            code = np.array([r["code"] for r in rows])
            means = np.stack([x[train & (code == c)].mean(axis=0) for c in range(code.max() + 1)])
            guess = ((x[test][:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
            recall = np.mean([(guess[code[test] == c] == c).mean() for c in set(code[test])])
            chance = 1 / len(set(code[test]))
            scores.append((recall - chance) / (1 - chance))
        else:
            y = np.array([r["y"] for r in rows])
            fits = [(abs(np.corrcoef(x[train, j], y[train])[0, 1]), j) for j in range(x.shape[1]) if x[train, j].std() > 0]
            slope, base = np.polyfit(x[train, max(fits)[1]], y[train], 1)
            err = y[test] - base - slope * x[test, max(fits)[1]]
            scores.append(1 - (err ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    return float(np.mean(scores))


@pytest.mark.parametrize("block_rows", [40, 4096])
def test_scores_of_blocks_are_those_of_the_dataset(prepared, block_rows):
    found = {(r["dataset_id"], r["perm"]): r["score"] for r in G.permutation_scores(prepared, 3, block_rows=block_rows).collect()}
    assert len(found) == 16
    rows = G.assign_folds(prepared).collect()
    for name in ("sides", "chance", "line"):
        assert found[name, 0] == pytest.approx(by_hand([r for r in rows if r["dataset_id"] == name]), abs=1e-9)
    assert all(found["flat", p] is None for p in range(4))  # no R2 where nothing varies


def test_shuffles_of_small_blocks_have_no_signal(prepared):
    s = G.permutation_scores(prepared, 30, block_rows=40)
    p = {r["dataset_id"]: r for r in G.p_values(s.where("dataset_id != 'flat'")).collect()}
    assert p["sides"]["p_value"] < 0.05 and p["line"]["p_value"] < 0.05
    mean = s.where("perm > 0 AND dataset_id = 'sides'").agg(F.avg("score")).first()[0]
    assert abs(mean) < 0.05 < p["sides"]["real_score"]


def test_no_rows_have_no_scores(prepared):
    assert G.permutation_scores(prepared.where("false"), 2).count() == 0


def decide(spark, folder, parts, ordered=True):
    whole = [r for p in parts for r in p]
    counts = {}
    for name, pos, _ in whole:
        counts[name, pos] = counts.get((name, pos), 0) + 1
    manifest = spark.createDataFrame([(*k, n) for k, n in counts.items()], "dataset_id string, pos int, n_rows long")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        stream_row_hashes(stream, manifest, f"{folder}/state", f"{folder}/out", f"{folder}/cp", ordered=ordered).awaitTermination()
    return {r["dataset_id"]: (r["status"], r["matched"]) for r in spark.read.parquet(f"{folder}/out").collect()}


A = [("a", 0, [float(i)]) for i in range(10)]
B = [("b", 1, [float(i)]) for i in range(10)]
C = [("c", 2, [float(i + 100)]) for i in range(10)]


def test_batches_are_cut_anywhere(spark, tmp_path):
    whole = {"a": ("accepted", None), "b": ("rejected", "a"), "c": ("accepted", None)}
    assert decide(spark, tmp_path / "one", [A + B + C]) == whole
    assert decide(spark, tmp_path / "cut", [C + B[:4] + A[:1], B[4:], A[1:]]) == whole


def test_a_dataset_waits_for_its_last_row(spark, tmp_path):
    assert decide(spark, tmp_path / "x", [A[:9] + C, A[9:]], ordered=False) == {"a": ("accepted", None), "c": ("accepted", None)}
    assert decide(spark, tmp_path / "y", [B, A], ordered=False) == {"b": ("accepted", None), "a": ("rejected", "b")}
