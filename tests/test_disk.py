"""What the signal test writes and moves for each row."""
import os
import re

from fleetsieve.operators import signal as G
from fleetsieve.session import checkpoint_dir


def checkpoints(spark):
    folder = re.sub("^file:", "", checkpoint_dir(spark))
    return {os.path.join(at, d) for at, names, _ in os.walk(folder) for d in names if d.startswith("rdd-")}


def test_rows_are_neither_checkpointed_nor_moved_to_meet_small_tables(spark, make_fleet):
    rows = [([float(i % 2) + i % 7, float(i % 11)], [], "ab"[i % 2], None, None) for i in range(200)]
    fleet = make_fleet({"d": ("classification", rows), "e": ("regression", [(x, t, None, float(i), None) for i, (x, t, _, _, _) in enumerate(rows)])})
    before = checkpoints(spark)
    prepared = G.prepare_signal(fleet)
    assert checkpoints(spark) == before
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    folded = G.assign_folds(prepared)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert {r["dataset_id"]: r["count"] for r in folded.groupBy("dataset_id").count().collect()} == {"d": 200, "e": 200}


def test_scores_read_the_cells_once_for_profile_and_moments(spark, make_fleet, monkeypatch):
    from fleetsieve.operators import profile as P
    from fleetsieve.workload import scores as W
    f = make_fleet({"d": ("classification", [([float(i), float(i * i % 17), None], [], "ab"[i % 2], None, None) for i in range(40)])})
    passes, real = [], P.numeric_summary
    monkeypatch.setattr(P, "numeric_summary", lambda fleet: passes.append(1) or real(fleet))
    found = {r["rule"]: r["score"] for r in W.score_table(f).collect()}
    assert len(passes) == 1 and set(found) == {"S1", "S2", "S3", "S4", "S5", "S6"}
    m = {r["feat_id"]: r for r in P.column_moments(f).collect()}
    assert set(m) == {0, 1} and abs(m[0]["std"] - (40 * 41 / 12) ** 0.5) < 1e-9 and abs(m[0]["skew"]) < 1e-9 and m[0]["n"] == 40
