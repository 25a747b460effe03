"""Whole runs: curation from candidates to composite scores, weight calibration, re-scoring."""
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet
from fleetsieve.operators import data_rules as A
from fleetsieve.operators import duplicates as D
from fleetsieve.operators import forests as T
from fleetsieve.operators import metadata_rules as M
from fleetsieve.operators import outliers as O
from fleetsieve.operators import profile as P
from fleetsieve.operators import reporting as RP
from fleetsieve.operators import signal as G
from fleetsieve.operators import soft_rules as S
from fleetsieve.operators import weights as W
from fleetsieve.session import cut
from fleetsieve.sources import sinks

# The signal test of a run, with its ceiling.
SIGNAL = partial(G.signal_test, ceilings=T.ceilings)

# Soft rules by name; adding one is adding an entry. Each takes (fleet, profile).
SOFT_RULES = {
    "S1": lambda f, p: S.s1_uniqueness(P.fingerprint(f.datasets, P.column_moments(f))),
    "S2": lambda f, p: S.s2_sample_duplication(f),
    "S3": lambda f, p: S.s3_data_quality(f.datasets, S.quality_parts(p), O.outlier_share(f, p.where("is_num"))),
    "S4": lambda f, p: S.s4_leakage(f.datasets, S.feature_stats(f, p)),
    "S5": lambda f, p: S.s5_class_balance(f),
    "S6": lambda f, p: S.s6_batch_effect(f),
}


@dataclass
class Run:
    results: DataFrame
    selection: DataFrame
    stats: DataFrame
    scores: DataFrame


def score_fleet(fleet: Fleet, rules=SOFT_RULES) -> DataFrame:
    """Tall soft scores of a fleet, written once."""
    profile = cut(P.column_profile(fleet))
    return cut(S.soft_scores(**{name: rule(fleet, profile) for name, rule in rules.items()}))


def curate(candidates: DataFrame, fleet: Fleet, out: str | None = None, weights_path: str | None = None,
           signal=SIGNAL, min_rows=V.MIN_ROWS, min_features=V.MIN_FEATURES, soft_rules=SOFT_RULES,
           max_total=V.MAX_SAVED, max_per_source=V.MAX_SAVED_PER_SOURCE) -> Run:
    """Metadata rules, turn order, data rules, duplicates and quotas, soft rules, composite.

    Every gate shrinks the fleet by a semi join before the next, dearer one reads cells; the
    small per-dataset results of each gate are checkpointed."""
    spark = candidates.sparkSession
    limits = {"min_rows": min_rows, "min_features": min_features}
    meta = cut(M.run_metadata_rules(candidates, **limits).select("dataset_id", "rule", "passed", "reason"))
    passed = D.interleave(M.accept_metadata(candidates, **limits)).select("dataset_id", "turn")
    staged = cut(fleet.datasets.drop("pos").join(passed, "dataset_id").withColumnRenamed("turn", "pos"))
    gated = A.resolved_tasks(fleet.only(staged))
    known = Fleet(cut(fleet.datasets.drop("pos").join(passed, "dataset_id").withColumnRenamed("turn", "pos")),
                  gated.features, gated.samples)
    data = cut(A.gate(known, signal, **limits))
    survivors = known.only(A.all_passed(data))
    survivors.datasets = cut(survivors.datasets)
    selection = D.select_fleet(survivors.datasets, cut(D.sorted_row_hashes(survivors)),
                               max_total=max_total, max_per_source=max_per_source)
    selection = cut(selection)
    results = (meta.withColumn("phase", F.lit("metadata")).unionByName(data.withColumn("phase", F.lit("data")))
               .unionByName(D.cross_duplicate_results(selection).withColumn("phase", F.lit("data"))))
    accepted = A.resolved_tasks(survivors).only(selection.where("status = 'accepted'"))
    accepted.datasets = cut(accepted.datasets)
    scores = score_fleet(accepted, soft_rules)
    stats = RP.soft_stats(accepted, scores)
    final = W.ranked(W.composite(scores, sinks.load_weights(spark, weights_path)))
    if out is not None:
        sinks.write_fleet(accepted, f"{out}/fleet")
        sinks.write_csv(RP.rule_stats(candidates.select("dataset_id", "source", "name", "domain", "url"), results), f"{out}/rule_stats")
        sinks.write_csv(stats, f"{out}/soft_stats")
        sinks.write_csv(final, f"{out}/critic_scores")
    return Run(results, selection, stats, final)


def calibrate(scores: DataFrame, out: str | None = None, source: str = "soft scores") -> DataFrame:
    """Weights from the score table: CRITIC blended with the expert points, frozen as JSON."""
    spark = scores.sparkSession
    pointed = cut(W.points(W.critic_weights(spark, scores)))
    if out is not None:
        sinks.write_calibration(scores, pointed, scores.select("dataset_id").distinct().count(), out, source)
    return pointed


def rescore(fleet: Fleet, done: DataFrame | None = None, rules=SOFT_RULES) -> DataFrame:
    """Soft scores of datasets not scored yet."""
    todo = fleet.datasets if done is None else RP.pending(fleet.datasets, done)
    return score_fleet(fleet.only(todo), rules)
