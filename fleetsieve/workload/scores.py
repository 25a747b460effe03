"""Profiles, soft rules, weights and duplicate resolution over the driver-table fleet."""
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.stats import r6 as R
from fleetsieve.functions.text import NUMBER_PATTERN
from fleetsieve.operators import duplicates as D
from fleetsieve.operators import profile as P
from fleetsieve.operators import soft_rules as S
from fleetsieve.operators import weights as W
from fleetsieve.session import cut, written
from fleetsieve.workload.fixture import fleet, fleet_sql
from fleetsieve.workload.registry import query
from fleetsieve.workload.sql import r6, with_ctes

SOFT_SQL = {
    **fleet_sql(),
    "prof": f"""SELECT *, n - n_present AS missing, (n - n_present) / n::DOUBLE AS missing_rate FROM (
SELECT dataset_id, feat_id, is_num, count(*) AS n, count(coalesce(num::VARCHAR, str)) AS n_present,
  avg(num) AS mean, var_pop(num) AS var,
  CASE WHEN is_num THEN coalesce(min(num) = max(num), TRUE) ELSE coalesce(min(str) = max(str), TRUE) END AS constant,
  coalesce(bool_or(str IS NOT NULL AND NOT regexp_matches(str, '{NUMBER_PATTERN}')), FALSE) AS mixed
FROM cells GROUP BY 1, 2, 3)""",
    "centre": """SELECT dataset_id, feat_id, count(num) AS n, avg(num) AS mean, stddev_samp(num) AS std,
  stddev_pop(num) AS spread FROM cells WHERE is_num GROUP BY 1, 2
HAVING count(num) >= 2 AND min(num) < max(num)""",
    "moments": """SELECT c.dataset_id, c.feat_id, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std,
  avg(power((num - mean) / spread, 3)) AS skew, avg(power((num - mean) / spread, 4)) - 3 AS kurt
FROM cells c JOIN centre USING (dataset_id, feat_id) WHERE num IS NOT NULL GROUP BY 1, 2""",
    "prints": "SELECT d.source, d.dataset_id, q.dim, coalesce(q.v, 0) AS v FROM datasets d JOIN ("
    + " UNION ALL ".join(
        f"SELECT dataset_id, {7 * i + j} AS dim, {expr.format(m)} AS v FROM datasets LEFT JOIN moments "
        "USING (dataset_id) GROUP BY 1"
        for i, m in enumerate(P.MOMENTS)
        for j, expr in enumerate([f"quantile_cont({{}}, {q})" for q in V.FINGERPRINT_QUANTILES]
                                 + ["avg({})", "stddev_pop({})"]))
    + ") q USING (dataset_id)",
    "z": """SELECT source, dataset_id, dim, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9) AS z
FROM prints WINDOW w AS (PARTITION BY source, dim)""",
    "norms": "SELECT source, dataset_id, sqrt(sum(z * z)) AS norm FROM z GROUP BY 1, 2",
    "s1": """SELECT d.dataset_id, d.source, greatest(0.0, coalesce(max(c.cos), 0.0)) AS max_similarity,
  greatest(0.0, least(1.0, 1.0 - greatest(0.0, coalesce(max(c.cos), 0.0)))) AS score
FROM datasets d LEFT JOIN (
  SELECT a.dataset_id, sum(a.z * b.z) / any_value(na.norm * nb.norm) AS cos
  FROM z a JOIN z b ON a.source = b.source AND a.dim = b.dim AND a.dataset_id <> b.dataset_id
  JOIN norms na ON na.dataset_id = a.dataset_id JOIN norms nb ON nb.dataset_id = b.dataset_id
  WHERE na.norm > 0 AND nb.norm > 0
  GROUP BY a.dataset_id, b.dataset_id) c USING (dataset_id) GROUP BY 1, 2""",
    "groups": "SELECT dataset_id, count(*) AS n FROM samples GROUP BY dataset_id, num, txt, y_str, y_num",
    "s2": """SELECT dataset_id, sum(n) AS n_rows, coalesce(sum(n) FILTER (n > 1), 0) AS n_duplicate_rows,
  count(*) FILTER (n > 1) AS n_duplicate_groups,
  coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS duplicate_fraction,
  1.0 - coalesce(sum(n) FILTER (n > 1), 0) / sum(n)::DOUBLE AS score FROM groups GROUP BY 1""",
    "parts": """SELECT dataset_id, count(*) AS n_features, count(*) FILTER (missing > 0) AS n_cols_with_missing,
  avg(missing_rate) AS mean_missing_rate, max(missing_rate) AS max_missing_rate, 1.0 - avg(missing_rate) AS c_miss,
  count(*) FILTER (constant) AS n_constant, 1.0 - count(*) FILTER (constant) / count(*)::DOUBLE AS c_const,
  count(*) FILTER (mixed) AS n_mixed, 1.0 - count(*) FILTER (mixed) / count(*)::DOUBLE AS c_consist
FROM prof GROUP BY 1""",
    "s3": """SELECT dataset_id, c_miss, c_const, c_consist,
  (0.35 * c_miss + 0.25 * c_const + 0.10 * c_consist) / (0.35 + 0.25 + 0.10) AS score FROM parts""",
    "filled": """SELECT c.dataset_id, c.feat_id, coalesce(c.num, p.mean) AS v, c.y_str, c.y_num
FROM cells c JOIN prof p USING (dataset_id, feat_id) WHERE c.is_num AND NOT p.constant""",
    "ranked_x": """SELECT dataset_id, feat_id, y_str, rank() OVER (PARTITION BY dataset_id, feat_id ORDER BY v)
  + (count(*) OVER (PARTITION BY dataset_id, feat_id, v) - 1) / 2.0::DOUBLE AS r FROM filled WHERE y_str IS NOT NULL""",
    "auc": """SELECT dataset_id, feat_id, min(2 * least(auc, 1 - auc)) AS stat FROM (
  SELECT dataset_id, feat_id, y_str, (sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE)
    / (count(*) * (sum(count(*)) OVER (PARTITION BY dataset_id, feat_id) - count(*)))::DOUBLE AS auc
  FROM ranked_x GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "ranked_xy": """SELECT dataset_id, feat_id, rank() OVER (PARTITION BY dataset_id, feat_id ORDER BY v)
  + (count(*) OVER (PARTITION BY dataset_id, feat_id, v) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY dataset_id, feat_id ORDER BY y_num)
  + (count(*) OVER (PARTITION BY dataset_id, feat_id, y_num) - 1) / 2.0::DOUBLE AS ry
FROM filled WHERE y_num IS NOT NULL""",
    "spearman": """SELECT dataset_id, feat_id, 1 - abs((sum(rx * ry) - sum(rx) * sum(ry) / count(*))
  / sqrt((sum(rx * rx) - sum(rx) * sum(rx) / count(*)) * (sum(ry * ry) - sum(ry) * sum(ry) / count(*)))) AS stat
FROM ranked_xy GROUP BY 1, 2""",
    "stats": "SELECT * FROM auc UNION ALL SELECT * FROM spearman",
    "s4": """SELECT dataset_id, min(stat) AS top_stat, median(stat) AS median_stat, median(stat) - min(stat) AS gap,
  count(*) AS n_features_scored, greatest(0.0, 1.0 - (median(stat) - min(stat))) AS score FROM stats GROUP BY 1""",
    "hist": """SELECT dataset_id, least(floor((y_num - lo) / (hi - lo) * 10), 9)::INT AS bin, count(*) AS n
FROM samples JOIN (SELECT dataset_id, min(y_num) AS lo, max(y_num) AS hi FROM samples GROUP BY 1) USING (dataset_id)
WHERE y_num IS NOT NULL GROUP BY 1, 2""",
    "classes": "SELECT dataset_id, y_str AS cls, count(*) AS n FROM samples WHERE y_str IS NOT NULL GROUP BY 1, 2",
    "s5": """SELECT dataset_id, count(*) AS k, -sum(p * ln(p)) AS entropy, -sum(p * ln(p)) / ln(count(*)) AS score
FROM (SELECT dataset_id, n / sum(n) OVER (PARTITION BY dataset_id) AS p FROM (
  SELECT dataset_id, n FROM hist UNION ALL SELECT dataset_id, n FROM classes)) GROUP BY 1""",
    "batches": """SELECT dataset_id, coalesce(y_str, y_num::VARCHAR) AS y, batch, count(*) AS n FROM samples
WHERE batch IS NOT NULL GROUP BY 1, 2, 3""",
    "s6": """SELECT d.dataset_id, s.nmi, 1.0 - s.nmi AS score FROM datasets d LEFT JOIN (
  SELECT dataset_id, greatest(mi, 0) / ((hy + hb) / 2) AS nmi FROM (
    SELECT dataset_id, sum(n / t * ln(n * t / (ny * nb))) AS mi,
      any_value(hy) AS hy, any_value(hb) AS hb FROM (
      SELECT *, sum(n) OVER (PARTITION BY dataset_id)::DOUBLE AS t, sum(n) OVER (PARTITION BY dataset_id, y)::DOUBLE AS ny,
        sum(n) OVER (PARTITION BY dataset_id, batch)::DOUBLE AS nb FROM batches)
    JOIN (SELECT dataset_id, -sum(n / t * ln(n / t)) AS hy FROM (SELECT dataset_id, y, sum(n)::DOUBLE AS n,
      sum(sum(n)) OVER (PARTITION BY dataset_id)::DOUBLE AS t FROM batches GROUP BY 1, 2) GROUP BY 1) USING (dataset_id)
    JOIN (SELECT dataset_id, -sum(n / t * ln(n / t)) AS hb FROM (SELECT dataset_id, batch, sum(n)::DOUBLE AS n,
      sum(sum(n)) OVER (PARTITION BY dataset_id)::DOUBLE AS t FROM batches GROUP BY 1, 2) GROUP BY 1) USING (dataset_id)
    GROUP BY 1)) s USING (dataset_id)""",
    "scores": " UNION ALL ".join(f"SELECT dataset_id, 'S{i}' AS rule, score::DOUBLE AS score FROM s{i}" for i in range(1, 7)),
    "ahp_w": "SELECT * FROM (VALUES ('S1', 10.0::DOUBLE), ('S2', 10.0), ('S3', 15.0), ('S4', 20.0), ('S5', 5.0)) t(rule, w)",
    "composites": """SELECT dataset_id, sum(score * w) / sum(w) FILTER (score IS NOT NULL) AS fraction
FROM scores JOIN ahp_w USING (rule) GROUP BY 1""",
    "imputed": """SELECT dataset_id, rule, coalesce(score, median(score) OVER (PARTITION BY rule)) AS score FROM scores""",
    "scaled": """SELECT dataset_id, rule, (score - lo) / (hi - lo) AS x FROM imputed JOIN (
  SELECT rule, min(score) AS lo, max(score) AS hi FROM imputed GROUP BY 1 HAVING stddev_samp(score) > 1e-9) USING (rule)""",
    "corrs": """SELECT a.rule, b.rule AS other, corr(a.x, b.x) AS r FROM scaled a JOIN scaled b USING (dataset_id) GROUP BY 1, 2""",
    "info": """SELECT rule, sd AS stdv, sd * conflict AS info FROM (SELECT rule, stddev_samp(x) AS sd FROM scaled GROUP BY 1)
JOIN (SELECT rule, sum(1 - r) AS conflict FROM corrs GROUP BY 1) USING (rule)""",
    "rules": "SELECT * FROM (VALUES ('S1', 0, 10), ('S2', 1, 10), ('S3', 2, 15), ('S4', 3, 20), ('S5', 4, 5), ('S6', 5, 0)) "
             "t(rule, place, ahp)",
    "weighed": """SELECT rule, place, ahp, coalesce(stdv, 0) AS stdv, coalesce(info, 0) AS info, info IS NOT NULL AS informative,
  coalesce(info / sum(info) OVER (), 0) AS w FROM rules LEFT JOIN info USING (rule)""",
    "lead": "SELECT rule AS top FROM weighed WHERE informative ORDER BY w DESC, place LIMIT 1",
    "cpoints": """SELECT *, cp0 + CASE WHEN rule = top THEN 60 - sum(cp0) OVER () ELSE 0 END AS cp FROM (
  SELECT *, round_even(w * 60, 0)::INT AS cp0 FROM weighed, lead)""",
    "fpoints": """SELECT *, fp0 + CASE WHEN rule = top THEN 60 - sum(fp0) OVER () ELSE 0 END AS fp FROM (
  SELECT *, CASE WHEN informative THEN round_even(0.6 * ahp + 0.4 * cp, 0) ELSE ahp END::INT AS fp0 FROM cpoints)""",
    "hashes": """SELECT DISTINCT d.pos, d.dataset_id, list_sort(list_transform(num, lambda x: coalesce(x, -1e30))) AS h
FROM samples JOIN datasets d USING (dataset_id)""",
    "sizes": "SELECT pos, dataset_id, count(*) AS size FROM hashes GROUP BY 1, 2",
    "edges": """SELECT a.dataset_id AS earlier, b.dataset_id AS later, a.pos AS a, b.pos AS b, count(*) AS shared,
  count(*) / any_value(least(sa.size, sb.size))::DOUBLE AS overlap
FROM hashes a JOIN hashes b ON a.h = b.h AND a.pos < b.pos
JOIN sizes sa ON sa.pos = a.pos JOIN sizes sb ON sb.pos = b.pos GROUP BY 1, 2, 3, 4""",
}


def q(final):
    return with_ctes(SOFT_SQL, final)


def cols(*names, table, rounded=()):
    return "SELECT " + ", ".join([*names, *[f"{r6(c)} AS {c}" for c in rounded]]) + f" FROM {table}"


def out(df, *names, rounded=()):
    return df.select(*names, *[R(F.col(c)).alias(c) for c in rounded])


@query("io2_cells_by_column", q(f"""SELECT dataset_id, feat_id, is_num, count(*) AS n,
  count(coalesce(num::VARCHAR, str)) AS n_present, {r6('sum(num) / 1000')} AS total FROM cells GROUP BY 1, 2, 3"""))
def io2(spark, sf):
    cells = fleet(spark, sf).cells()
    return cells.groupBy("dataset_id", "feat_id", "is_num").agg(
        F.count("*").alias("n"), F.count(F.coalesce(F.col("num").cast("string"), "str")).alias("n_present"),
        R(F.sum("num") / 1000).alias("total"))


@query("g1_column_moments", q(cols("dataset_id", "feat_id", "n", table="moments", rounded=P.MOMENTS)))
def g1(spark, sf):
    return out(P.column_moments(fleet(spark, sf)), "dataset_id", "feat_id", "n", rounded=P.MOMENTS)


@query("g2_fingerprint", q(cols("source", "dataset_id", "dim", table="prints", rounded=["v"])))
def g2(spark, sf):
    f = fleet(spark, sf)
    rows = P.fingerprint_rows(P.fingerprint(f.datasets, P.column_moments(f)))
    return out(rows, "source", "dataset_id", "dim", rounded=["v"])


@query("g3_column_profile", q(cols("dataset_id", "feat_id", "n", "n_present", "missing", "constant", "mixed", table="prof",
                                   rounded=["missing_rate", "mean", "var"])))
def g3(spark, sf):
    return out(P.column_profile(fleet(spark, sf)), "dataset_id", "feat_id", "n", "n_present", "missing", "constant", "mixed",
               rounded=["missing_rate", "mean", "var"])


@query("g3_distinct_counts", q("""SELECT dataset_id, feat_id, count(DISTINCT coalesce(num::VARCHAR, str)) AS n_unique
FROM cells GROUP BY 1, 2"""))
def g3_distinct(spark, sf):
    return P.distinct_counts(fleet(spark, sf))


@query("g4_top_variance", q("""SELECT dataset_id, feat_id, r AS var_rank FROM (
  SELECT dataset_id, feat_id, row_number() OVER (PARTITION BY dataset_id ORDER BY var DESC NULLS LAST, feat_id) AS r
  FROM prof WHERE is_num) WHERE r <= 3"""))
def g4(spark, sf):
    return P.top_variance(P.column_profile(fleet(spark, sf)), 3).select("dataset_id", "feat_id", "var_rank")


@query("g5_class_counts", q("SELECT * FROM classes"))
def g5(spark, sf):
    return P.class_counts(fleet(spark, sf))


@query("g6_target_histogram", q("SELECT * FROM hist"))
def g6(spark, sf):
    return P.target_histogram(fleet(spark, sf))


def s1_of(f, summary=None):
    return S.s1_uniqueness(P.fingerprint(f.datasets, P.column_moments(f, summary)))


@query("s1_uniqueness", q(cols("dataset_id", "source", table="s1", rounded=["max_similarity", "score"])))
def s1(spark, sf):
    return out(s1_of(fleet(spark, sf)), "dataset_id", "source", rounded=["max_similarity", "score"])


@query("j7_pairwise_cosine", q(f"""SELECT dataset_id, {r6('max_similarity')} AS max_similarity FROM s1"""))
def j7(spark, sf):
    f = fleet(spark, sf)
    units = S.standardised(P.fingerprint(f.datasets, P.column_moments(f)))
    return out(S.max_cosine(units, block=4), "dataset_id", rounded=["max_similarity"])


@query("s2_sample_duplication", q(cols("dataset_id", "n_rows::BIGINT AS n_rows", "n_duplicate_rows::BIGINT AS n_duplicate_rows",
                                       "n_duplicate_groups", table="s2", rounded=["duplicate_fraction", "score"])))
def s2(spark, sf):
    return out(S.s2_sample_duplication(fleet(spark, sf)), "dataset_id", "n_rows", "n_duplicate_rows", "n_duplicate_groups",
               rounded=["duplicate_fraction", "score"])


@query("s3a_completeness", q(cols("dataset_id", "n_features", "n_cols_with_missing", table="parts",
                                  rounded=["mean_missing_rate", "max_missing_rate", "c_miss"])))
def s3a(spark, sf):
    return out(S.quality_parts(P.column_profile(fleet(spark, sf))), "dataset_id", "n_features", "n_cols_with_missing",
               rounded=["mean_missing_rate", "max_missing_rate", "c_miss"])


@query("s3b_non_constant", q(cols("dataset_id", "n_features", "n_constant", table="parts", rounded=["c_const"])))
def s3b(spark, sf):
    return out(S.quality_parts(P.column_profile(fleet(spark, sf))), "dataset_id", "n_features", "n_constant", rounded=["c_const"])


@query("s3c_consistency", q(cols("dataset_id", "n_features", "n_mixed", table="parts", rounded=["c_consist"])))
def s3c(spark, sf):
    return out(S.quality_parts(P.column_profile(fleet(spark, sf))), "dataset_id", "n_features", "n_mixed", rounded=["c_consist"])


def s3_of(f, profile, outliers=None):
    return S.s3_data_quality(f.datasets, S.quality_parts(profile), outliers)


@query("s3_data_quality", q(cols("dataset_id", table="s3", rounded=["c_miss", "c_const", "c_consist", "score"])))
def s3(spark, sf):
    f = fleet(spark, sf)
    return out(s3_of(f, P.column_profile(f)), "dataset_id", rounded=["c_miss", "c_const", "c_consist", "score"])


@query("s4a_auc_per_feature", q(cols("dataset_id", "feat_id", table="auc", rounded=["stat"])))
def s4a(spark, sf):
    f = fleet(spark, sf)
    return out(S.auc_per_feature(f, P.numeric_profile(f)), "dataset_id", "feat_id", rounded=["stat"])


@query("s4b_spearman_per_feature", q(cols("dataset_id", "feat_id", table="spearman", rounded=["stat"])))
def s4b(spark, sf):
    f = fleet(spark, sf)
    return out(S.spearman_per_feature(f, P.numeric_profile(f)), "dataset_id", "feat_id", rounded=["stat"])


def s4_of(f, profile):
    return S.s4_leakage(f.datasets, S.feature_stats(f, profile))


@query("s4_leakage", q(cols("dataset_id", "n_features_scored", table="s4", rounded=["top_stat", "median_stat", "gap", "score"])))
def s4(spark, sf):
    f = fleet(spark, sf)
    return out(s4_of(f, P.numeric_profile(f)), "dataset_id", "n_features_scored",
               rounded=["top_stat", "median_stat", "gap", "score"])


@query("s4_top_leaks", q(f"""SELECT dataset_id, feat, {r6('stat')} AS stat, place FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset_id ORDER BY stat, feat_id) AS place FROM stats) JOIN features USING (dataset_id, feat_id) WHERE place <= 5"""))
def s4_top(spark, sf):
    f = fleet(spark, sf)
    leaks = S.top_leaks(S.feature_stats(f, P.numeric_profile(f)), f.features)
    return out(leaks, "dataset_id", "feat", "place", rounded=["stat"])


@query("s5_class_balance", q(cols("dataset_id", "k", table="s5", rounded=["entropy", "score"])))
def s5(spark, sf):
    return out(S.s5_class_balance(fleet(spark, sf)), "dataset_id", "k", rounded=["entropy", "score"])


@query("s6_batch_effect", q(cols("dataset_id", table="s6", rounded=["nmi", "score"])))
def s6(spark, sf):
    return out(S.s6_batch_effect(fleet(spark, sf)), "dataset_id", rounded=["nmi", "score"])


def score_table(f, outliers=None):
    """S1..S6 of a fleet, kept as a written table: weighting reads it many times."""
    summary = written(P.numeric_summary(f), "summary")
    profile = cut(P.column_profile(f, summary))
    return cut(S.soft_scores(S1=s1_of(f, summary), S2=S.s2_sample_duplication(f), S3=s3_of(f, profile, outliers), S4=s4_of(f, profile),
                         S5=S.s5_class_balance(f), S6=S.s6_batch_effect(f)))


@query("soft_scores", q(cols("dataset_id", "rule", table="scores", rounded=["score"])))
def soft(spark, sf):
    return out(score_table(fleet(spark, sf)), "dataset_id", "rule", rounded=["score"])


@query("w1_impute_median", q(cols("dataset_id", "rule", table="imputed", rounded=["score"])))
def w1(spark, sf):
    return out(W.impute_median(score_table(fleet(spark, sf))), "dataset_id", "rule", rounded=["score"])


@query("w2_minmax", q(cols("dataset_id", "rule", table="scaled", rounded=["x"])))
def w2(spark, sf):
    return out(W.minmax(W.impute_median(score_table(fleet(spark, sf)))), "dataset_id", "rule", rounded=["x"])


@query("w3_correlation", q("SELECT rule, other, round(r, 4) + 0.0 AS r FROM corrs"))
def w3(spark, sf):
    scaled = W.minmax(W.impute_median(score_table(fleet(spark, sf))))
    return W.correlation(scaled).select("rule", "other", F.round("r", 4).alias("r"))


def pointed(spark, sf):
    return W.points(W.critic_weights(spark, score_table(fleet(spark, sf))))


@query("w4_critic_weights", q(f"SELECT rule, {r6('stdv')} AS stdv, {r6('info')} AS informativeness, {r6('w')} AS critic_weight, informative FROM weighed"))
def w4(spark, sf):
    return out(W.critic_weights(spark, score_table(fleet(spark, sf))), "rule", "informative",
               rounded=["stdv", "informativeness", "critic_weight"])


@query("w5_integer_points", q("SELECT rule, cp::INT AS critic_pts FROM cpoints"))
def w5(spark, sf):
    return pointed(spark, sf).select("rule", "critic_pts")


@query("w6_blend", q("SELECT rule, ahp AS ahp_pts, cp::INT AS critic_pts, fp::INT AS final_pts FROM fpoints"))
def w6(spark, sf):
    return pointed(spark, sf).select("rule", "ahp_pts", "critic_pts", "final_pts")


@query("w7_verdict", q("""SELECT rule, ahp AS ahp_pts, cp::INT AS critic_pts, fp::INT AS final_pts, round(stdv, 4) AS std,
  round(info, 4) AS informativeness, abs(ahp - cp)::INT AS delta,
  CASE WHEN informative AND abs(ahp - cp) > 3 THEN 'DIVERGE' ELSE 'AGREE' END AS verdict FROM fpoints"""))
def w7(spark, sf):
    return W.results_table(pointed(spark, sf))


@query("w8_composite", q(f"""SELECT dataset_id, {r6('fraction')} AS composite_fraction, {r6('fraction * 60')} AS composite_score,
  coalesce(fraction >= 0.6, FALSE) AS passed FROM composites"""))
def w8(spark, sf):
    c = W.ranked(W.composite(score_table(fleet(spark, sf)), W.default_weights(spark)))
    return out(c, "dataset_id", "passed", rounded=["composite_fraction", "composite_score"])


@query("w8_composite_calibrated", q(f"""SELECT dataset_id, {r6('sum(score * fp) / sum(fp) FILTER (score IS NOT NULL)')} AS composite_fraction
FROM scores JOIN fpoints USING (rule) GROUP BY 1"""))
def w8_calibrated(spark, sf):
    scores = score_table(fleet(spark, sf))
    weights = W.points(W.critic_weights(spark, scores)).select("rule", F.col("final_pts").cast("double").alias("w"))
    return out(W.composite(scores, weights), "dataset_id", rounded=["composite_fraction"])


@query("w10_tier", q("""SELECT dataset_id, CASE WHEN fraction >= 0.8 THEN 'best' WHEN fraction >= 0.7 THEN 'good'
  WHEN fraction >= 0.6 THEN 'mediocre' WHEN fraction >= 0.5 THEN 'poor' ELSE 'really bad' END AS tier FROM composites"""))
def w10(spark, sf):
    c = W.composite(score_table(fleet(spark, sf)), W.default_weights(spark))
    return c.select("dataset_id", W.tier(F.col("composite_fraction")).alias("tier"))


@query("a6a_sorted_row_hash", q("SELECT dataset_id, size AS n_hashes FROM sizes"))
def a6a(spark, sf):
    return D.sorted_row_hashes(fleet(spark, sf)).groupBy("dataset_id").agg(F.count("*").alias("n_hashes"))


@query("j6_row_overlap", q(f"SELECT earlier, later, shared, {r6('overlap')} AS overlap FROM edges"))
def j6(spark, sf):
    return out(D.row_overlap(fleet(spark, sf), 0.0), "earlier", "later", "shared", rounded=["overlap"])


GREEDY = """WITH RECURSIVE {ctes},
near AS (SELECT b AS pos, list(a) AS near FROM edges WHERE overlap > 0.3 GROUP BY 1),
line AS (SELECT d.pos, d.dataset_id, d.source, coalesce(n.near, []) AS near FROM datasets d LEFT JOIN near n USING (pos)),
walk AS (
  SELECT -1 AS pos, []::INT[] AS picked, []::VARCHAR[] AS sources, NULL::VARCHAR AS status
  UNION ALL
  SELECT w.pos + 1,
    CASE WHEN {full} OR list_has_any(w.picked, l.near) THEN w.picked ELSE list_append(w.picked, l.pos) END,
    CASE WHEN {full} OR list_has_any(w.picked, l.near) THEN w.sources ELSE list_append(w.sources, l.source) END,
    CASE WHEN {full} THEN 'skipped' WHEN list_has_any(w.picked, l.near) THEN 'rejected' ELSE 'accepted' END
  FROM walk w JOIN line l ON l.pos = w.pos + 1),
matched AS (SELECT l.pos, min(n) AS m FROM line l, walk w, LATERAL (SELECT unnest(l.near) AS n) u
  WHERE w.pos = u.n AND w.status = 'accepted' GROUP BY 1)
SELECT l.dataset_id, w.status, CASE WHEN w.status = 'rejected' THEN e.earlier END AS matched,
  CASE WHEN w.status = 'rejected' THEN round(e.overlap, 6) END AS overlap
FROM line l JOIN walk w USING (pos) LEFT JOIN matched m USING (pos) LEFT JOIN edges e ON e.a = m.m AND e.b = l.pos"""


def greedy(full):
    ctes = with_ctes(SOFT_SQL, "SELECT * FROM edges JOIN datasets").removeprefix("WITH ").rsplit("\nSELECT", 1)[0]
    return GREEDY.format(ctes=ctes, full=full)


@query("a6_cross_duplicate", greedy("FALSE"))
def a6(spark, sf):
    f = fleet(spark, sf)
    chosen = D.select_fleet(f.datasets, D.sorted_row_hashes(f), max_total=None, max_per_source=None)
    return out(chosen, "dataset_id", "status", "matched", rounded=["overlap"])


@query("f0q_quota", greedy("(len(w.sources) >= 12 OR len(list_filter(w.sources, lambda s: s = l.source)) >= 3)"))
def f0q(spark, sf):
    f = fleet(spark, sf)
    chosen = D.select_fleet(f.datasets, D.sorted_row_hashes(f), max_total=12, max_per_source=3, batch=8)
    return out(chosen, "dataset_id", "status", "matched", rounded=["overlap"])
