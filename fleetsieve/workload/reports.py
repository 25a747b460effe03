"""Metrics of predictions and run records over whole driver tables."""
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions import stats as NS
from fleetsieve.functions.stats import r6 as R
from fleetsieve.operators import duplicates as D
from fleetsieve.operators import metadata_rules as M
from fleetsieve.operators import metrics as E
from fleetsieve.operators import reporting as RP
from fleetsieve.operators import soft_rules as S
from fleetsieve.operators import weights as W
from fleetsieve.workload.candidates import CAND, candidates
from fleetsieve.workload.fixture import fleet, read
from fleetsieve.workload.registry import query
from fleetsieve.workload.scores import SOFT_SQL, score_table
from fleetsieve.workload.sql import r6, with_ctes

CLASSES = {"emb": [str(i) for i in range(10)], "status": ["F", "O", "P"], "toxic": ["0", "1"]}


def draw(*cols):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 6), 16, 10).cast("bigint")


def class_scores(spark, sf):
    base = {"emb": read(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("y")),
            "status": read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y")),
            "toxic": read(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").cast("string").alias("y"))}
    out = None
    for name, df in base.items():
        d = df.select(F.lit(name).alias("dataset_id"), "row_id", "y", F.explode(F.array(*map(F.lit, CLASSES[name]))).alias("cls"))
        out = d if out is None else out.unionByName(d)
    points = draw(F.col("row_id").cast("string"), F.col("cls")) % 1000 + F.when(F.col("cls") == F.col("y"), 300).otherwise(0)
    return out.withColumn("score", points / 1000.0)


def class_preds(scores):
    return scores.groupBy("dataset_id", "row_id", "y").agg(
        F.min_by("cls", F.struct((-F.col("score")).alias("s"), "cls")).alias("yhat"))


def value_preds(spark, sf):
    share = 0.5 + (draw(F.col("event_id").cast("string")) % 1000) / 1000.0
    return read(spark, sf, "events").select(F.col("event_type").alias("dataset_id"), F.col("event_id").alias("row_id"),
                                            F.col("value").alias("y"), (F.col("value") * share).alias("yhat"))


def unnest(name, sql):
    return f"SELECT '{name}' AS dataset_id, row_id, y, unnest([{', '.join(repr(c) for c in CLASSES[name])}]) AS cls FROM ({sql})"


MET = {
    "raw": " UNION ALL ".join([
        unnest("emb", "SELECT vec_id AS row_id, label::VARCHAR AS y FROM embeddings"),
        unnest("status", "SELECT o_orderkey AS row_id, o_orderstatus AS y FROM orders"),
        unnest("toxic", "SELECT doc_id AS row_id, toxic::VARCHAR AS y FROM labels")]),
    "scored": """SELECT *, (('0x' || substr(md5(row_id || '|' || cls), 1, 6))::BIGINT % 1000
  + CASE WHEN cls = y THEN 300 ELSE 0 END) / 1000.0::DOUBLE AS score FROM raw""",
    "preds": "SELECT dataset_id, row_id, y, arg_min(cls, (-score, cls)) AS yhat FROM scored GROUP BY 1, 2, 3",
    "conf": "SELECT dataset_id, y, yhat, count(*) AS n FROM preds GROUP BY 1, 2, 3",
    "cls_all": "SELECT DISTINCT dataset_id, unnest([y, yhat]) AS cls FROM conf",
    "prf": """SELECT c.dataset_id, c.cls, coalesce(sum(n) FILTER (y = cls AND yhat = cls), 0) AS tp, coalesce(sum(n) FILTER (y = cls), 0) AS t,
  coalesce(sum(n) FILTER (yhat = cls), 0) AS p, coalesce(sum(n) FILTER (y = cls AND yhat = cls), 0) AS hit FROM cls_all c JOIN conf USING (dataset_id) GROUP BY 1, 2""",
    "prf3": """SELECT *, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(t, 0)::DOUBLE, 0) AS recall,
  coalesce(2 * tp / nullif(t + p, 0)::DOUBLE, 0) AS f1 FROM prf""",
    "clf": """SELECT *, (balanced_accuracy - 1.0 / n_classes) / (1 - 1.0 / n_classes::DOUBLE) AS adj_balanced_accuracy FROM (
  SELECT dataset_id, sum(tp) / sum(t)::DOUBLE AS accuracy, avg(recall) FILTER (t > 0) AS balanced_accuracy, avg(precision) AS precision,
  avg(recall) AS recall, avg(f1) AS f1, (sum(tp) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p))::DOUBLE * (sum(t) * sum(t) - sum(t * t))) AS mcc,
  count(*) FILTER (t > 0) AS n_classes FROM prf3 GROUP BY 1)""",
    "used": """SELECT s.* FROM scored s JOIN (SELECT dataset_id, count(DISTINCT y) AS k, max(y) AS top FROM scored GROUP BY 1) USING (dataset_id)
WHERE k <> 2 OR cls = top""",
    "thr": "SELECT dataset_id, cls, score, count(*) FILTER (cls = y) AS pos, count(*) FILTER (cls <> y) AS neg FROM used GROUP BY 1, 2, 3",
    "curve": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS all_pos, sum(neg) OVER a AS all_neg FROM thr
WINDOW w AS (PARTITION BY dataset_id, cls ORDER BY score DESC), a AS (PARTITION BY dataset_id, cls)""",
    "aucs": """SELECT dataset_id, avg(auc) AS roc_auc FROM (SELECT dataset_id, cls, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / any_value(all_pos * all_neg) AS auc
  FROM curve GROUP BY 1, 2) GROUP BY 1""",
    "reg_preds": """SELECT event_type AS dataset_id, event_id AS row_id, value AS y,
  value * (0.5::DOUBLE + (('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT % 1000) / 1000.0::DOUBLE) AS yhat FROM events""",
    "reg": """SELECT dataset_id, 1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
  avg(abs(yhat - y)) AS mae, median(abs(yhat - y)) AS median_ae, avg(abs(yhat - y) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
  max(abs(yhat - y)) AS max_error FROM reg_preds GROUP BY 1""",
}


def q(final, extra=None):
    return with_ctes({**MET, **(extra or {})}, final)


CLF = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "adj_balanced_accuracy"]
REG = ["r2", "rmse", "mae", "median_ae", "mape", "max_error"]


def out(df, *names, rounded=()):
    return df.select(*names, *[R(F.col(c)).alias(c) for c in rounded])


def sel(table, *names, rounded=()):
    return "SELECT " + ", ".join([*names, *[f"{r6(c)} AS {c}" for c in rounded]]) + f" FROM {table}"


@query("m5_classification_metrics", q(sel("clf", "dataset_id", "n_classes", rounded=CLF)))
def m5(spark, sf):
    return out(E.classification_metrics(class_preds(class_scores(spark, sf))), "dataset_id", "n_classes", rounded=CLF)


@query("m6_roc_auc", q(sel("aucs", "dataset_id", rounded=["roc_auc"])))
def m6(spark, sf):
    return out(E.roc_auc(class_scores(spark, sf)), "dataset_id", rounded=["roc_auc"])


@query("m7_average_precision", q(f"""SELECT dataset_id, {r6('avg(ap)')} AS pr_auc FROM (SELECT dataset_id, cls,
  sum(pos / all_pos::DOUBLE * (tp / (tp + fp)::DOUBLE)) AS ap FROM curve GROUP BY 1, 2) GROUP BY 1"""))
def m7(spark, sf):
    return out(E.average_precision(class_scores(spark, sf)), "dataset_id", rounded=["pr_auc"])


@query("m8_regression_metrics", q(sel("reg", "dataset_id", rounded=REG)))
def m8(spark, sf):
    return out(E.regression_metrics(value_preds(spark, sf)), "dataset_id", rounded=REG)


@query("m9_confusion_matrix", q("""SELECT a.dataset_id, a.y, b.y AS yhat, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT dataset_id, y FROM preds) a
JOIN (SELECT DISTINCT dataset_id, y FROM preds) b USING (dataset_id) LEFT JOIN conf c ON c.dataset_id = a.dataset_id AND c.y = a.y AND c.yhat = b.y"""))
def m9(spark, sf):
    return E.confusion_matrix(class_preds(class_scores(spark, sf)))


@query("m9_per_class_prf", q(sel("prf3", "dataset_id", "cls", rounded=["precision", "recall", "f1"])))
def m9_prf(spark, sf):
    return out(E.per_class(E.confusion(class_preds(class_scores(spark, sf)))), "dataset_id", "cls", rounded=["precision", "recall", "f1"])


@query("m10_roc_points", q(f"""SELECT dataset_id, cls, score, {r6('fp / all_neg')} AS fpr, {r6('tp / all_pos')} AS tpr FROM (
  SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS b1, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS b2 FROM curve
  WINDOW w AS (PARTITION BY dataset_id, cls ORDER BY score DESC)) WHERE b1 IS NULL OR b1 <> 0 OR b2 <> 0
UNION ALL SELECT DISTINCT dataset_id, cls, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM curve"""))
def m10_roc(spark, sf):
    return out(E.roc_points(class_scores(spark, sf)), "dataset_id", "cls", "score", rounded=["fpr", "tpr"])


@query("m10_pr_points", q(f"SELECT dataset_id, cls, score, {r6('tp / (tp + fp)')} AS precision, {r6('tp / all_pos')} AS recall FROM curve"))
def m10_pr(spark, sf):
    return out(E.pr_points(class_scores(spark, sf)), "dataset_id", "cls", "score", rounded=["precision", "recall"])


@query("m11_density2d", q("""SELECT a.dataset_id, a.row_id, coalesce(n, 0) AS density FROM (
  SELECT *, greatest(ceil((x - x0) / (x1 - x0) * 60) - 1, 0) AS lx, greatest(ceil((y - y0) / (y1 - y0) * 60) - 1, 0) AS ly FROM pts) a
LEFT JOIN (SELECT dataset_id, least(floor((x - x0) / (x1 - x0) * 60), 59) AS lx, least(floor((y - y0) / (y1 - y0) * 60), 59) AS ly, count(*) AS n
  FROM pts GROUP BY 1, 2, 3) USING (dataset_id, lx, ly)""", {"pts": """SELECT dataset_id, row_id, y AS x, yhat AS y, x0, x1, y0, y1 FROM reg_preds
JOIN (SELECT dataset_id, min(y) AS x0, max(y) AS x1, min(yhat) AS y0, max(yhat) AS y1 FROM reg_preds GROUP BY 1) USING (dataset_id)"""}))
def m11(spark, sf):
    points = value_preds(spark, sf).select("dataset_id", "row_id", F.col("y").alias("x"), F.col("yhat").alias("y"))
    return E.density2d(points).select("dataset_id", "row_id", "density")


def horner(cs, x):
    total = f"({cs[0]}::DOUBLE)"
    for c in cs[1:]:
        total = f"({total} * {x} + ({c}::DOUBLE))"
    return total


CENTRE = f"{horner(NS.CENTRE_NUM, '((m - 0.5) * (m - 0.5))')} * (m - 0.5) / {horner(NS.CENTRE_DEN, '((m - 0.5) * (m - 0.5))')}"
LOW, HIGH = "sqrt(-2 * ln(m))", "sqrt(-2 * ln(1 - m))"


@query("m12_qq_points", q(f"""SELECT dataset_id, place, {r6('t')} AS theoretical, {r6('residual')} AS residual,
  {r6('regr_slope(residual, t) OVER (PARTITION BY dataset_id)')} AS slope, {r6('regr_intercept(residual, t) OVER (PARTITION BY dataset_id)')} AS intercept
FROM (SELECT *, CASE WHEN m < 0.02425 THEN {horner(NS.TAIL_NUM, LOW)} / {horner(NS.TAIL_DEN, LOW)}
  WHEN m > 1 - 0.02425::DOUBLE THEN -{horner(NS.TAIL_NUM, HIGH)} / {horner(NS.TAIL_DEN, HIGH)} ELSE {CENTRE} END AS t FROM (
  SELECT *, CASE WHEN place = n THEN power(0.5::DOUBLE, 1.0 / n) WHEN place = 1 THEN 1 - power(0.5::DOUBLE, 1.0 / n)
    ELSE (place - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS m FROM (
    SELECT dataset_id, yhat - y AS residual, row_number() OVER (PARTITION BY dataset_id ORDER BY yhat - y) AS place,
    count(*) OVER (PARTITION BY dataset_id) AS n FROM reg_preds)))"""))
def m12(spark, sf):
    return out(E.qq_points(E.residuals(value_preds(spark, sf))), "dataset_id", "place", rounded=["theoretical", "residual", "slope", "intercept"])


@query("m13_insights", q("""SELECT dataset_id, 0 AS place, printf('Balanced accuracy %.2f - %s', balanced_accuracy, CASE WHEN balanced_accuracy > 0.9
  THEN 'highly learnable' WHEN balanced_accuracy < 0.3 THEN 'weak/hard' ELSE 'moderately learnable' END) AS text FROM clf
UNION ALL SELECT dataset_id, 1, printf('ROC-AUC %.2f class separability', roc_auc) FROM aucs
UNION ALL SELECT dataset_id, 0, printf('R^2 %.2f - %s', r2, CASE WHEN r2 > 0.75 THEN 'strong signal' WHEN r2 < 0.1 THEN 'weak/hard target'
  ELSE 'moderate signal' END) FROM reg"""))
def m13(spark, sf):
    scores = class_scores(spark, sf)
    return E.insights(E.classification_metrics(class_preds(scores)), E.roc_auc(scores), E.regression_metrics(value_preds(spark, sf)))


# ------------------------------------------------------------------ run records
def records(spark, sf):
    c = candidates(spark, sf)
    timed = M.run_metadata_rules(c).withColumn("runtime_s", (F.col("pos") * 7 + F.col("step")) / 1000.0)
    return c, RP.rule_stats(c.select("dataset_id", "source", "name", "domain", "url", "pos"), timed)


WIDE = ", ".join(f"max(CASE WHEN rule = '{r}' THEN CASE WHEN passed THEN 'pass' ELSE 'fail: ' || reason END END) AS {r}, "
                 f"max(CASE WHEN rule = '{r}' THEN (pos * 7 + step) / 1000.0::DOUBLE END) AS {r}_time" for r in V.HARD_RULES)
REC = {**CAND, "wide": f"SELECT dataset_id, bool_and(passed) AS ok, {WIDE} FROM ran GROUP BY 1",
       "recs": """SELECT c.dataset_id, c.source, c.name, c.pos, w.* EXCLUDE (dataset_id, ok),
  CASE WHEN ok IS NULL THEN 'error' WHEN ok THEN 'accepted' ELSE 'rejected' END AS status FROM cand c LEFT JOIN wide w USING (dataset_id)""",
       "edges6": "SELECT *, CASE " + " ".join(f"WHEN starts_with({r}, 'fail') THEN {i + 1}" for i, r in enumerate(V.HARD_RULES)) + " END AS stop FROM recs",
       "steps": "SELECT unnest(range(1, 7)) AS i, unnest(["
                + ", ".join(f"'{r} {V.HARD_RULE_NAMES[r]}'" for r in V.HARD_RULES) + "]) AS name",
       "flows": """SELECT source AS "start", 'A1 task type' AS "end", count(*) AS n FROM edges6 GROUP BY 1
UNION ALL SELECT s.name, CASE WHEN s.i = e.stop THEN 'Rejected' ELSE coalesce(t.name, 'Accepted') END, count(*)
FROM edges6 e JOIN steps s ON s.i <= coalesce(e.stop, 6) LEFT JOIN steps t ON t.i = s.i + 1 GROUP BY 1, 2"""}


@query("g15_rule_stats", with_ctes(REC, "SELECT * FROM recs"))
def g15(spark, sf):
    return records(spark, sf)[1].drop("domain", "url")


@query("g16_rule_runtimes", with_ctes(REC, " UNION ALL ".join(
    f"SELECT '{r}' AS rule, round(avg({r}_time), 3) AS mean_seconds FROM recs HAVING count({r}_time) > 0" for r in V.HARD_RULES)))
def g16(spark, sf):
    return RP.rule_runtimes(records(spark, sf)[1])


@query("g16_loader_runtimes", """SELECT event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'scrape' ELSE 'fetch' END AS phase,
  round(avg(value), 2) AS mean_seconds, count(*) AS n FROM events GROUP BY 1, 2""")
def g16_loader(spark, sf):
    t = read(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("user_id") % 2 == 0, "scrape").otherwise(
        "fetch").alias("phase"), F.col("value").alias("seconds"))
    return RP.loader_runtimes(t)


@query("g17_funnel_flows", with_ctes(REC, "SELECT * FROM flows"))
def g17(spark, sf):
    return RP.funnel_flows(records(spark, sf)[1])


@query("g17_funnel_nodes", with_ctes(REC, """SELECT node, greatest(sum(o), sum(i))::BIGINT AS n FROM (SELECT "start" AS node, n AS o, 0 AS i FROM flows
UNION ALL SELECT "end", 0, n FROM flows) GROUP BY 1"""))
def g17_nodes(spark, sf):
    return RP.funnel_nodes(RP.funnel_flows(records(spark, sf)[1]))


STATS = {**SOFT_SQL, "shapes": "SELECT dataset_id, count(*) AS n_rows, max(len(num) + len(txt)) AS n_features, count(DISTINCT y_str) AS k FROM samples GROUP BY 1"}


@query("g18_soft_stats", with_ctes(STATS, """SELECT d.dataset_id, d.source, d.name, d.url, d.task_type, h.n_rows, h.n_features,
  CASE WHEN contains(d.task_type, 'classification') THEN h.k END AS n_classes, """ + ", ".join(
    f"(SELECT {r6('any_value(score)')} FROM scores s WHERE s.dataset_id = d.dataset_id AND rule = '{r}') AS {r}" for r in V.RULES)
    + " FROM datasets d JOIN shapes h USING (dataset_id)"))
def g18(spark, sf):
    f = fleet(spark, sf)
    st = RP.soft_stats(f, score_table(f))
    return out(st, "dataset_id", "source", "name", "url", "task_type", "n_rows", F.col("n_features").cast("bigint").alias("n_features"), "n_classes", rounded=V.RULES)


@query("j8_report_join", with_ctes({**SOFT_SQL, **{k: v for k, v in MET.items() if k.startswith("reg")}}, f"""SELECT e.dataset_id, {r6('e.mae')} AS mae,
  {r6('c.fraction')} AS composite_fraction, {r6('c.s5')} AS "S5" FROM (SELECT 'ev-' || dataset_id AS dataset_id, mae FROM reg) e LEFT JOIN (
  SELECT dataset_id, fraction, s5.score AS s5 FROM composites LEFT JOIN s5 USING (dataset_id)) c USING (dataset_id)"""))
def j8(spark, sf):
    f = fleet(spark, sf)
    scores = score_table(f)
    metrics = E.regression_metrics(value_preds(spark, sf)).withColumn("dataset_id", F.concat(F.lit("ev-"), "dataset_id"))
    joined = RP.report_join(metrics, W.composite(scores, W.default_weights(spark)), RP.soft_stats(f, scores))
    return out(joined, "dataset_id", rounded=["mae", "composite_fraction", "S5"])


@query("io10_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def io10(spark, sf):
    done = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return RP.pending(read(spark, sf, "customer").select("c_custkey"), done, "c_custkey")
