"""Metadata rules and catalog selection over candidates made from whole driver tables."""
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.operators import data_rules as A
from fleetsieve.operators import duplicates as D
from fleetsieve.operators import metadata_rules as M
from fleetsieve.sources import catalogs as C
from fleetsieve.workload.fixture import fleet, fleet_sql, read
from fleetsieve.workload.registry import query
from fleetsieve.workload.sql import with_ctes

TASKS = ["Supervised Classification", "supervised-regression", "unknown", "clustering", "Regression"]
LICENCES = [None, "", " ", "CC0", "CC BY 4.0", "cc-by-nc-4.0", "CC BY-ND 4.0", "Public", "limited use",
            "Non Commercial", "proprietary", "Apache-2.0"]
PREFIXES = {3: "synthetic ", 7: "Toyota prices ", 11: "Monte Carlo run ", 13: "make_blobs_10 ", 17: "Tumour cell ",
            19: "plant species "}


def pick(items, index):
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in items]), (index % len(items) + 1).cast("int"))


def candidates(spark, sf):
    k = F.col("p_partkey")
    prefix = F.lit("")
    for r, text in PREFIXES.items():
        prefix = F.when(k % 23 == r, text).otherwise(prefix)
    return read(spark, sf, "part").select(
        F.concat(F.lit("c"), k.cast("string")).alias("dataset_id"), pick(V.SOURCES, k).alias("source"), k.alias("pos"),
        F.concat(prefix, "p_name").alias("name"),
        F.when(k % 11 != 0, F.col("p_size") * 10).cast("int").alias("n_samples"),
        F.when(k % 13 != 0, k * 2).cast("int").alias("n_features"), pick(TASKS, k).alias("task_type"),
        pick(LICENCES, k).alias("licence"), F.lit("").alias("url"), F.array("p_type", "p_brand").alias("tags"),
        F.lit("general").alias("domain"), F.col("p_retailprice").alias("price"))


def sql_list(items):
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in items) + "]"


def any_of(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


CAND = {
    "cand": f"""SELECT 'c' || p_partkey AS dataset_id, {sql_list(V.SOURCES)}[p_partkey % {len(V.SOURCES)} + 1] AS source,
  p_partkey AS pos, CASE {' '.join(f"WHEN p_partkey % 23 = {r} THEN '{t}'" for r, t in reversed(PREFIXES.items()))} ELSE '' END
  || p_name AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 10 END AS n_samples,
  CASE WHEN p_partkey % 13 <> 0 THEN p_partkey * 2 END AS n_features,
  {sql_list(TASKS)}[p_partkey % {len(TASKS)} + 1] AS task_type,
  {sql_list(LICENCES)}[p_partkey % {len(LICENCES)} + 1] AS licence, [p_type, p_brand] AS tags, p_type, p_brand,
  p_retailprice AS price FROM part""",
    "a1": f"""SELECT dataset_id, 'A1' AS rule, {any_of('t', V.ACCEPTED_TASKS)} AS passed,
  CASE WHEN {any_of('t', V.ACCEPTED_TASKS)} THEN '' ELSE 'task_type=''' || task_type || ''' not accepted' END AS reason
FROM (SELECT *, regexp_replace(replace(lower(task_type), '-', '_'), '^\\s+|\\s+$', '', 'g') AS t FROM cand)
WHERE t <> 'unknown'""",
    "a2": f"""SELECT dataset_id, 'A2' AS rule, bad IS NULL AS passed, coalesce(bad, '') AS reason FROM (
  SELECT dataset_id, CASE WHEN starts_with(lower(source), 'tcga') OR starts_with(lower(source), 'geo') THEN NULL
    WHEN regexp_matches(name, '{V.SYNTHETIC_PATTERN}') THEN 'name looks synthetic: ''' || name || ''''
    WHEN regexp_matches(p_type, '{V.SYNTHETIC_PATTERN}') THEN 'tag looks synthetic: ''' || p_type || ''''
    WHEN regexp_matches(p_brand, '{V.SYNTHETIC_PATTERN}') THEN 'tag looks synthetic: ''' || p_brand || '''' END AS bad FROM cand)""",
    "a4": """SELECT dataset_id, 'A4' AS rule, reason = '' AS passed, reason FROM (
  SELECT dataset_id, concat_ws('; ', CASE WHEN n_samples < 150 THEN 'N=' || n_samples || ' < 150' END,
    CASE WHEN n_features < 1000 THEN 'P=' || n_features || ' < 1000' END) AS reason
  FROM cand WHERE n_samples IS NOT NULL OR n_features IS NOT NULL)""",
    "a5": f"""SELECT dataset_id, 'A5' AS rule,
  norm = 'unknown' OR (NOT regexp_matches(norm, '{V.RESTRICTIVE_PATTERN}') AND {any_of('norm', V.ALLOWED_LICENCES)}) AS passed,
  CASE WHEN norm = 'unknown' THEN 'licence unknown, assuming open'
    WHEN regexp_matches(norm, '{V.RESTRICTIVE_PATTERN}') THEN 'restrictive licence: ''' || licence || ''''
    WHEN {any_of('norm', V.ALLOWED_LICENCES)} THEN '' ELSE 'licence ''' || licence || ''' not in allow-list' END AS reason
FROM (SELECT *, CASE WHEN coalesce(licence, '') = '' THEN 'unknown'
  ELSE replace(lower(regexp_replace(licence, '^\\s+|\\s+$', '', 'g')), ' ', '-') END AS norm FROM cand)""",
    "rules": """SELECT c.dataset_id, c.source, c.pos, r.rule, r.passed, r.reason FROM cand c JOIN (
  SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5) r USING (dataset_id)
WHERE source NOT IN ('chembl', 'plants', 'gp') AND NOT (source IN ('tcga', 'geo_rnaseq', 'mgnify') AND rule = 'A4')""",
    "ran": """SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY rule) - 1 AS step FROM (
  SELECT *, min(CASE WHEN NOT passed THEN rule END) OVER (PARTITION BY dataset_id) AS first_bad FROM rules)
WHERE first_bad IS NULL OR rule <= first_bad""",
    "good": "SELECT * FROM cand WHERE dataset_id NOT IN (SELECT dataset_id FROM rules WHERE NOT passed)",
}


def q(final, extra=None):
    return with_ctes({**CAND, **(extra or {})}, final)


def one_rule(df, column):
    return df.select("dataset_id", column.alias("r")).where(F.col("r").isNotNull()).select("dataset_id", "r.*")


@query("p1_task_meta", q("SELECT * FROM a1"))
def p1(spark, sf):
    return one_rule(candidates(spark, sf), M.a1_task_type(F.col("task_type")))


@query("p2_synthetic", q("SELECT * FROM a2"))
def p2(spark, sf):
    return one_rule(candidates(spark, sf), M.a2_synthetic(F.col("source"), F.col("name"), F.col("tags")))


@query("p3_dims_meta", q("SELECT * FROM a4"))
def p3(spark, sf):
    return one_rule(candidates(spark, sf), M.a4_dimensions(F.col("n_samples"), F.col("n_features")))


@query("p5_licence", q("SELECT * FROM a5"))
def p5(spark, sf):
    return one_rule(candidates(spark, sf), M.a5_licence(F.col("licence")))


@query("p6_run_metadata_rules", q("SELECT dataset_id, source, pos, step::INT AS step, rule, passed, reason FROM ran"))
def p6(spark, sf):
    return M.run_metadata_rules(candidates(spark, sf))


@query("p7_infer_domain", q(f"""SELECT dataset_id, CASE WHEN regexp_matches(b, '{V.BIOMEDICAL_PATTERN}') THEN 'biomedical'
  WHEN regexp_matches(b, '{V.BIOLOGICAL_PATTERN}') THEN 'biological' ELSE 'general' END AS domain
FROM (SELECT dataset_id, name || ' ' || p_type || ' ' || p_brand || ' ' AS b FROM cand)"""))
def p7(spark, sf):
    return candidates(spark, sf).select("dataset_id", M.infer_domain(
        F.col("name"), F.col("tags"), F.lit("")).alias("domain"))


@query("p7_infer_domain_documents", f"""SELECT doc_id, CASE WHEN regexp_matches(b, '{V.BIOMEDICAL_PATTERN}') THEN 'biomedical'
  WHEN regexp_matches(b, '{V.BIOLOGICAL_PATTERN}') THEN 'biological' ELSE 'general' END AS domain
FROM (SELECT doc_id, source || ' ' || lang || ' ' || text AS b FROM documents)""")
def p7_documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", M.infer_domain(
        F.col("source"), F.array("lang"), F.col("text")).alias("domain"))


TAG_SQL = ("CASE " + " ".join(f"WHEN list_has_any(tags, {sql_list(w)}) THEN '{d}'" for d, w in V.TAG_DOMAINS)
           + " ELSE 'general' END")
TAG_WORDS = ["Biology", "Clinical", "chemistry", "Geography", "misc"]


@query("p8_domain_from_tags", f"""SELECT p_partkey, {TAG_SQL} AS domain FROM (SELECT p_partkey,
  [lower(p_type), lower({sql_list(TAG_WORDS)}[p_size % 5 + 1]), lower({sql_list(TAG_WORDS)}[p_partkey % 5 + 1])] AS tags FROM part)""")
def p8(spark, sf):
    tags = F.array("p_type", pick(TAG_WORDS, F.col("p_size")), pick(TAG_WORDS, F.col("p_partkey")))
    return read(spark, sf, "part").select("p_partkey", C.domain_from_tags(tags).alias("domain"))


@query("p9_looks_tabular", f"""SELECT conv_id, NOT {any_of('lower(title)', V.NOT_TABULAR_WORDS)} AND
  coalesce(len(list_filter(names, lambda n: regexp_matches(n, '{V.PIXEL_NAME_PATTERN}'))) / len(names)::DOUBLE <= 0.5, TRUE) AS tabular
FROM (SELECT conv_id, min(text) AS title, list(CASE WHEN turn % 2 = 0 THEN 'pixel_' || turn ELSE role END) AS names
  FROM conversations GROUP BY 1)""")
def p9(spark, sf):
    turn = F.col("turn")
    made = read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.min("text").alias("title"),
        F.collect_list(F.when(turn % 2 == 0, F.concat(F.lit("pixel_"), turn.cast("string"))).otherwise(F.col("role"))).alias("names"))
    return made.select("conv_id", C.looks_tabular(F.col("title"), F.col("names")).alias("tabular"))


@query("p10_pick_record_set", """SELECT o_custkey, array_to_string(list_sort(list(name)), ',') AS names FROM (
  SELECT o_custkey, o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN 'f' || o_orderkey END AS name FROM orders)
JOIN (SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) USING (o_custkey, o_orderpriority)
WHERE name IS NOT NULL GROUP BY 1""")
def p10(spark, sf):
    k = F.col("o_orderkey")
    field = F.struct(F.when(k % 3 != 0, F.concat(F.lit("f"), k.cast("string"))).alias("name"))
    sets = (read(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(field).alias("field"))
            .groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderpriority", "field"))).alias("s")))
    bare = F.transform("s", lambda r: F.struct(r["field"].alias("field")))
    return (sets.select("o_custkey", F.array_join(F.array_sort(C.pick_record_set(bare)), ",").alias("names"))
            .where(F.col("names") != ""))


@query("p11_resolve_target", """SELECT p_brand, coalesce(max(p_name) FILTER (lower(p_name) = 'red widget'), arg_max(p_name, p_partkey)) AS target
FROM (SELECT p_brand, p_partkey, upper(p_name) AS p_name FROM part) GROUP BY 1""")
def p11(spark, sf):
    tables = read(spark, sf, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("p_partkey", F.upper("p_name").alias("c")))), lambda s: s["c"]).alias("columns"))
    return tables.select("p_brand", C.resolve_target(F.col("columns"), F.lit("Red Widget")).alias("target"))


P12_FILES = [("people", 0, "csv", "supplier"), ("people", 1, "csv", "customer"), ("people", 2, "parquet", "nation"),
             ("vectors", 0, "csv", "benchmark"), ("vectors", 1, "parquet", "embeddings"), ("texts", 0, "csv", "labels"),
             ("texts", 1, "csv", "region")]


def p12_sql():
    parts = []
    tables = {"supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "benchmark": ["item_id", "text"],
              "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
              "nation": ["n_nationkey", "n_name", "n_regionkey"], "embeddings": ["vec_id", "embedding", "label"],
              "labels": ["doc_id", "quality", "toxic"], "region": ["r_regionkey", "r_name"]}
    for ds, pos, fmt, t in P12_FILES:
        for i, c in enumerate(tables[t]):
            parts.append(f"SELECT '{ds}' AS ds, {pos} AS fp, '{fmt}' AS fmt, '{t}' AS stem, '{c}' AS col, {i} AS cp, count(*) AS n, "
                         f"count(*) - count({c}) AS miss, count(DISTINCT {c}) AS u FROM {t}")
    names = sql_list(V.TARGET_NAMES)
    return f"""SELECT dataset_id, stem, fmt, target FROM (SELECT ds AS dataset_id, stem, fmt, col AS target,
  row_number() OVER (PARTITION BY ds ORDER BY stage, a, b, cp) AS rn FROM (
  SELECT *, CASE WHEN col IN (SELECT unnest({names})) THEN CASE WHEN fmt = 'csv' THEN 1 ELSE 2 END
    WHEN fmt = 'csv' AND u <= 10 AND miss / n < 0.5 THEN 3 END AS stage,
    CASE WHEN col IN (SELECT unnest({names})) THEN fp ELSE u END AS a,
    CASE WHEN col IN (SELECT unnest({names})) THEN list_position({names}, col) ELSE fp END AS b
  FROM ({' UNION ALL '.join(parts)})) WHERE stage IS NOT NULL) WHERE rn = 1"""


@query("p12_discover_target", p12_sql())
def p12(spark, sf):
    profile = None
    for ds, pos, fmt, t in P12_FILES:
        p = C.wide_profile(read(spark, sf, t)).select(
            F.lit(ds).alias("dataset_id"), F.lit(pos).alias("file_pos"), F.lit(fmt).alias("fmt"), F.lit(t).alias("stem"), "*")
        profile = p if profile is None else profile.unionByName(p)
    return C.discover_target(profile)


@query("p13_task_from_type", """SELECT 'orders' AS tbl, 'o_totalprice' AS col, count(*) AS n, 'regression' AS task FROM orders
UNION ALL SELECT 'orders', 'o_orderstatus', count(*), 'classification' FROM orders
UNION ALL SELECT 'labels', 'quality', count(*), 'classification' FROM labels
UNION ALL SELECT 'events', 'value', count(*), 'regression' FROM events""")
def p13(spark, sf):
    out = None
    for t, col in [("orders", "o_totalprice"), ("orders", "o_orderstatus"), ("labels", "quality"), ("events", "value")]:
        part = read(spark, sf, t).groupBy(F.lit(t).alias("tbl"), F.lit(col).alias("col")).agg(
            F.count("*").alias("n"), F.first(F.typeof(col)).alias("ty"))
        part = part.select("tbl", "col", "n", C.task_from_type(F.col("ty")).alias("task"))
        out = part if out is None else out.unionByName(part)
    return out


STUDIES = """SELECT o_custkey, o_orderpriority AS col, CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'regression' ELSE 'classification' END AS type,
  o_orderstatus AS cls, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4"""


@query("p14_pick_task", f"""SELECT o_custkey, type, col FROM (SELECT o_custkey, type, col,
  row_number() OVER (PARTITION BY o_custkey ORDER BY type, CASE WHEN type = 'classification' THEN -sum(n) ELSE 0 END, col) AS rn
  FROM ({STUDIES}) GROUP BY 1, 2, 3) WHERE rn = 1""")
def p14(spark, sf):
    return study_tasks(spark, sf).select("o_custkey", C.pick_task(F.col("s.detected_tasks")).alias("t")).select(
        "o_custkey", "t.type", F.col("t.column").alias("col"))


def study_tasks(spark, sf):
    """Study descriptors as JSON text, one per customer, read back with a fixed schema."""
    o = read(spark, sf, "orders")
    per_class = o.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    kind = F.when(F.col("o_orderpriority").startswith("5"), "regression").otherwise("classification")
    task = per_class.groupBy("o_custkey", "o_orderpriority").agg(
        F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("classes"))
    tasks = task.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("o_orderpriority").alias("column"), kind.alias("type"), F.to_json("classes").alias("j")))).alias("t"))
    as_json = F.to_json(F.struct(
        F.concat(F.lit("GSE"), F.col("o_custkey").cast("string")).alias("accession"), F.size("t").alias("n_samples"),
        F.transform("t", lambda t: F.struct(t["type"].alias("type"), t["column"].alias("column"),
                                            F.from_json(t["j"], "map<string,bigint>").alias("classes"))).alias("detected_tasks")))
    return tasks.select("o_custkey", C.parse_study_json(as_json).alias("s"))


@query("io7_read_study_json", f"""SELECT 'GSE' || o_custkey AS accession, count(DISTINCT col)::INT AS n_tasks, sum(n)::BIGINT AS n_labels
FROM ({STUDIES}) GROUP BY 1""")
def io7(spark, sf):
    each = study_tasks(spark, sf).select("s.accession", F.explode("s.detected_tasks").alias("t"))
    labels = F.aggregate(F.map_values("t.classes"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return each.groupBy("accession").agg(F.count("*").cast("int").alias("n_tasks"), F.sum(labels).alias("n_labels"))


@query("p15_first_accepted_task", f"""SELECT p_brand AS dataset_id, CASE WHEN {any_of('t', V.ACCEPTED_TASKS)} THEN t ELSE 'unknown' END AS task_type
FROM (SELECT p_brand, lower(replace(arg_min(task, p_partkey), ' ', '_')) AS t FROM (
  SELECT *, {sql_list(TASKS)}[p_size % {len(TASKS)} + 1] AS task FROM part) GROUP BY 1)""")
def p15(spark, sf):
    tasks = read(spark, sf, "part").select(F.col("p_brand").alias("dataset_id"), F.col("p_partkey").alias("pos"),
                                           pick(TASKS, F.col("p_size")).alias("task_type"))
    return C.first_accepted_task(tasks)


def catalog(spark, sf):
    k = F.col("pos")
    return candidates(spark, sf).select(
        "*", F.when(k % 5 == 0, "Sparse_ARFF").otherwise("arff").alias("format"),
        F.when(k % 6 != 0, F.concat(F.lit("table://part/"), k.cast("string"))).alias("data_url"),
        (k * 4000).alias("bytes"), F.concat(F.when(k % 4 == 0, "GSE").otherwise("GDS"), k.cast("string")).alias("accession"),
        F.when(k % 3 != 0, "IPR_abundances_v5").otherwise("taxa").alias("downloads"))


CATALOG = {**CAND, "catalog": """SELECT *, CASE WHEN pos % 5 = 0 THEN 'Sparse_ARFF' ELSE 'arff' END AS format,
  CASE WHEN pos % 6 <> 0 THEN 'table://part/' || pos END AS data_url, pos * 4000 AS bytes,
  CASE WHEN pos % 4 = 0 THEN 'GSE' ELSE 'GDS' END || pos AS accession,
  CASE WHEN pos % 3 <> 0 THEN 'IPR_abundances_v5' ELSE 'taxa' END AS downloads FROM cand""",
    "kept": """SELECT * REPLACE (CASE WHEN source = 'uci' AND coalesce(licence, '') = '' THEN 'CC By 4.0' ELSE licence END AS licence)
FROM catalog WHERE CASE source WHEN 'openml' THEN n_samples >= 150 AND n_features >= 1000 AND lower(format) <> 'sparse_arff'
  WHEN 'uci' THEN data_url IS NOT NULL AND n_samples >= 150 AND n_features BETWEEN 1000 AND 250000
  WHEN 'kaggle' THEN bytes BETWEEN 5000000 AND 2000000000 AND n_features BETWEEN 1000 AND 250000
  WHEN 'geo_array' THEN starts_with(accession, 'GSE') AND n_samples >= 500 AND (n_features IS NULL OR n_features <= 250000)
  WHEN 'tcga' THEN n_samples >= 500 WHEN 'chembl' THEN n_samples >= 2000
  WHEN 'mgnify' THEN n_samples >= 150 AND contains(downloads, 'IPR_abundances') ELSE TRUE END"""}


@query("p16_catalog_prefilter", with_ctes(CATALOG, "SELECT dataset_id, source, licence FROM kept"))
def p16(spark, sf):
    return C.catalog_prefilter(catalog(spark, sf), max_features=V.MAX_FEATURES, max_bytes=V.KAGGLE_MAX_BYTES).select("dataset_id", "source", "licence")


@query("p17_keep_field", f"""SELECT doc_id, NOT {any_of('lower(text)', V.SKIPPED_FIELD_WORDS)} AS kept FROM documents""")
def p17(spark, sf):
    return read(spark, sf, "documents").select("doc_id", C.keep_field(F.col("text")).alias("kept"))


CROPS = ["rice", "maize", "soy", "sorghum", "spruce", "switchgrass"]
SPECIES = V.AGE_SPECIES + ["Vitis_vinifera", "Glycine_max"]


@query("p19_plant_study", f"""SELECT p_partkey, s AS species, CASE WHEN s IN (SELECT unnest({sql_list(V.AGE_SPECIES)})) THEN 'age' ELSE 'tissue' END AS target,
  CASE WHEN s IN (SELECT unnest({sql_list(V.AGE_SPECIES)})) THEN 'regression' ELSE 'classification' END AS task
FROM (SELECT p_partkey, {sql_list(SPECIES)}[p_size % {len(SPECIES)} + 1] AS s FROM part)""")
def p19(spark, sf):
    file = F.concat(F.col("p_partkey").cast("string"), F.lit("-"), pick(SPECIES, F.col("p_size")), F.lit("_combined_output.tsv"))
    species, target, task = C.plant_study(file)
    return read(spark, sf, "part").select("p_partkey", species.alias("species"), target.alias("target"), task.alias("task"))


@query("p19_crop_study", f"""SELECT p_partkey, c AS crop, CASE WHEN c IN ('rice', 'maize') THEN 'FT' WHEN c IN ('soy', 'sorghum') THEN 'YLD' ELSE 'HT' END AS trait
FROM (SELECT p_partkey, {sql_list(CROPS)}[p_size % 6 + 1] AS c FROM part)""")
def p19_crop(spark, sf):
    crop, trait = C.crop_study(F.concat(pick(CROPS, F.col("p_size")), F.lit("_geno.csv")))
    return read(spark, sf, "part").select("p_partkey", crop.alias("crop"), trait.alias("trait"))


@query("io6_pick_main_file", """SELECT source AS dataset_id, path, size FROM (SELECT source, path, n_chars AS size,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, path DESC) AS rn FROM (
  SELECT source, n_chars, 'd' || doc_id || CASE lang WHEN 'en' THEN '.csv' WHEN 'fr' THEN '.parquet' WHEN 'de' THEN '.csv.gz' ELSE '.txt' END AS path
  FROM documents) WHERE NOT ends_with(path, '.txt')) WHERE rn = 1""")
def io6(spark, sf):
    lang = F.col("lang")
    ext = F.when(lang == "en", ".csv").when(lang == "fr", ".parquet").when(lang == "de", ".csv.gz").otherwise(".txt")
    listing = read(spark, sf, "documents").select(
        F.col("source").alias("dataset_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("n_chars").alias("size"))
    return C.pick_main_file(listing)


@query("first_listing", """SELECT o_custkey AS accession, arg_min(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS pos FROM orders GROUP BY 1""")
def first_listing(spark, sf):
    return C.first_listing(read(spark, sf, "orders").select(
        F.col("o_custkey").alias("accession"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("pos")))


@query("limit_per_source", q("""SELECT dataset_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM good) WHERE rn <= 5"""))
def limit_per_source(spark, sf):
    return C.limit_per_source(candidates(spark, sf), 5).select("dataset_id", "source")


@query("f0_interleave", q("""SELECT dataset_id, round, row_number() OVER (ORDER BY round, first) AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS round, min(pos) OVER (PARTITION BY source) AS first FROM good)"""))
def f0(spark, sf):
    return D.interleave(M.accept_metadata(candidates(spark, sf))).select("dataset_id", "round", "turn")


FLEET = fleet_sql()


@query("p4_dims_data", with_ctes(FLEET, """SELECT dataset_id, 'A4' AS rule, reason = '' AS passed, reason, n AS n_rows, p AS n_features FROM (
  SELECT *, concat_ws('; ', CASE WHEN n < 600 THEN 'N=' || n || ' < 600' END, CASE WHEN p < 5 THEN 'P=' || p || ' < 5' END) AS reason FROM (
  SELECT dataset_id, count(*) AS n, max(len(num) + len(txt)) AS p FROM samples GROUP BY 1))"""))
def p4(spark, sf):
    return A.a4_data(fleet(spark, sf), 600, 5)


UNKNOWN = {**FLEET, "uniq": "SELECT dataset_id, count(DISTINCT coalesce(y_str, y_num::VARCHAR)) AS u FROM samples GROUP BY 1"}


@query("p18_derive_task", with_ctes(UNKNOWN, """SELECT dataset_id, 'A1' AS rule, u > 1 AS passed,
  CASE WHEN u > 1 THEN '' ELSE 'target has only ' || u || ' unique values' END AS reason,
  CASE WHEN u > 1 THEN CASE WHEN u <= 50 THEN 'classification' ELSE 'regression' END END AS inferred_task FROM uniq"""))
def p18(spark, sf):
    f = fleet(spark, sf)
    f.datasets = f.datasets.withColumn("task_type", F.lit("unknown"))
    return A.a1_target(f)


@query("f0c_gate_without_signal", with_ctes(FLEET, """SELECT dataset_id, rule, passed, reason FROM (
  SELECT dataset_id, 'A2' AS rule, TRUE AS passed, '' AS reason FROM datasets UNION ALL
  SELECT dataset_id, 'A4', reason = '', reason FROM (
    SELECT dataset_id, concat_ws('; ', CASE WHEN n < 600 THEN 'N=' || n || ' < 600' END, CASE WHEN p < 5 THEN 'P=' || p || ' < 5' END) AS reason FROM (
    SELECT dataset_id, count(*) AS n, max(len(num) + len(txt)) AS p FROM samples GROUP BY 1)))"""))
def f0c(spark, sf):
    return A.gate(fleet(spark, sf), None, 600, 5)
