"""Target building, alignment and reshaping over whole driver tables."""
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.stats import r6 as R
from fleetsieve.functions.text import char_fingerprint, file_safe, short_title, to_number
from fleetsieve.functions.sampling import sample_n
from fleetsieve.sources import annotations as A
from fleetsieve.sources import cohorts as K
from fleetsieve.sources import matrices as X
from fleetsieve.workload.candidates import any_of, sql_list
from fleetsieve.workload.fixture import read
from fleetsieve.workload.registry import query
from fleetsieve.workload.sql import r6, with_ctes

# Annotated studies: orders are samples, 25 studies by customer.
LINES = ["'Disease Status: ' || o_orderstatus", "' patient id:' || o_custkey", "'Grade : ' || substr(o_orderpriority, 1, 1)",
         "'no key here'", "'grade: again'"]


def study_lines(spark, sf):
    o = read(spark, sf, "orders")
    s = lambda x: F.lit(x)
    lines = F.array(F.concat(s("Disease Status: "), "o_orderstatus"), F.concat(s(" patient id:"), F.col("o_custkey").cast("string")),
                    F.concat(s("Grade : "), F.substring("o_orderpriority", 1, 1)), s("no key here"), s("grade: again"))
    return o.select(F.concat(s("GSE"), (F.col("o_custkey") % 25).cast("string")).alias("study"),
                    F.col("o_orderkey").alias("sample"), F.col("o_orderkey").alias("sample_pos"),
                    F.posexplode(lines).alias("line_pos", "line"))


def study_texts(spark, sf):
    o = read(spark, sf, "orders")
    p, even = F.substring("o_orderpriority", 1, 1), F.col("o_custkey") % 2 == 0
    word = F.when(p == "1", "Primary tumor").when((p == "5") & even, "adjacent normal").otherwise("blood")
    return o.select(F.concat(F.lit("GSE"), (F.col("o_custkey") % 25).cast("string")).alias("study"),
                    F.col("o_orderkey").alias("sample"), F.col("o_orderkey").alias("sample_pos"),
                    F.when((F.col("o_custkey") % 25) % 2 == 0, word).otherwise("blood").alias("text"))


ANN = {
    "lines": f"SELECT 'GSE' || (o_custkey % 25) AS study, o_orderkey AS sample, unnest([{', '.join(LINES)}]) AS line, "
             "unnest(range(5)) AS line_pos FROM orders",
    "attrs": """SELECT study, sample, line_pos, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value
FROM lines WHERE contains(line, ':')""",
    "texts": """SELECT 'GSE' || (o_custkey % 25) AS study, o_orderkey AS sample, CASE WHEN (o_custkey % 25) % 2 = 0 THEN
  CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'Primary tumor' WHEN substr(o_orderpriority, 1, 1) = '5' AND o_custkey % 2 = 0
  THEN 'adjacent normal' ELSE 'blood' END ELSE 'blood' END AS text FROM orders""",
    "firsts": "SELECT study, sample, key, arg_min(value, line_pos) AS value FROM attrs GROUP BY 1, 2, 3",
    "keyed": f"""SELECT study, key, count(*) FILTER (value <> '') AS n_unique, min((s, l)) AS seen,
  CASE WHEN count(*) FILTER (value <> '') BETWEEN 2 AND 50 THEN count(*) FILTER (value <> '')
  * (min(n) FILTER (value <> '') / (max(n) FILTER (value <> ''))::DOUBLE)
  * (sum(n) FILTER (value <> '') / sum(n)::DOUBLE) * CASE WHEN {any_of('key', V.PHENOTYPE_WORDS)} THEN 2.0::DOUBLE ELSE 1.0 END
  * CASE WHEN {any_of('key', V.TECHNICAL_WORDS)} THEN 0.1::DOUBLE ELSE 1.0 END ELSE 0 END AS score
FROM (SELECT study, key, value, count(*) AS n, min(sample) AS s, arg_min(line_pos, sample) AS l FROM attrs GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "best": """SELECT study, key AS target FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY score DESC, seen) AS rn
FROM keyed WHERE score > 0) WHERE rn = 1""",
    "both_kinds": f"""SELECT study FROM texts GROUP BY 1 HAVING bool_or(regexp_matches(text, '{V.TUMOR_PATTERN}'))
  AND bool_or(regexp_matches(text, '{V.NORMAL_PATTERN}'))""",
    "labelled": f"""SELECT t.study, t.sample, CASE WHEN b.study IS NOT NULL AND regexp_matches(text, '{V.TUMOR_PATTERN}') THEN 'tumor'
  WHEN b.study IS NOT NULL AND regexp_matches(text, '{V.NORMAL_PATTERN}') THEN 'normal' ELSE nullif(f.value, '') END AS label
FROM texts t LEFT JOIN both_kinds b USING (study) LEFT JOIN best USING (study)
LEFT JOIN firsts f ON f.study = t.study AND f.sample = t.sample AND f.key = best.target""",
}


def ann(final, extra=None):
    return with_ctes({**ANN, **(extra or {})}, final)


@query("f4_first_values", ann("SELECT study, sample, key, value FROM firsts"))
def f4(spark, sf):
    return A.first_values(A.attributes(study_lines(spark, sf)))


@query("g7_score_characteristic", ann(f"SELECT study, key, n_unique, {r6('score')} AS score FROM keyed"))
def g7(spark, sf):
    s = A.score_characteristics(A.attributes(study_lines(spark, sf)))
    return s.select("study", "key", "n_unique", R(F.col("score")).alias("score"))


@query("g8_best_target", ann("SELECT * FROM best"))
def g8(spark, sf):
    return A.best_target(A.score_characteristics(A.attributes(study_lines(spark, sf))))


@query("g10_label_tumor_normal", ann("SELECT * FROM labelled WHERE label IS NOT NULL"))
def g10(spark, sf):
    attrs = A.attributes(study_lines(spark, sf))
    return A.sample_labels(study_texts(spark, sf), attrs, A.best_target(A.score_characteristics(attrs)))


@query("g19_study_summary", ann("""SELECT study, platform, n_features, len(classes)::INT AS n_classes, array_to_string(classes[1:20], ', ') AS class_labels FROM (
  SELECT s.study, CASE WHEN b.study IS NOT NULL THEN ['normal', 'tumor'] ELSE l.found END AS classes, p.platform, p.n_features
  FROM (SELECT DISTINCT study FROM texts) s LEFT JOIN both_kinds b USING (study)
  LEFT JOIN (SELECT a.study, list_sort(list(DISTINCT a.value)) AS found FROM attrs a JOIN best ON best.study = a.study AND best.target = a.key
    WHERE a.value <> '' GROUP BY 1 HAVING count(DISTINCT a.value) BETWEEN 2 AND 50) l USING (study)
  LEFT JOIN (SELECT study, arg_min(platform, pos) AS platform, arg_min(n, pos) AS n_features FROM (
    SELECT 'GSE' || (c_custkey % 25) AS study, c_nationkey AS pos, 'GPL' || c_nationkey AS platform, count(*) AS n FROM customer GROUP BY 1, 2, 3)
    GROUP BY 1) p USING (study)) WHERE classes IS NOT NULL"""))
def g19(spark, sf):
    k = F.col("c_custkey") % 25
    platforms = read(spark, sf, "customer").groupBy(
        F.concat(F.lit("GSE"), k.cast("string")).alias("study"), F.col("c_nationkey").alias("pos"),
        F.concat(F.lit("GPL"), F.col("c_nationkey").cast("string")).alias("platform")).agg(F.count("*").alias("n_probes"))
    return A.study_summary(study_texts(spark, sf), A.attributes(study_lines(spark, sf)), platforms)


FIELDS = """SELECT event_type AS dataset_id, event_id AS sample, unnest(['collection date', 'biome', 'depth', 'region']) AS key,
  unnest([ts::VARCHAR, CASE WHEN user_id % 10 < 9 THEN ' Gut' || (user_id % 40) ELSE '' END, 'D' || (user_id % 7), 'R' || (user_id % 3)]) AS value FROM events"""


@query("g9_auto_target_field", with_ctes({
    "f": FIELDS, "u": f"SELECT dataset_id, sample, key, lower(trim(value)) AS label FROM f WHERE NOT {any_of('lower(key)', V.SKIPPED_FIELD_WORDS)} AND value <> ''",
    "g": "SELECT dataset_id, key, label FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 30",
    "c": "SELECT dataset_id, min(key) AS key FROM (SELECT dataset_id, key FROM g GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 10) GROUP BY 1"},
    "SELECT u.dataset_id, u.sample, u.key AS field, u.label FROM u JOIN c USING (dataset_id, key) JOIN g USING (dataset_id, key, label)"))
def g9(spark, sf):
    u = F.col("user_id")
    pairs = F.array(
        F.struct(F.lit("collection date").alias("key"), F.col("ts").cast("string").alias("value")),
        F.struct(F.lit("biome").alias("key"), F.when(u % 10 < 9, F.concat(F.lit(" Gut"), (u % 40).cast("string"))).otherwise("").alias("value")),
        F.struct(F.lit("depth").alias("key"), F.concat(F.lit("D"), (u % 7).cast("string")).alias("value")),
        F.struct(F.lit("region").alias("key"), F.concat(F.lit("R"), (u % 3).cast("string")).alias("value")))
    attrs = read(spark, sf, "events").select(F.col("event_type").alias("dataset_id"), F.col("event_id").alias("sample"),
                                             F.explode(pairs).alias("p")).select("dataset_id", "sample", "p.*")
    return A.auto_target_field(attrs)


@query("j3_resolve_sample_ids", """SELECT r.study, r.ref, r.sample, lower(coalesce(b.batch, 'na')) AS batch FROM (
  SELECT study, ref, arg_max(sample, pos) AS sample FROM (SELECT *, unnest(['R' || l_partkey, CASE WHEN l_linenumber > 2 THEN 'A' || l_partkey END]) AS ref FROM a)
  WHERE ref IS NOT NULL GROUP BY 1, 2) r LEFT JOIN (SELECT study, sample, arg_max(CASE WHEN l_tax > 0.05 THEN l_returnflag ELSE 'na' END, pos) AS batch FROM a GROUP BY 1, 2) b
  USING (study, sample)""".replace("FROM a", "FROM (SELECT *, l_suppkey AS study, 'S' || (l_orderkey % 100) AS sample, (l_orderkey * 10 + l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS pos FROM lineitem WHERE l_discount > 0)"))
def j3(spark, sf):
    c = F.col
    a = read(spark, sf, "lineitem").select(
        c("l_suppkey").alias("study"),
        F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("a"), "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag").alias("pos"),
        F.when(c("l_discount") > 0, F.concat(F.lit("S"), (c("l_orderkey") % 100).cast("string"))).alias("sample"),
        F.concat(F.lit("R"), c("l_partkey").cast("string")).alias("run"),
        F.when(c("l_linenumber") > 2, F.concat(F.lit("A"), c("l_partkey").cast("string"))).alias("assembly"),
        F.when(c("l_tax") > 0.05, c("l_returnflag")).otherwise("").alias("instrument"))
    return A.resolve_sample_ids(a)


@query("io3_feature_major", """SELECT 'emb' AS file, 'e' || i AS feature, count(*) AS n, count(v) AS n_present, """ + r6("sum(v)") + """ AS total FROM (
  SELECT unnest(range(64)) AS i, vec_id, unnest(embedding) AS x, CASE WHEN vec_id % 9 <> 0 THEN round(x::DOUBLE, 4) END AS v FROM (
    SELECT vec_id, embedding FROM embeddings) ) GROUP BY 2""")
def io3(spark, sf):
    """A feature x sample text matrix made from the vectors, then read back in tall form."""
    e = read(spark, sf, "embeddings")
    cell = F.when(F.col("vec_id") % 9 != 0, F.format_string("%.4f", F.round(F.col("x").cast("double"), 4))).otherwise("n/a")
    rows = (e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("i", "vec_id", cell.alias("t"))
            .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("vec_id", "t"))).alias("r")))
    body = rows.select(F.lit("emb").alias("file"), (F.col("i") + 2).alias("line_pos"), F.concat(
        F.lit("e"), F.col("i").cast("string"), F.lit("\tsome text\t"), F.array_join(F.transform("r", lambda s: s["t"]), "\t")).alias("line"))
    head = rows.where("i = 0").select(F.lit("emb").alias("file"), F.lit(1).alias("line_pos"), F.concat(
        F.lit("id\tdescription\t"), F.array_join(F.transform("r", lambda s: F.concat(F.lit("s"), s["vec_id"].cast("string"))), "\t")).alias("line"))
    note = rows.where("i = 0").select(F.lit("emb").alias("file"), F.lit(0).alias("line_pos"), F.lit("!header note").alias("line"))
    tall = X.feature_major(body.unionByName(head).unionByName(note), comment="!")
    return tall.groupBy("file", "feature").agg(F.count("*").alias("n"), F.count("value").alias("n_present"), R(F.sum("value")).alias("total"))


@query("io4_stack_sample_files", """SELECT 'f' || l_suppkey AS file, 'g' || l_partkey AS feature, arg_max(l_quantity, pos) AS value,
  any_value(CASE l_suppkey % 3 WHEN 0 THEN 'tumor' WHEN 1 THEN 'normal' END) AS label FROM (
  SELECT *, (l_orderkey * 10 + l_linenumber, l_extendedprice, l_quantity) AS pos FROM lineitem)
WHERE l_suppkey % 3 < 2 AND l_partkey % 17 <> 0 AND l_discount > 0 GROUP BY 1, 2""")
def io4(spark, sf):
    c = F.col
    text = lambda x: x.cast("string")
    li = read(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), text(c("l_suppkey"))).alias("file"),
        F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("a"), "l_extendedprice", "l_quantity").alias("line_pos"),
        F.concat_ws("\t", F.lit("x"), F.when(c("l_partkey") % 17 != 0, F.concat(F.lit("g"), text(c("l_partkey")))).otherwise(""),
                    F.when(c("l_discount") > 0, text(c("l_quantity"))).otherwise("NA")).alias("line"))
    supp = read(spark, sf, "supplier")
    first = lambda n: F.struct(F.lit(n).cast("bigint").alias("a"), F.lit(0.0).alias("l_extendedprice"), F.lit(0.0).alias("l_quantity"))
    name = F.concat(F.lit("f"), text(c("s_suppkey"))).alias("file")
    heads = supp.select(name, first(-1).alias("line_pos"), F.lit("other\tgene_name\tunstranded").alias("line"))
    notes = supp.select(name, first(-2).alias("line_pos"), F.lit("# made for a test").alias("line"))
    labels = supp.select(name, F.when(c("s_suppkey") % 3 == 0, "tumor").when(c("s_suppkey") % 3 == 1, "normal").alias("label"))
    return X.stack_sample_files(li.unionByName(heads).unionByName(notes), labels, "gene_name", "unstranded")


PROBES = "SELECT l_linestatus AS study, l_suppkey AS sample, l_partkey AS probe, min(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3"


@query("io5_align_to_first", with_ctes({"p": PROBES, "f": "SELECT study, min(sample) AS sample FROM p GROUP BY 1"},
    """SELECT g.study, g.sample, g.probe, p.value FROM (SELECT s.study, s.sample, l.probe FROM (SELECT DISTINCT study, sample FROM p) s
  JOIN (SELECT study, probe FROM p JOIN f USING (study, sample)) l USING (study)) g LEFT JOIN p USING (study, sample, probe)"""))
def io5(spark, sf):
    probes = read(spark, sf, "lineitem").groupBy(
        F.col("l_linestatus").alias("study"), F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("probe")
    ).agg(F.min("l_extendedprice").alias("value")).withColumn("sample_pos", F.col("sample"))
    return X.align_to_first(probes)


@query("j1_align", """WITH j AS (SELECT source AS dataset_id, doc_id AS sample, n_chars, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 0) SELECT * FROM j WHERE dataset_id IN (SELECT dataset_id FROM j GROUP BY 1 HAVING count(*) >= 10)""")
def j1(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("sample"), "n_chars")
    label = F.when(F.col("toxic") == 0, F.when(F.col("quality") == 1, "good").otherwise("bad"))
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("sample"), label.alias("label"))
    labels = labels.join(docs.select("dataset_id", "sample"), "sample")
    return X.align(docs, labels, 10)


@query("j2_attach_attributes", f"""SELECT o_orderkey AS file, o_custkey AS "case", {r6('o_totalprice')} AS x, {r6('c_acctbal')} AS y, c_mktsegment AS seg
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 5 <> 0""")
def j2(spark, sf):
    o = read(spark, sf, "orders")
    samples = o.select(F.col("o_orderkey").alias("file"), F.array("o_totalprice").alias("num"), F.array().cast("array<string>").alias("txt"))
    case_of = o.select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("case"))
    attrs = read(spark, sf, "customer").where("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("case"), F.col("c_acctbal").alias("clinical_age"), F.col("c_mktsegment").alias("clinical_stage"))
    out = X.attach_attributes(samples, case_of, attrs, ["clinical_age"], ["clinical_stage"])
    return out.select("file", "case", R(F.col("num")[0]).alias("x"), R(F.col("num")[1]).alias("y"), F.col("txt")[0].alias("seg"))


@query("j4_dedupe_keep_first", """SELECT c_custkey AS sample, c_acctbal, o_orderkey AS pos, o_orderstatus FROM (
  SELECT o_custkey, min(o_orderkey) AS pos, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) t
JOIN customer ON c_custkey = o_custkey JOIN (SELECT o_orderkey FROM orders) k ON k.o_orderkey = t.pos""")
def j4(spark, sf):
    meta = read(spark, sf, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("pos"), "o_orderstatus")
    x = read(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), "c_acctbal")
    return x.join(X.dedupe_keep_first(meta), "sample")


CONDITION = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ' Control' WHEN '2' THEN 'IBD' WHEN '3' THEN 'T2D ' WHEN '4' THEN 'FMT' ELSE 'rare' || (o_custkey % 500) END"
CC = {
    "known": f"SELECT o_orderkey AS sample, o_custkey % 40 AS study, lower(trim({CONDITION})) AS label FROM orders",
    "cases": "SELECT * FROM known WHERE label NOT IN ('control', 'fmt')",
    "ctl": "SELECT DISTINCT k.sample, k.study, c.label FROM known k JOIN cases c USING (study) WHERE k.label = 'control'",
    "sides": "SELECT sample, study, label, 'disease' AS side FROM cases UNION ALL SELECT sample, study, label, 'healthy' FROM ctl",
    "enough": """SELECT label, count(*) FILTER (side = 'disease') AS n_cases, count(*) FILTER (side = 'healthy') AS n_controls FROM sides GROUP BY 1
HAVING count(*) FILTER (side = 'disease') >= 50 AND count(*) FILTER (side = 'healthy') >= 50""",
}


def cohort(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    condition = (F.when(p == "1", " Control").when(p == "2", "IBD").when(p == "3", "T2D ").when(p == "4", "FMT")
                 .otherwise(F.concat(F.lit("rare"), (F.col("o_custkey") % 500).cast("string"))))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 40).alias("study"),
                                            condition.alias("condition"))


@query("j5_case_control", with_ctes(CC, "SELECT label, sample, study, side, n_cases, n_controls FROM sides JOIN enough USING (label)"))
def j5(spark, sf):
    return K.case_control(cohort(spark, sf)).drop("n_each")


@query("f12_balanced_downsample", with_ctes(CC, """SELECT label, sample, side FROM (SELECT *, least(n_cases, n_controls) AS k,
  row_number() OVER (PARTITION BY label, side ORDER BY md5('0|' || sample), sample) AS rn FROM sides JOIN enough USING (label)) WHERE rn <= k"""))
def f12(spark, sf):
    return K.balanced(K.case_control(cohort(spark, sf))).select("label", "sample", "side")


@query("f6_sample_n", """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS rn
FROM events) WHERE rn <= 500""")
def f6(spark, sf):
    return sample_n(read(spark, sf, "events"), ["event_type"], 500, "42", "event_id", salts=4).select("event_type", "event_id")


MARKERS = """SELECT 'm' || l_partkey AS feature, l_orderkey AS sample, CASE WHEN l_partkey % 11 = 0 THEN l_shipmode ELSE v END AS value FROM (
  SELECT l_partkey, l_orderkey, l_linestatus AS l_shipmode, CASE WHEN max(l_quantity) > (l_partkey % 60) THEN '1' ELSE '0' END AS v FROM lineitem GROUP BY 1, 2, 3)"""


@query("g11_prevalence_filter", f"""SELECT feature, count(*) AS n, count(*) FILTER (value = '1') AS ones FROM ({MARKERS}) GROUP BY 1
HAVING count(*) FILTER (value IN ('0', '1')) = count(*) AND count(*) FILTER (value = '1') >= count(*) * 0.1""")
def g11(spark, sf):
    c = F.col
    g = read(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linestatus").agg(F.max("l_quantity").alias("q"))
    value = F.when(c("l_partkey") % 11 == 0, c("l_linestatus")).when(c("q") > c("l_partkey") % 60, "1").otherwise("0")
    markers = g.select(F.concat(F.lit("m"), c("l_partkey").cast("string")).alias("feature"), c("l_orderkey").alias("sample"), value.alias("value"))
    return K.prevalent_markers(markers).select("feature", "n", "ones")


CODES = "CASE o_orderstatus WHEN 'F' THEN 'n' ELSE substr(o_orderpriority, 1, 1) END"


@query("g12_one_vs_healthy", with_ctes({"k": f"SELECT o_orderkey AS sample, {CODES} AS disease FROM orders",
                                        "e": "SELECT disease FROM k WHERE disease <> 'n' GROUP BY 1 HAVING count(*) >= 50"},
    "SELECT sample, disease, 'disease' AS label FROM k JOIN e USING (disease) UNION ALL SELECT k.sample, e.disease, 'healthy' FROM k, e WHERE k.disease = 'n'"))
def g12(spark, sf):
    code = F.when(F.col("o_orderstatus") == "F", "n").otherwise(F.substring("o_orderpriority", 1, 1))
    return K.one_vs_healthy(read(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), code.alias("disease")))


@query("g13_collapse_replicates", f"SELECT 'm' || l_partkey AS smiles, {r6('median(l_extendedprice)')} AS pchembl FROM lineitem WHERE l_tax > 0 AND l_partkey % 19 <> 0 GROUP BY 1")
def g13(spark, sf):
    c = F.col
    m = read(spark, sf, "lineitem").select(
        F.when(c("l_partkey") % 19 != 0, F.concat(F.lit("m"), c("l_partkey").cast("string"))).alias("smiles"),
        F.when(c("l_tax") > 0, c("l_extendedprice")).alias("pchembl"))
    return K.collapse_replicates(m, "smiles", "pchembl").select("smiles", R(F.col("pchembl")).alias("pchembl"))


@query("g14_trait_datasets", """SELECT trait, sample, value FROM (SELECT o_orderkey AS sample, unnest(['age', 'BMI', 'ldl']) AS trait,
  unnest([CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, o_custkey::DOUBLE, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END]) AS value FROM orders)
WHERE value IS NOT NULL""")
def g14(spark, sf):
    c = F.col
    meta = read(spark, sf, "orders").select(
        c("o_orderkey").alias("sample"), F.when(c("o_orderkey") % 3 != 0, c("o_totalprice")).alias("age"),
        c("o_custkey").alias("BMI"), F.when(c("o_orderstatus") == "P", c("o_totalprice")).alias("ldl"))
    return K.trait_datasets(meta)


GRAMS = "list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))"


@query("m15_hashed_fingerprint", f"""SELECT doc_id, len(b)::INT AS n_bits, list_sum(b)::BIGINT AS bit_sum FROM (SELECT doc_id,
  list_distinct(list_transform({GRAMS}, lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % 2048)) AS b FROM (SELECT doc_id, string_split(text, '') AS c FROM documents))""")
def m15(spark, sf):
    bits = char_fingerprint(F.col("text"), V.FINGERPRINT_BITS)
    return read(spark, sf, "documents").select("doc_id", bits.alias("b")).select(
        "doc_id", F.size("b").alias("n_bits"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum"))


@query("f1_numeric_coercion", f"""SELECT o_orderkey, {r6('try_cast(t AS DOUBLE)')} AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority
  WHEN o_orderkey % 4 = 1 THEN ' ' || o_totalprice || ' ' WHEN o_orderkey % 4 = 2 THEN o_custkey || 'd' ELSE o_custkey || 'e1' END AS t FROM orders)""")
def f1(spark, sf):
    k, s = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    t = (F.when(k % 4 == 0, F.col("o_orderpriority")).when(k % 4 == 1, F.concat(F.lit(" "), s("o_totalprice"), F.lit(" ")))
         .when(k % 4 == 2, F.concat(s("o_custkey"), F.lit("d"))).otherwise(F.concat(s("o_custkey"), F.lit("e1"))))
    return read(spark, sf, "orders").select("o_orderkey", R(to_number(t)).alias("v"))


@query("f2_source_transform", f"""SELECT c_custkey, {r6("CASE c_nationkey % 3 WHEN 0 THEN ln(1 + greatest(c_acctbal, 0)) WHEN 1 THEN ln(1 + abs(c_acctbal)) ELSE c_acctbal END")} AS x FROM customer""")
def f2(spark, sf):
    k = F.col("c_nationkey") % 3
    source = F.when(k == 0, "geo_rnaseq").when(k == 1, "mgnify").otherwise("openml")
    num = F.array(F.when(k == 1, F.abs("c_acctbal")).otherwise(F.col("c_acctbal")))
    x = X.transformed(num, F.coalesce(X.source_transform(source, V.TRANSFORMS), F.lit("none")))
    return read(spark, sf, "customer").select("c_custkey", R(x[0]).alias("x"))


@query("f7_f10_titles_and_ids", """SELECT doc_id, substr(text, 1, 80) AS title, regexp_replace(source || ':' || lang || '/' || doc_id, '[^a-zA-Z0-9_.-]', '_', 'g') AS file_id FROM documents""")
def f7(spark, sf):
    return read(spark, sf, "documents").select("doc_id", short_title(F.col("text")).alias("title"), file_safe(
        F.concat("source", F.lit(":"), "lang", F.lit("/"), F.col("doc_id").cast("string"))).alias("file_id"))


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf):
    return K.value_counts(read(spark, sf, "documents"), "lang")
