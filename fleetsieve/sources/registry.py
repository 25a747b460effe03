"""The source registry: every source as a pair of plans over its landed files, and their union.

``candidates`` lists what a source holds without reading cells; ``fleet`` assembles its datasets. Both
take the folder into which the source's files were landed (``<root>/<source>``); adding a source is
adding an entry to :data:`SOURCES`. Layouts:

======================  ==========================================================================
openml, uci, kaggle     ``catalog/`` (Parquet: dataset_id, name, n_samples, n_features, task_type,
                        licence, url, tags, description), ``<dataset>/X.*`` and ``y.*``
local                   ``<dataset>/X.*`` and, if known, ``y.*``
cmd                     ``profiles/`` (Parquet: sample and one column a taxon), ``metadata/`` (sample,
                        pos, study_name, study_condition and traits)
metagenomics            ``markers/`` (text lines ``name TAB value TAB value ...``, one named disease)
mgnify                  ``studies/``, ``tables/<study>.tsv`` (features x samples), ``analyses/``,
                        ``attributes/`` (study, sample, key, value)
tcga                    ``files/<file>.tsv``, ``hits/`` (file, project, data_type, case, sample_type),
                        ``clinical/`` (one row a case)
geo_array               ``values/`` (study, sample, sample_pos, probe, value), ``lines/``, ``samples/``
geo_rnaseq              ``info/<study>_info.json``, ``counts/`` (study, sample, gene, value),
                        ``metadata/`` (study, sample, key, value)
chembl                  ``activities/`` (target, name, smiles, pchembl)
plants                  ``matrices/<n>-<Species>_combined_output.tsv``, ``tissue/``, ``age/``
gp                      ``geno/<crop>_geno.csv``, ``pheno/<crop>_pheno.csv``
======================  ==========================================================================
"""
import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet
from fleetsieve.functions.text import bit_vector, char_fingerprint, clip_log1p, log1p, to_number
from fleetsieve.operators.metadata_rules import infer_domain
from fleetsieve.session import cut, written
from fleetsieve.sources import annotations as A
from fleetsieve.sources import assembly as Z
from fleetsieve.sources import catalogs as C
from fleetsieve.sources import cohorts as K
from fleetsieve.sources import matrices as X
from fleetsieve.sources import staged

log = logging.getLogger(__name__)

CANDIDATE = ("dataset_id string, source string, pos bigint, name string, n_samples int, n_features int, task_type string, "
             "licence string, url string, tags array<string>, domain string")
DATASET = ["dataset_id", "source", "pos", "name", "task_type", "domain", "url", "matrix"]
TIMING = "source string, phase string, seconds double, error string"


@dataclass(frozen=True)
class Source:
    """Two functions of (spark, folder)."""
    candidates: Callable[[SparkSession, str], DataFrame]
    fleet: Callable[[SparkSession, str], Fleet]


def _listed(df: DataFrame, source: str, licence: str, domain, order) -> DataFrame:
    """Candidate rows of a source; a catalog is small next to its data, so one task numbers it."""
    given = set(df.columns)
    fill = {"n_samples": F.lit(None), "n_features": F.lit(None), "licence": F.lit(licence), "url": F.lit(""),
            "tags": F.array().cast("array<string>"), "domain": domain if not isinstance(domain, str) else F.lit(domain)}
    for name, value in fill.items():
        if name not in given:
            df = df.withColumn(name, value)
    pos = F.row_number().over(Window.orderBy(*order)) - 1
    return df.withColumn("source", F.lit(source)).withColumn("pos", pos).select(
        *[F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in CANDIDATE.split(", "))])


def _datasets(df: DataFrame, source: str, domain: str, matrix) -> DataFrame:
    """Dataset rows from dataset_id, name, task_type."""
    pos = F.row_number().over(Window.orderBy("dataset_id")) - 1
    return df.select("dataset_id", F.lit(source).alias("source"), pos.cast("bigint").alias("pos"), "name", "task_type",
                     F.lit(domain).alias("domain"), F.lit("").alias("url"), matrix.alias("matrix"))


# ------------------------------------------------------------------ staged tables
def staged_fleet(spark, root, source, catalog=True) -> Fleet:
    fleet = staged.read_staged(spark, root, source)
    if not catalog:
        return fleet
    listed = spark.read.parquet(f"{root}/catalog").select("dataset_id", F.col("name").alias("title"), "tags", "description",
                                                          F.col("url").alias("link"))
    named = fleet.datasets.join(listed, "dataset_id", "left")
    fleet.datasets = named.select(
        "dataset_id", "source", "pos", F.coalesce("title", "name").alias("name"), "task_type",
        infer_domain(F.col("title"), F.coalesce("tags", F.array().cast("array<string>")), F.col("description")).alias("domain"),
        F.coalesce("link", F.lit("")).alias("url"))
    return fleet


def staged_candidates(spark, root, source, licence="", catalog=True) -> DataFrame:
    if catalog:
        listed = spark.read.parquet(f"{root}/catalog")
        domain = infer_domain(F.col("name"), F.coalesce("tags", F.array().cast("array<string>")), F.col("description"))
        return _listed(listed.withColumn("domain", domain), source, licence, "general", ["dataset_id"])
    fleet = staged.read_staged(spark, root, source)
    shape = fleet.samples.groupBy("dataset_id").agg(F.count("*").alias("n_samples"), F.max(F.size("num") + F.size("txt")).alias("n_features"))
    return _listed(fleet.datasets.join(shape, "dataset_id").select("dataset_id", "name", "task_type", "n_samples", "n_features"),
                   source, licence, "general", ["dataset_id"])


# ------------------------------------------------------------------ cohorts
def _cmd_tables(spark, root):
    wide = spark.read.parquet(f"{root}/profiles")
    taxa = [c for c in wide.columns if c != "sample"]
    rows = wide.select(F.lit("cmd").alias("matrix"), F.col("sample").cast("string").alias("sample"),
                       F.array(*[log1p(F.col(f"`{c}`").cast("double")) for c in taxa]).alias("num"))
    meta = X.dedupe_keep_first(spark.read.parquet(f"{root}/metadata").withColumn("sample", F.col("sample").cast("string")))
    return rows, taxa, written(meta.join(rows.select("sample"), "sample", "left_semi"), "metadata")


def _cmd_sides(meta):
    return K.case_control(meta.select("sample", F.col("study_name").alias("study"), F.col("study_condition").alias("condition")))


def cmd_candidates(spark, root) -> DataFrame:
    _, taxa, meta = _cmd_tables(spark, root)
    sides = _cmd_sides(meta).select("label", "n_each", "n_cases").distinct().select(
        F.concat(F.lit("cmd-"), "label").alias("dataset_id"), F.concat(F.lit("curatedMetagenomicData (healthy vs "), "label", F.lit(")")).alias("name"),
        (2 * F.col("n_each")).alias("n_samples"), F.lit("classification").alias("task_type"), F.lit(0).alias("kind"), (-F.col("n_cases")).alias("rank"))
    traits = K.trait_datasets(meta).groupBy("trait").agg(F.count("*").alias("n_samples")).select(
        F.concat(F.lit("cmd_reg-"), "trait").alias("dataset_id"), F.concat(F.lit("curatedMetagenomicData (predict "), "trait", F.lit(")")).alias("name"),
        "n_samples", F.lit("regression").alias("task_type"), F.lit(1).alias("kind"),
        F.array_position(F.array(*map(F.lit, V.TRAITS)), F.col("trait")).alias("rank"))
    return _listed(sides.unionByName(traits).withColumn("n_features", F.lit(len(taxa))), "cmd", "odbl-1.0", "biological", ["kind", "rank", "dataset_id"])


def cmd_fleet(spark, root) -> Fleet:
    rows, taxa, meta = _cmd_tables(spark, root)
    sides = K.balanced(_cmd_sides(meta), salts=16)
    labels = sides.select(F.concat(F.lit("cmd-"), "label").alias("dataset_id"), "sample", F.col("side").alias("y_str"), F.lit(None).cast("double").alias("y_num"))
    traits = K.trait_datasets(meta).select(F.concat(F.lit("cmd_reg-"), "trait").alias("dataset_id"), "sample",
                                           F.lit(None).cast("string").alias("y_str"), F.col("value").alias("y_num"))
    labels = written(labels.unionByName(traits), "labels")
    regression = F.col("dataset_id").startswith("cmd_reg-")
    named = labels.select("dataset_id").distinct().withColumn("task_type", F.when(regression, "regression").otherwise("classification")).withColumn("name", F.col("dataset_id"))
    features = spark.createDataFrame([("cmd", i, c) for i, c in enumerate(taxa)], "matrix string, feat_id int, feat string")
    return Z.build(_datasets(named, "cmd", "biological", F.lit("cmd")), rows, features, labels)


PIECE = 1 << 15  # values of a marker line that stay together


def _markers(spark, root):
    """(tall markers, labels) of a file whose lines are ``name TAB value ...``."""
    fields = X.text_lines(spark, f"{root}/markers").select(F.split("line", "\t").alias("f"))
    # lines are few and long: they are parsed once and dealt out in pieces
    pieces = fields.select(F.col("f")[0].alias("feature"), "f", F.explode(F.sequence(F.lit(0), F.size("f") - 1, F.lit(PIECE))).alias("start"))
    pieces = pieces.select("feature", "start", F.slice("f", F.col("start") + 2, F.lit(PIECE)).alias("part"))
    pieces = written(pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "feature", "start"), "pieces")
    tall = pieces.select("feature", "start", F.posexplode("part").alias("at", "value"))
    tall = tall.select("feature", (F.col("start") + F.col("at")).cast("string").alias("sample"), "value")
    ill = tall.where("feature = 'disease'").select("sample", F.col("value").alias("disease"))
    return tall.where("feature <> 'disease'"), ill


def metagenomics_candidates(spark, root) -> DataFrame:
    tall, ill = _markers(spark, root)
    width = K.prevalent_markers(tall).agg(F.count("*").alias("n_features"))
    known = ill.select(F.trim("disease").alias("disease"))
    healthy = known.agg(F.count_if(F.col("disease").isin(*V.HEALTHY_CODES)).alias("well"))
    sizes = known.where(~F.col("disease").isin(*V.HEALTHY_CODES)).groupBy("disease").agg(F.count("*").alias("n")).where(F.col("n") >= V.MIN_CASES)
    one = F.lit(1)
    rows = sizes.withColumn("k", one).join(healthy.withColumn("k", one), "k").join(width.withColumn("k", one), "k")  # one row each
    return _listed(rows.select(
        F.concat(F.lit("gut-"), "disease").alias("dataset_id"), F.concat(F.lit("Human gut markers (healthy vs "), "disease", F.lit(")")).alias("name"),
        (F.col("n") + F.col("well")).alias("n_samples"), "n_features", F.lit("classification").alias("task_type"), (-F.col("n")).alias("rank")),
        "metagenomics", "cc-by-4.0", "biological", ["rank", "dataset_id"])


def metagenomics_fleet(spark, root) -> Fleet:
    tall, ill = _markers(spark, root)
    kept = tall.join(written(K.prevalent_markers(tall).select("feature"), "prevalent"), "feature", "left_semi")
    rows, features = Z.gathered(kept.select(F.lit("gut").alias("matrix"), "sample", "feature", F.col("value").cast("double").alias("value")))
    labels = K.one_vs_healthy(ill).select(F.concat(F.lit("gut-"), "disease").alias("dataset_id"), "sample", F.col("label").alias("y_str"))
    named = labels.select("dataset_id").distinct().withColumn("name", F.col("dataset_id")).withColumn("task_type", F.lit("classification"))
    return Z.build(_datasets(named, "metagenomics", "biological", F.lit("gut")), rows, features, labels)


# ------------------------------------------------------------------ studies
def mgnify_candidates(spark, root) -> DataFrame:
    studies = spark.read.parquet(f"{root}/studies").where(F.col("n_samples") >= V.MGNIFY_MIN_SAMPLES)
    return _listed(studies.select(F.col("study").alias("dataset_id"), "name", "n_samples", F.lit("classification").alias("task_type")),
                   "mgnify", "public-domain", "biological", ["dataset_id"])


def mgnify_fleet(spark, root) -> Fleet:
    lines = X.text_lines(spark, f"{root}/tables").withColumn("file", F.regexp_extract("file", r"/tables/([^/]+?)\.tsv(?:/[^/]*)?$", 1))
    rows, features = Z.gathered(X.feature_major(lines).select(F.col("file").alias("matrix"), "sample", "feature", log1p(F.col("value")).alias("value")))
    rows = written(rows, "rows")
    refs = A.resolve_sample_ids(spark.read.parquet(f"{root}/analyses"))
    refs = refs.join(rows.select(F.col("matrix").alias("study"), F.col("sample").alias("ref")), ["study", "ref"], "left_semi")
    attrs = spark.read.parquet(f"{root}/attributes").join(refs, ["study", "sample"]).select(
        F.col("study").alias("dataset_id"), F.col("ref").alias("sample"), "key", "value")
    labels = A.auto_target_field(attrs).select("dataset_id", "sample", F.col("label").alias("y_str"))
    batch = refs.select(F.col("study").alias("dataset_id"), F.col("ref").alias("sample"), "batch")
    labels = cut(labels.join(batch, ["dataset_id", "sample"], "left"))
    named = labels.select("dataset_id").distinct().withColumn("name", F.col("dataset_id")).withColumn("task_type", F.lit("classification"))
    return Z.build(_datasets(named, "mgnify", "biological", F.col("dataset_id")), rows, features, labels)


CLINICAL_NUMBERS, CLINICAL_TEXTS = ["clinical_age"], ["clinical_vital_status", "clinical_gender", "clinical_stage"]


def _project(project="project", data_type="data_type"):
    return F.concat(F.lit("tcga-"), project, F.lit("-"), F.replace(F.col(data_type), F.lit(" "), F.lit("-")))


def tcga_candidates(spark, root) -> DataFrame:
    hits = spark.read.parquet(f"{root}/hits").withColumn("dataset_id", _project())
    sizes = hits.groupBy("dataset_id").agg(F.count_distinct("case").alias("n_samples")).where(F.col("n_samples") >= V.TCGA_MIN_CASES)
    return _listed(sizes.select("dataset_id", F.col("dataset_id").alias("name"), "n_samples", F.lit("classification").alias("task_type")),
                   "tcga", "public", "biomedical", ["dataset_id"])


def tcga_fleet(spark, root, feature_col="gene_name", value_col="unstranded") -> Fleet:
    hits = spark.read.parquet(f"{root}/hits").withColumn("matrix", _project())
    lines = X.text_lines(spark, f"{root}/files").withColumn(
        "file", F.regexp_extract("file", r"/files/(?:file=)?([^/]+?)(?:\.tsv)?(?:/[^/]*)?$", 1))
    stacked = X.stack_sample_files(lines, hits.select("file", F.col("sample_type").alias("label")), feature_col, value_col)
    tall = written(stacked.join(hits.select("file", "matrix"), "file").select("matrix", F.col("file").alias("sample"), "feature", "value"), "cells")
    rows, features = Z.gathered(tall)
    rows = written(rows, "rows")
    clinical = spark.read.parquet(f"{root}/clinical")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    full = X.attach_attributes(rows.select(F.col("sample").alias("file"), "cells", "width", none("double").alias("num"), none("string").alias("txt")),
                               hits.select("file", "case"), clinical, CLINICAL_NUMBERS, CLINICAL_TEXTS, keep=("cells", "width"))
    rows = full.join(hits.select("file", "matrix"), "file").select("matrix", F.col("file").alias("sample"), "cells", "width", "num", "txt")
    width = features.groupBy("matrix").agg(F.count("*").alias("w"))
    more = F.array(*[F.struct(F.lit(c).alias("feat"), F.lit(c in CLINICAL_NUMBERS).alias("is_num")) for c in CLINICAL_NUMBERS + CLINICAL_TEXTS])
    added = width.select("matrix", "w", F.posexplode(more).alias("i", "f")).select("matrix", (F.col("w") + F.col("i")).cast("int").alias("feat_id"), "f.feat", "f.is_num")
    features = features.withColumn("is_num", F.lit(True)).unionByName(added)
    labels = hits.select(F.col("matrix").alias("dataset_id"), F.col("file").alias("sample"), F.nullif("sample_type", F.lit("")).alias("y_str"))
    named = features.select(F.col("matrix").alias("dataset_id")).distinct().withColumn("name", F.col("dataset_id")).withColumn("task_type", F.lit("classification"))
    return Z.build(_datasets(named, "tcga", "biomedical", F.col("dataset_id")), rows, features, labels)


def _geo_labels(spark, root):
    texts = spark.read.parquet(f"{root}/samples")
    attrs = A.attributes(spark.read.parquet(f"{root}/lines"))
    return texts, A.sample_labels(texts, attrs, A.best_target(A.score_characteristics(attrs)))


def geo_array_candidates(spark, root) -> DataFrame:
    texts, labels = _geo_labels(spark, root)
    sizes = texts.groupBy("study").agg(F.count("*").alias("n_samples")).join(labels.select("study").distinct(), "study", "left_semi")
    probes = spark.read.parquet(f"{root}/values").select("study", "probe").distinct().groupBy("study").agg(F.count("*").alias("n_features"))
    return _listed(sizes.where(F.col("n_samples") >= V.GEO_MIN_SAMPLES).join(probes, "study").select(
        F.concat(F.lit("GEO-"), "study").alias("dataset_id"), F.col("study").alias("name"), "n_samples", "n_features",
        F.lit("classification").alias("task_type")), "geo_array", "public-domain", "biological", ["dataset_id"])


def geo_array_fleet(spark, root, min_shared=10) -> Fleet:
    _, labels = _geo_labels(spark, root)
    probes = spark.read.parquet(f"{root}/values").withColumn("value", to_number(F.col("value")))
    aligned = X.align_to_first(probes).select(F.concat(F.lit("GEO-"), "study").alias("matrix"), F.col("sample").cast("string").alias("sample"),
                                              F.col("probe").cast("string").alias("feature"), "value")
    rows, features = Z.gathered(aligned)
    rows = written(rows, "rows")
    given = labels.select(F.concat(F.lit("GEO-"), "study").alias("dataset_id"), F.col("sample").cast("string").alias("sample"), "label")
    known = X.align(rows.select(F.col("matrix").alias("dataset_id"), "sample"), given, min_shared)
    labels = cut(known.select("dataset_id", "sample", F.col("label").alias("y_str")))
    named = labels.select("dataset_id").distinct().withColumn("name", F.col("dataset_id")).withColumn("task_type", F.lit("classification"))
    return Z.build(_datasets(named, "geo_array", "biological", F.col("dataset_id")), rows, features, labels)


def _rnaseq_studies(spark, root):
    info = C.read_study_json(spark, f"{root}/info").withColumn("task", C.pick_task(F.col("detected_tasks"))).where("task is not null")
    return info.select(F.concat(F.lit("GEO-"), "accession").alias("dataset_id"), F.col("accession").alias("name"), "n_samples",
                       F.col("n_genes").alias("n_features"), F.col("task.type").alias("task_type"), F.col("task.column").alias("target"))


def geo_rnaseq_candidates(spark, root) -> DataFrame:
    return _listed(_rnaseq_studies(spark, root).drop("target"), "geo_rnaseq", "public-domain", "biological", ["dataset_id"])


def geo_rnaseq_fleet(spark, root) -> Fleet:
    studies = cut(_rnaseq_studies(spark, root))
    counts = spark.read.parquet(f"{root}/counts").select(F.concat(F.lit("GEO-"), "study").alias("matrix"), F.col("sample").cast("string").alias("sample"),
                                                         F.col("gene").alias("feature"), clip_log1p(F.col("value").cast("double")).alias("value"))
    rows, features = Z.gathered(counts.join(studies.select(F.col("dataset_id").alias("matrix")), "matrix", "left_semi"))
    meta = spark.read.parquet(f"{root}/metadata").withColumn("dataset_id", F.concat(F.lit("GEO-"), "study")).join(
        studies.select("dataset_id", "task_type", "target"), "dataset_id").where(F.col("key") == F.col("target"))
    clf = F.col("task_type") == "classification"
    labels = meta.select("dataset_id", F.col("sample").cast("string").alias("sample"), F.when(clf, F.col("value")).alias("y_str"),
                         F.when(~clf, to_number(F.col("value"))).alias("y_num"))
    return Z.build(_datasets(studies.select("dataset_id", "name", "task_type"), "geo_rnaseq", "biological", F.col("dataset_id")), rows, features, labels)


# ------------------------------------------------------------------ molecules and plants
def chembl_candidates(spark, root) -> DataFrame:
    sizes = (spark.read.parquet(f"{root}/activities").where("pchembl is not null").groupBy("target")
             .agg(F.count("*").alias("n_samples"), F.min("name").alias("name")).where(F.col("n_samples") >= V.CHEMBL_MIN_MEASUREMENTS))
    return _listed(sizes.select(F.col("target").alias("dataset_id"), "name", "n_samples", F.lit(V.FINGERPRINT_BITS).alias("n_features"),
                                F.lit("regression").alias("task_type")), "chembl", "CC BY-SA 3.0", "chemical", ["dataset_id"])


def chembl_fleet(spark, root) -> Fleet:
    potency = K.collapse_replicates(spark.read.parquet(f"{root}/activities"), "smiles", "pchembl", by=["target"])
    hits = potency.select("smiles").distinct().withColumn("hits", char_fingerprint(F.col("smiles"), V.FINGERPRINT_BITS))
    rows = hits.select(F.lit("chembl").alias("matrix"), F.col("smiles").alias("sample"), bit_vector(F.col("hits"), V.FINGERPRINT_BITS).alias("num"))
    labels = potency.select(F.col("target").alias("dataset_id"), F.col("smiles").alias("sample"), F.col("pchembl").alias("y_num"))
    named = labels.select("dataset_id").distinct().withColumn("name", F.col("dataset_id")).withColumn("task_type", F.lit("regression"))
    features = spark.range(V.FINGERPRINT_BITS).select(F.lit("chembl").alias("matrix"), F.col("id").cast("int").alias("feat_id"),
                                                      F.concat(F.lit("fp_"), F.col("id").cast("string")).alias("feat"))
    return Z.build(_datasets(named, "chembl", "chemical", F.lit("chembl")), rows, features, labels)


def _plant_names(files: DataFrame) -> DataFrame:
    species, target, task = C.plant_study(F.col("file"))
    return files.select("file", species.alias("species"), target.alias("target"), task.alias("task_type")).where("species is not null").withColumn(
        "dataset_id", F.concat(F.lit("plants-"), "species", F.lit("-"), "target")).withColumn("name", F.concat(
            F.replace(F.col("species"), F.lit("_"), F.lit(" ")), F.lit(" ("), "target", F.lit(")")))


def plants_candidates(spark, root) -> DataFrame:
    files = C.file_listing(spark, f"{root}/matrices").select(F.regexp_extract("path", r"/matrices/([^/]+)", 1).alias("file")).distinct()
    return _listed(_plant_names(files).select("dataset_id", "name", "task_type"), "plants", "cc-by-4.0", "biological", ["dataset_id"])


def plants_fleet(spark, root) -> Fleet:
    lines = X.text_lines(spark, f"{root}/matrices").withColumn("file", F.regexp_extract("file", r"/matrices/([^/]+)", 1))
    rows, heads = Z.sample_major(lines, "\t")
    named = cut(_plant_names(heads.select("file")))
    rows = rows.select(F.col("file").alias("matrix"), "sample", F.transform("num", log1p).alias("num"))
    table = lambda kind: spark.read.option("header", "true").option("sep", "\t").csv(f"{root}/{kind}")
    tissue = table("tissue").select(F.col("experiment").alias("sample"), F.lit("tissue").alias("target"), F.col("category").alias("y_str"), F.lit(None).cast("double").alias("y_num"))
    age = table("age").select(F.col("experiment").alias("sample"), F.lit("age").alias("target"), F.lit(None).cast("string").alias("y_str"), to_number(F.col("time_in_days")).alias("y_num"))
    own = rows.select(F.col("matrix").alias("file"), "sample").join(named.select("file", "dataset_id", "target"), "file")
    labels = own.join(tissue.unionByName(age), ["target", "sample"]).select("dataset_id", "sample", "y_str", "y_num")
    datasets = _datasets(named, "plants", "biological", F.col("file"))
    return Z.build(datasets, rows, Z.named_features(heads.withColumnRenamed("file", "matrix")), labels)


def _crop_lines(spark, root, kind):
    return X.text_lines(spark, f"{root}/{kind}").withColumn("file", F.regexp_extract("file", rf"/{kind}/([^/]+?)_{kind}\.csv", 1))


def gp_candidates(spark, root) -> DataFrame:
    files = C.file_listing(spark, f"{root}/geno").select(F.regexp_extract("path", r"/geno/([^/]+)", 1).alias("file")).distinct()
    crop, trait = C.crop_study(F.col("file"))
    rows = files.select(crop.alias("crop"), trait.alias("trait")).where("trait is not null")
    return _listed(rows.select(F.concat(F.lit("gp-"), "crop", F.lit("-"), "trait").alias("dataset_id"), F.concat(
        "crop", F.lit(" genomic prediction ("), "trait", F.lit(")")).alias("name"), F.lit("regression").alias("task_type")), "gp", "cc0", "biological", ["dataset_id"])


def gp_fleet(spark, root) -> Fleet:
    rows, heads = Z.sample_major(_crop_lines(spark, root, "geno"), ",")
    traits, names = Z.sample_major(_crop_lines(spark, root, "pheno"), ",")
    wanted = F.create_map(*[F.lit(x) for kv in V.CROP_TRAITS.items() for x in kv])
    at = names.withColumn("trait", F.try_element_at(wanted, F.col("file"))).withColumn("at", F.array_position("names", F.col("trait")).cast("int")).where("at > 0")
    at = cut(at.select("file", "at", F.concat(F.lit("gp-"), "file", F.lit("-"), "trait").alias("dataset_id")))
    labels = traits.join(at, "file").select("dataset_id", "sample", F.try_element_at("num", F.col("at")).alias("y_num"))
    named = at.select("file", "dataset_id", F.col("dataset_id").alias("name"), F.lit("regression").alias("task_type"))
    return Z.build(_datasets(named, "gp", "biological", F.col("file")), rows.withColumnRenamed("file", "matrix"),
                   Z.named_features(heads.withColumnRenamed("file", "matrix")), labels)


SOURCES = {
    "openml": Source(partial(staged_candidates, source="openml"), partial(staged_fleet, source="openml")),
    "tcga": Source(tcga_candidates, tcga_fleet),
    "geo_array": Source(geo_array_candidates, geo_array_fleet),
    "geo_rnaseq": Source(geo_rnaseq_candidates, geo_rnaseq_fleet),
    "kaggle": Source(partial(staged_candidates, source="kaggle"), partial(staged_fleet, source="kaggle")),
    "uci": Source(partial(staged_candidates, source="uci", licence=V.UCI_DEFAULT_LICENCE), partial(staged_fleet, source="uci")),
    "local": Source(partial(staged_candidates, source="local", catalog=False), partial(staged_fleet, source="local", catalog=False)),
    "chembl": Source(chembl_candidates, chembl_fleet),
    "metagenomics": Source(metagenomics_candidates, metagenomics_fleet),
    "cmd": Source(cmd_candidates, cmd_fleet),
    "mgnify": Source(mgnify_candidates, mgnify_fleet),
    "plants": Source(plants_candidates, plants_fleet),
    "gp": Source(gp_candidates, gp_fleet),
}


@dataclass
class Listing:
    """Rows of all sources, and one row per source and phase with its wall time and error, if any."""
    candidates: DataFrame
    timings: DataFrame


def list_candidates(spark: SparkSession, root: str, sources=None, max_per_source: int | None = 50, registry=SOURCES) -> Listing:
    """What the sources below ``root`` hold, at most ``max_per_source`` accepted ones of each. An unknown
    source is skipped; one that cannot be listed is skipped with its error recorded."""
    out, timings = spark.createDataFrame([], CANDIDATE), []
    for name in sources or list(registry):
        if name not in registry:
            log.warning("unknown source: %s", name)
            continue
        start, error = time.perf_counter(), None
        try:
            rows = registry[name].candidates(spark, f"{root}/{name}")
            out = out.unionByName(cut(rows if max_per_source is None else C.limit_per_source(rows, max_per_source)))
        except Exception as e:  # one source must not end the run
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            log.warning("listing %s failed: %s", name, error)
        timings.append((name, "scrape", time.perf_counter() - start, error))
    return Listing(out, spark.createDataFrame(timings, TIMING))


@dataclass
class Fetched:
    fleet: Fleet | None
    timings: DataFrame


AT_ONCE = 4  # sources whose jobs are submitted side by side


def fetch(spark: SparkSession, root: str, candidates: DataFrame | None = None, registry=SOURCES) -> Fetched:
    """The fleet of some candidates over all their sources, or of everything that was landed. The tables of a source are written once;
    a source that fails is left out with its error. A few sources are fetched at once, as many of their jobs are too small
    for the cluster, so their times overlap."""
    names = set(registry) if candidates is None else {r["source"] for r in candidates.select("source").distinct().collect()}  # of the registry

    def one(name):
        start, part, error = time.perf_counter(), None, None
        try:
            fleet = registry[name].fleet(spark, f"{root}/{name}")
            if candidates is not None:
                fleet = fleet.only(candidates.where(F.col("source") == name))
            part = Fleet(*(written(t, name) for t in (fleet.datasets, fleet.features, fleet.samples)))
        except Exception as e:
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            log.warning("fetching %s failed: %s", name, error)
        return part, (name, "fetch", time.perf_counter() - start, error)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(one, [n for n in registry if n in names]))  # in the registry's order
    parts, timings = [part for part, _ in done if part is not None], [timing for _, timing in done]
    return Fetched(Z.union(parts) if parts else None, spark.createDataFrame(timings, TIMING))
