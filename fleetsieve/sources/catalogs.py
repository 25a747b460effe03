"""Catalog-level selection: which listed datasets are worth fetching, and what they hold."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.text import contains_any, strip
from fleetsieve.operators.metadata_rules import accept_metadata, normal_task, task_accepted


def domain_from_tags(tags: Column) -> Column:
    low = F.transform(tags, lambda t: F.lower(t))
    out = F.lit("general")
    for domain, words in reversed(V.TAG_DOMAINS):
        out = F.when(F.arrays_overlap(low, F.array(*map(F.lit, words))), domain).otherwise(out)
    return out


def looks_tabular(title: Column, field_names: Column) -> Column:
    """Flag: no image/text/time-series title and not mostly pixel-like column names."""
    n = F.size(field_names)
    pixels = F.size(F.filter(field_names, lambda f: f.rlike(V.PIXEL_NAME_PATTERN)))
    return (~contains_any(F.lower(title), V.NOT_TABULAR_WORDS)
            & ((n == 0) | F.coalesce(F.try_divide(pixels, n) <= 0.5, F.lit(True))))


def pick_record_set(record_sets: Column) -> Column:
    """Non-empty field names of the record set with the most fields (first on ties).
    ``record_sets`` is ARRAY<STRUCT<field ARRAY<STRUCT<name>>>>."""
    width = lambda r: F.coalesce(F.nullif(F.size(r["field"]), F.lit(-1)), F.lit(0))
    widest = F.array_max(F.transform(record_sets, width))
    best = F.try_element_at(F.filter(record_sets, lambda r: width(r) == widest), F.lit(1))
    names = F.transform(F.coalesce(best["field"], F.array().cast("array<struct<name:string>>")),
                        lambda f: f["name"])
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def resolve_target(columns: Column, hint: Column, known=()) -> Column:
    """Column equal to the hint whatever its case (the last such), else the first of an
    optional list of usual names, else the last column."""
    last = lambda found: F.try_element_at(found, F.lit(-1))
    hinted = last(F.filter(columns, lambda c: F.lower(c) == F.lower(hint)))
    usual = [last(F.filter(columns, lambda c, k=k: F.lower(c) == k)) for k in known]
    return F.coalesce(hinted, *usual, F.try_element_at(columns, F.lit(-1)))


def discover_target(profile: DataFrame, names=V.TARGET_NAMES, max_unique: int = 10,
                    max_missing: float = 0.5) -> DataFrame:
    """The target column of each dataset from column profiles of its side files.

    Known names win, in CSV files before Parquet files; otherwise the CSV column with the
    fewest distinct values (at most ten, less than half missing). ``profile`` has
    dataset_id, file_pos, fmt, stem, col, col_pos, n, missing, nunique."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("col"))
    csv = F.col("fmt") == "csv"
    usable = csv & (F.col("nunique") <= max_unique) & (F.try_divide("missing", "n") < max_missing)
    key = (F.when((rank > 0) & csv, F.struct(F.lit(1).alias("s"), F.col("file_pos").alias("a"), rank.alias("b"),
                                             F.lit(0).alias("c")))
           .when(rank > 0, F.struct(F.lit(2).alias("s"), F.col("file_pos").alias("a"), rank.alias("b"),
                                    F.lit(0).alias("c")))
           .when(usable, F.struct(F.lit(3).alias("s"), F.col("nunique").cast("int").alias("a"),
                                  F.col("file_pos").cast("bigint").alias("b"), F.col("col_pos").alias("c"))))
    return (profile.where(F.col("stem") != "X").withColumn("key", key).where(F.col("key").isNotNull())
            .groupBy("dataset_id").agg(F.min_by(F.struct("stem", "fmt", "col"), "key").alias("t"))
            .select("dataset_id", "t.stem", "t.fmt", F.col("t.col").alias("target")))


def wide_profile(df: DataFrame) -> DataFrame:
    """col, col_pos, n, missing, nunique of a wide frame; distinct values are reduced per
    column in the map tasks before they are exchanged."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(i).alias("col_pos"),
                               F.col(f"`{c}`").cast("string").alias("v"))
                      for i, c in enumerate(df.columns)])
    tall = df.select(F.explode(pairs).alias("p")).select("p.*")
    values = tall.groupBy("col", "col_pos", "v").agg(F.count("*").alias("w"))
    return values.groupBy("col", "col_pos").agg(
        F.sum("w").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("w"))), F.lit(0)).alias("missing"),
        F.count("v").alias("nunique"))


def task_from_type(data_type: Column) -> Column:
    return F.when(data_type.isin("float", "double", "float32", "float64"), "regression").otherwise("classification")


def pick_task(tasks: Column) -> Column:
    """Classification task with the most labelled samples (first on ties), else the first
    regression task. ``tasks`` is ARRAY<STRUCT<type, column, classes MAP<STRING,BIGINT>>>."""
    total = lambda t: F.aggregate(F.coalesce(F.map_values(t["classes"]), F.array().cast("array<bigint>")),
                                  F.lit(0).cast("bigint"), lambda a, x: a + x)
    clf = F.filter(tasks, lambda t: t["type"] == "classification")
    most = F.array_max(F.transform(clf, total))
    best = F.try_element_at(F.filter(clf, lambda t: total(t) == most), F.lit(1))
    return F.coalesce(best, F.try_element_at(F.filter(tasks, lambda t: t["type"] == "regression"), F.lit(1)))


def first_accepted_task(tasks: DataFrame) -> DataFrame:
    """dataset_id, task_type of the first listed task, ``unknown`` when not accepted."""
    first = tasks.groupBy("dataset_id").agg(F.min_by("task_type", "pos").alias("t"))
    norm = F.replace(F.lower("t"), F.lit(" "), F.lit("_"))
    return first.select("dataset_id", F.when(task_accepted(norm), norm).otherwise("unknown").alias("task_type"))


def catalog_prefilter(catalog: DataFrame, min_rows=V.MIN_ROWS, min_features=V.MIN_FEATURES,
                      max_features: int | None = None, min_bytes=V.KAGGLE_MIN_BYTES, max_bytes: int | None = None,
                      min_cases=V.TCGA_MIN_CASES, min_series=V.GEO_MIN_SAMPLES, min_measurements=V.CHEMBL_MIN_MEASUREMENTS,
                      min_runs=V.MGNIFY_MIN_SAMPLES) -> DataFrame:
    """Cheap per-source filters, pushed into the catalog scan. Columns a source does not
    use are ignored for it. The licence default of one source is filled in. The maxima are for
    small machines; ``None`` sets none."""
    below = lambda column, most: F.lit(True) if most is None else F.col(column) <= most
    c = F.col
    size = (c("n_samples") >= min_rows) & (c("n_features") >= min_features)
    wide = (c("n_features") >= min_features) & below("n_features", max_features)
    keep = {
        "openml": size & (F.lower("format") != "sparse_arff"),
        "uci": c("data_url").isNotNull() & (c("data_url") != "") & size & wide,
        "kaggle": (c("bytes") >= min_bytes) & below("bytes", max_bytes) & wide,
        "geo_array": c("accession").startswith("GSE") & (c("n_samples") >= min_series)
                     & (c("n_features").isNull() | below("n_features", max_features)),
        "tcga": c("n_samples") >= min_cases,
        "chembl": c("n_samples") >= min_measurements,
        "mgnify": (c("n_samples") >= min_runs) & c("downloads").contains("IPR_abundances"),
    }
    passing = F.lit(True)
    for source, rule in keep.items():
        passing = F.when(c("source") == source, rule).otherwise(passing)
    licence = F.when((c("source") == "uci") & (c("licence").isNull() | (c("licence") == "")),
                     V.UCI_DEFAULT_LICENCE).otherwise(c("licence"))
    return catalog.where(F.coalesce(passing, F.lit(False))).withColumn("licence", licence)


def first_listing(listing: DataFrame, key: str = "accession") -> DataFrame:
    """One row per accession found by several searches: the earliest."""
    others = [c for c in listing.columns if c != key]
    return listing.groupBy(key).agg(F.min_by(F.struct(*others), "pos").alias("r")).select(key, "r.*")


def limit_per_source(candidates: DataFrame, most: int, scanned: int | None = None) -> DataFrame:
    """The first ``most`` passing candidates of each source; with ``scanned``, only the first
    that many listed ones are looked at."""
    order = Window.partitionBy("source").orderBy("pos")
    if scanned is not None:
        candidates = (candidates.withColumn("_rn", F.row_number().over(order))
                      .where(F.col("_rn") <= scanned).drop("_rn"))
    return (accept_metadata(candidates).withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") <= most).drop("_rn"))


def plant_study(file: Column):
    """(species, target, task) from ``<n>-<Species>_combined_output.tsv``; NULL otherwise."""
    species = F.when(file.contains("combined_output"),
                     F.replace(F.try_element_at(F.split(file, "-", 2), F.lit(2)),
                               F.lit("_combined_output.tsv"), F.lit("")))
    target = F.when(species.isin(V.AGE_SPECIES), "age").when(species.isNotNull(), "tissue")
    return species, target, F.when(target == "age", "regression").when(target == "tissue", "classification")


def crop_study(file: Column):
    """(crop, trait) from ``<crop>_geno.csv``; NULL otherwise."""
    crop = F.when(file.contains("_geno"), F.split(file, "_geno")[0])
    table = F.create_map(*[F.lit(x) for kv in V.CROP_TRAITS.items() for x in kv])
    return crop, F.try_element_at(table, crop)


def keep_field(key: Column, words=V.SKIPPED_FIELD_WORDS) -> Column:
    return ~contains_any(F.lower(key), words)


def pick_main_file(listing: DataFrame) -> DataFrame:
    """The largest csv / csv.gz / parquet file of each dataset (path breaks ties)."""
    data = F.col("path").rlike(r"\.(csv|csv\.gz|parquet)$")
    return (listing.where(data).groupBy("dataset_id")
            .agg(F.max_by(F.struct("path", "size"), F.struct("size", "path")).alias("f"))
            .select("dataset_id", "f.path", "f.size"))


def file_listing(spark, root: str) -> DataFrame:
    """path and size of every file below ``root``; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", F.col("length").alias("size")))


STUDY_SCHEMA = ("accession string, n_samples int, n_genes int, organism string, "
                "detected_tasks array<struct<type:string,column:string,classes:map<string,bigint>>>")


def read_study_json(spark, path: str) -> DataFrame:
    """Study descriptors, one JSON document per file."""
    return (spark.read.schema(STUDY_SCHEMA).option("multiLine", "true")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "*_info.json").json(path)
            .withColumn("accession", F.coalesce("accession", F.regexp_extract(
                F.col("_metadata.file_name"), r"(.*)_info\.json$", 1))))


def parse_study_json(text: Column) -> Column:
    return F.from_json(text, STUDY_SCHEMA)
