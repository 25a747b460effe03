"""Fixed values the results depend on. Every one is a parameter default elsewhere."""

# ---------------------------------------------------------------- fixed values
# Task types (rule A1)
ACCEPTED_TASKS = [
    "classification",
    "regression",
    "supervised_classification",
    "supervised_regression",
]
MAX_INFERRED_CLASSES = 50
MAX_SIGNAL_CLASSES = 20

# Synthetic-name pattern and sources that are real by definition (rule A2)
SYNTHETIC_PATTERN = (
    r"(?i)synthetic|artificial|generated|simulated|random|"
    r"toy|demo|dummy|mock|fake|bogus|"
    r"monte.?carlo|"
    r"make_(classification|regression|blobs|moons|circles|swiss_roll)"
)
REAL_SOURCE_PREFIXES = ["tcga", "geo"]

# Signal test (rule A3)
P_VALUE_THRESHOLD = 0.05
MIN_CLF_SCORE = 0.10
MIN_REG_SCORE = 0.05
MAX_CEILING = 0.999
N_PERMUTATIONS = 100
MIN_CLASS_SIZE = 20
MAX_HEAVY_FEATURES = 1000
CV_FOLDS = 3
GATE_TREES, GATE_DEPTH = 50, 5
REPORT_TREES, REPORT_DEPTH = 200, 20
REPORT_MAX_ROWS = 10_000
HOLDOUT_SHARE, HOLDOUT_FOLDS = 0.2, 5
HOLDOUT_TREES, HOLDOUT_DEPTH = 100, 10
HOLDOUT_PASS_CLF, HOLDOUT_PASS_REG = 0.55, 0.05
HOLDOUT_TOP_FEATURES = 15

# Dimensions (rule A4)
MIN_ROWS = 150
MIN_FEATURES = 1000
MAX_FEATURES = 250_000

# Licences (rule A5)
ALLOWED_LICENCES = [
    "cc0-1.0",
    "cc0",
    "public-domain",
    "cc-by-4.0",
    "cc-by-sa-4.0",
    "cc-by-sa-3.0",
    "mit",
    "apache-2.0",
    "bsd-2-clause",
    "bsd-3-clause",
    "odbl-1.0",
    "public",
]
RESTRICTIVE_PATTERN = r"\bnc\b|\bnd\b|non.commercial|no.deriv"

# Cross-dataset duplicates (rule A6)
OVERLAP_THRESHOLD = 0.3
NA_SENTINEL = -1e30

# Fleet quotas
MAX_SAVED = 200
MAX_SAVED_PER_SOURCE = 15

# Domain keywords
BIOMEDICAL_PATTERN = (
    r"(?i)cancer|tumou?r|carcinoma|leukemia|disease|patient|clinical|medical|"
    r"diagnos|hospital|drug|methylation|biopsy|genom|proteom|tcga"
)
BIOLOGICAL_PATTERN = (
    r"(?i)gene|protein|microarray|rna.?seq|organism|species|"
    r"phylogen|microbi|bacteri|virus|plant|"
    r"\bcell\b|\bdna\b|\brna\b"
)
TAG_DOMAINS = [
    ("biological", ["biology", "biological", "genomics", "botany", "ecology"]),
    ("biomedical", ["medical", "healthcare", "clinical"]),
    ("chemical", ["chemical", "chemistry"]),
    ("geoscience", ["geoscience", "geography"]),
]
NOT_TABULAR_WORDS = [
    "image", "audio", "pictures", "video", "text", "nlp", "language",
    "time series", "timeseries",
]
PIXEL_NAME_PATTERN = r"^(pixel[_-]?\d+|\d+)$"
TARGET_NAMES = ["target", "hospital_expire_flag", "mortality", "outcome", "y", "label"]

# Catalog pre-filters
KAGGLE_MIN_BYTES = 5_000_000
KAGGLE_MAX_BYTES = 2_000_000_000
GEO_MIN_SAMPLES = 500
TCGA_MIN_CASES = 500
CHEMBL_MIN_MEASUREMENTS = 2000
MGNIFY_MIN_SAMPLES = 150
UCI_DEFAULT_LICENCE = "CC By 4.0"

# Sample annotations to labels
TUMOR_PATTERN = (
    r"(?i)\b(tumor|tumour|cancer|carcinoma|malignant|primary|metastas"
    r"|adenocarcinoma|neoplasm|cancerous)\b"
)
NORMAL_PATTERN = (
    r"(?i)\b(normal|healthy|control|benign|adjacent|non.tumor|non.tumour"
    r"|non.cancerous|non.malignant)\b"
)
PHENOTYPE_WORDS = [
    "disease", "condition", "phenotype", "status", "type", "subtype",
    "stage", "grade", "class", "diagnosis", "outcome", "response",
    "treatment", "pathology", "clinical", "category", "group",
]
TECHNICAL_WORDS = [
    "age", "gender", "sex", "batch", "plate", "technician", "date",
    "passage", "lot", "replicate", "time.point", "timepoint", "time",
    "sample.id", "id", "name", "donor", "patient", "individual",
]
LABEL_MIN_CLASSES, LABEL_MAX_CLASSES = 2, 50
SKIPPED_FIELD_WORDS = ["date", "latitude", "longitude"]
FIELD_MIN_GROUP, FIELD_MAX_GROUPS = 30, 10

# Microbiome sources
HEALTHY_CONDITIONS = ["control"]
SKIPPED_CONDITIONS = ["fmt"]
MIN_CASES, MIN_CONTROLS = 50, 50
HEALTHY_CODES = ["n", "nd", "n_relative"]
MIN_PREVALENCE = 0.10
TRAITS = [
    "age", "BMI", "hba1c", "ldl", "hdl", "cholesterol", "triglycerides",
    "hscrp", "creatinine", "systolic_p", "dyastolic_p", "albumine",
    "gestational_age", "birth_weight",
]

# Plant sources
AGE_SPECIES = [
    "Arabidopsis_thaliana", "Zea_mays", "Oryza_sativa",
    "Triticum_aestivum", "Solanum_tuberosum", "Hordeum_vulgare",
]
CROP_TRAITS = {
    "rice": "FT", "maize": "FT", "soy": "YLD", "sorghum": "YLD",
    "spruce": "HT", "switchgrass": "HT",
}

FINGERPRINT_BITS = 2048

# Soft rules
FINGERPRINT_QUANTILES = [0.10, 0.25, 0.50, 0.75, 0.90]
QUALITY_WEIGHTS = {"c_miss": 0.35, "c_out": 0.30, "c_const": 0.25, "c_consist": 0.10}
PCA_COMPONENTS, ISOLATION_TREES, ISOLATION_SAMPLE = 40, 100, 256
REGRESSION_BINS = 10

# Weighting
RULES = ["S1", "S2", "S3", "S4", "S5", "S6"]
AHP_POINTS = {"S1": 10, "S2": 10, "S3": 15, "S4": 20, "S5": 5}
TOTAL_POINTS = 60
PASS_THRESHOLD = 0.6
DIVERGENCE_THRESHOLD = 3
AHP_SHARE = 0.6

# Hard-rule funnel
HARD_RULES = ["A1", "A2", "A3", "A4", "A5", "A6"]
HARD_RULE_NAMES = {
    "A1": "task type", "A2": "synthetic", "A3": "signal",
    "A4": "dimensions", "A5": "licence", "A6": "cross-dup",
}

# Per-source policy: rules skipped on metadata, rules skipped on data, duplicate-pool
# exemption, value transform.
SOURCES = [
    "openml", "tcga", "geo_array", "geo_rnaseq", "kaggle", "uci", "local",
    "chembl", "metagenomics", "cmd", "mgnify", "plants", "gp",
]
ALL_METADATA_RULES = ["A1", "A2", "A4", "A5"]
METADATA_SKIPS = {
    "tcga": ["A4"], "geo_rnaseq": ["A4"], "mgnify": ["A4"],
    "chembl": ALL_METADATA_RULES, "plants": ALL_METADATA_RULES, "gp": ALL_METADATA_RULES,
}
DATA_SKIPS = {"tcga": ["A4"], "geo_rnaseq": ["A4"], "mgnify": ["A4"]}
DUPLICATE_EXEMPT = ["chembl", "cmd"]
TRANSFORMS = {
    "geo_rnaseq": "clip_log1p", "mgnify": "log1p", "cmd": "log1p", "plants": "log1p",
}
