"""Rules on candidate metadata. Every rule is one expression giving
``struct(rule, passed, reason)`` or NULL when only the data can decide, so the whole
chain is a single projection over the candidate table: no shuffle, no join."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.functions.text import contains_any, strip


def _result(rule: str, passed, reason) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(rule).alias("rule"), lit(passed).alias("passed"),
                    lit(reason).cast("string").alias("reason"))


def normal_task(task: Column) -> Column:
    return strip(F.replace(F.lower(task), F.lit("-"), F.lit("_")))


def task_accepted(task: Column, accepted=V.ACCEPTED_TASKS) -> Column:
    return contains_any(normal_task(task), accepted)


def a1_task_type(task: Column, accepted=V.ACCEPTED_TASKS) -> Column:
    return (F.when(task_accepted(task, accepted), _result("A1", True, ""))
            .when(normal_task(task) == "unknown", F.lit(None))
            .otherwise(_result("A1", False,
                               F.concat(F.lit("task_type='"), task, F.lit("' not accepted")))))


def a2_synthetic(source: Column, name: Column, tags: Column,
                 pattern=V.SYNTHETIC_PATTERN, real=V.REAL_SOURCE_PREFIXES) -> Column:
    low = F.lower(source)
    is_real = F.lit(False)
    for prefix in real:
        is_real = is_real | low.startswith(prefix)
    hits = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.rlike(pattern))
    return (F.when(is_real, _result("A2", True, ""))
            .when(name.rlike(pattern), _result(
                "A2", False, F.concat(F.lit("name looks synthetic: '"), name, F.lit("'"))))
            .when(F.size(hits) > 0, _result(
                "A2", False, F.concat(F.lit("tag looks synthetic: '"), F.try_element_at(hits, F.lit(1)),
                                      F.lit("'"))))
            .otherwise(_result("A2", True, "")))


def dimension_reasons(n: Column, p: Column, min_rows, min_features) -> Column:
    return F.concat_ws(
        "; ",
        F.when(n < min_rows, F.concat(F.lit("N="), n.cast("string"), F.lit(f" < {min_rows}"))),
        F.when(p < min_features,
               F.concat(F.lit("P="), p.cast("string"), F.lit(f" < {min_features}"))))


def a4_dimensions(n: Column, p: Column, min_rows=V.MIN_ROWS,
                  min_features=V.MIN_FEATURES) -> Column:
    reasons = dimension_reasons(n, p, min_rows, min_features)
    return (F.when(reasons != "", _result("A4", False, reasons))
            .when(n.isNull() & p.isNull(), F.lit(None))
            .otherwise(_result("A4", True, "")))


def normal_licence(licence: Column) -> Column:
    return (F.when(licence.isNull() | (licence == ""), F.lit("unknown"))
            .otherwise(F.replace(F.lower(strip(licence)), F.lit(" "), F.lit("-"))))


def a5_licence(licence: Column, allowed=V.ALLOWED_LICENCES,
               restrictive=V.RESTRICTIVE_PATTERN) -> Column:
    norm = normal_licence(licence)
    return (F.when(norm == "unknown", _result("A5", True, "licence unknown, assuming open"))
            .when(norm.rlike(restrictive), _result(
                "A5", False, F.concat(F.lit("restrictive licence: '"), licence, F.lit("'"))))
            .when(contains_any(norm, allowed), _result("A5", True, ""))
            .otherwise(_result("A5", False, F.concat(F.lit("licence '"), licence,
                                                     F.lit("' not in allow-list")))))


def metadata_skips(source: Column, skips=V.METADATA_SKIPS) -> Column:
    """Rules a source is exempt from, as an array."""
    none = F.array().cast("array<string>")
    out = none
    for name, rules in skips.items():
        out = F.when(source == name, F.array(*map(F.lit, rules))).otherwise(out)
    return out


# Order in which the chain runs; adding a rule is adding one entry.
METADATA_CHAIN = {
    "A1": lambda p: a1_task_type(F.col("task_type"), p.get("accepted", V.ACCEPTED_TASKS)),
    "A2": lambda p: a2_synthetic(F.col("source"), F.col("name"), F.col("tags")),
    "A4": lambda p: a4_dimensions(F.col("n_samples"), F.col("n_features"),
                                  p.get("min_rows", V.MIN_ROWS),
                                  p.get("min_features", V.MIN_FEATURES)),
    "A5": lambda p: a5_licence(F.col("licence")),
}


def chain_results(skips: Column | None = None, chain=METADATA_CHAIN, **params) -> Column:
    """Array of results in order, deferred and skipped rules left out, cut after a failure."""
    skips = metadata_skips(F.col("source")) if skips is None else skips
    every = F.array(*[F.when(~F.array_contains(skips, name), build(params))
                      for name, build in chain.items()])
    ran = F.filter(every, lambda r: r.isNotNull())
    failed = F.filter(ran, lambda r: ~r["passed"])
    first = F.array_position(ran, F.try_element_at(failed, F.lit(1)))
    return F.when(F.size(failed) == 0, ran).otherwise(F.slice(ran, F.lit(1), first.cast("int")))


def run_metadata_rules(candidates: DataFrame, chain=METADATA_CHAIN, **params) -> DataFrame:
    """One row per rule that ran."""
    return (candidates.select("dataset_id", "source", "pos",
                              F.posexplode(chain_results(chain=chain, **params)).alias("step", "r"))
            .select("dataset_id", "source", "pos", "step", "r.rule", "r.passed", "r.reason"))


def accept_metadata(candidates: DataFrame, chain=METADATA_CHAIN, **params) -> DataFrame:
    """Candidates for which every rule that ran passed (a filter, nothing is shuffled)."""
    return candidates.where(F.forall(chain_results(chain=chain, **params), lambda r: r["passed"]))


def infer_domain(name: Column, tags: Column, description: Column) -> Column:
    blob = F.concat_ws(" ", F.coalesce(name, F.lit("")), tags, F.coalesce(description, F.lit("")))
    return (F.when(blob.rlike(V.BIOMEDICAL_PATTERN), "biomedical")
            .when(blob.rlike(V.BIOLOGICAL_PATTERN), "biological").otherwise("general"))
