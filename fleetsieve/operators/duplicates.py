"""Cross-dataset duplicates (A6) and the ordered, quota-bound selection of the fleet.

Only pairs that matter are ever formed. Row hashes shared by several datasets are first
folded into one *pattern* (the sorted list of the probing datasets that hold the row),
patterns are counted, and only distinct patterns are opened into pairs. The number of
probing datasets per pattern is bounded by the probe block, so a row that occurs in a
third of all datasets costs one row per dataset and block, never all pairs."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsieve import values as V
from fleetsieve.fleet import Fleet
from fleetsieve.functions.ranking import SPLIT, running_total
from fleetsieve.functions.stats import ratio
from fleetsieve.session import cut, written

PROBE_BLOCK = 512


def sorted_row_hashes(fleet: Fleet) -> DataFrame:
    """Distinct hashes of the numeric values of each row in sorted order, so neither column
    order nor row order matters. Missing values become the sentinel."""
    row = F.array_sort(F.transform("num", lambda x: F.coalesce(x, F.lit(V.NA_SENTINEL))))
    return fleet.samples.select("dataset_id", F.xxhash64(F.size(row), row).alias("h")).distinct()


def with_positions(hashes: DataFrame, datasets: DataFrame) -> DataFrame:
    return hashes.join(datasets.select("dataset_id", F.col("pos").cast("bigint").alias("pos")), "dataset_id")


def shared_rows(probe: DataFrame, other: DataFrame, block: int = PROBE_BLOCK) -> DataFrame:
    """(a, b, shared): rows shared by probe dataset ``a`` and a later dataset ``b``.

    ``probe`` and ``other`` have pos and h, distinct."""
    patterns = (probe.groupBy("h", F.floor(F.col("pos") / block).alias("block"))
                .agg(F.array_sort(F.collect_list("pos")).alias("pattern")))
    # a probe may be its own later neighbour's only partner: keep earlier positions only
    met = (other.select(F.col("pos").alias("b"), "h").join(patterns.drop("block"), "h")
           .select("b", F.filter("pattern", lambda p: p < F.col("b")).alias("pattern"))
           .where(F.size("pattern") > 0)
           .groupBy("b", "pattern").agg(F.count("*").alias("n")))
    return (met.select(F.explode("pattern").alias("a"), "b", "n")
            .groupBy("a", "b").agg(F.sum("n").alias("shared")))


def row_overlap(fleet: Fleet, threshold: float = V.OVERLAP_THRESHOLD, block: int = PROBE_BLOCK) -> DataFrame:
    """Pairs of datasets with shared / smaller > threshold; ``a`` is the earlier one."""
    hashes = with_positions(sorted_row_hashes(fleet), fleet.datasets).select("pos", "h")
    sizes = hashes.groupBy("pos").agg(F.count("*").alias("size"))
    ids = fleet.datasets.select(F.col("pos").cast("bigint").alias("pos"), "dataset_id")
    named = sizes.join(ids, "pos")
    a = named.select(F.col("pos").alias("a"), F.col("size").alias("size_a"), F.col("dataset_id").alias("earlier"))
    b = named.select(F.col("pos").alias("b"), F.col("size").alias("size_b"), F.col("dataset_id").alias("later"))
    pairs = shared_rows(hashes, hashes, block).join(a, "a").join(b, "b")
    overlap = ratio(F.col("shared"), F.least("size_a", "size_b"))
    return (pairs.select("earlier", "later", "a", "b", "shared", overlap.alias("overlap"))
            .where(F.col("overlap") > threshold))


# ------------------------------------------------------------- ordered selection
def interleave(candidates: DataFrame, split: int = SPLIT) -> DataFrame:
    """Round-robin over sources in first-seen order; ``turn`` is the new order.

    A turn is counted, not sorted: rank inside the source plus, for earlier rounds, how
    many candidates every other source contributed. Only per-source totals are compared."""
    candidates = written(candidates, "candidates")
    ranked = running_total(candidates.withColumn("_one", F.lit(1)), ["source"], "pos", "_one",
                           "round", split, stored=True).drop("_one")
    totals = candidates.groupBy("source").agg(F.count("*").alias("size"), F.min("pos").alias("first"))
    seats = totals.agg(F.array_sort(F.collect_list(F.struct("first", "size"))).alias("seats"))
    joined = (ranked.join(totals.select("source", "first"), "source").crossJoin(F.broadcast(seats)))
    earlier = F.aggregate("seats", F.lit(0).cast("bigint"), lambda acc, s: acc + F.least(
        s["size"], F.when(s["first"] < F.col("first"), F.col("round")).otherwise(F.col("round") - 1)
        .cast("bigint")))
    return joined.withColumn("turn", earlier + 1).drop("seats", "first")


def _set_signature(hashes: DataFrame) -> DataFrame:
    """Order-free 128-bit signature of each dataset's hash set."""
    return hashes.groupBy("dataset_id").agg(
        F.count("*").alias("size"), F.bit_xor("h").alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(7), "h")).alias("s2"))


def _batch_choice(batch: DataFrame, edges: DataFrame, taken: DataFrame, max_total, max_per_source) -> DataFrame:
    """Walk one bounded batch in order: accept unless an accepted earlier one overlaps or a
    quota is full. The walk is a fold over one array of at most a batch of small structs."""
    near = edges.groupBy(F.col("b").alias("pos")).agg(F.collect_list("a").alias("near"))
    empty = F.array().cast("array<bigint>")
    rows = batch.join(near, "pos", "left").select(F.struct(
        "pos", "source", F.coalesce("near", empty).alias("near")).alias("c"))
    line = rows.agg(F.array_sort(F.collect_list("c")).alias("line"))
    # with a quota there are at most that many taken ones; without any their sources are not needed
    counted = taken if max_total is not None or max_per_source is not None else taken.limit(0)
    before = counted.agg(F.collect_list("source").alias("sources"))
    start = F.struct(empty.alias("picked"), F.col("sources").alias("sources"))

    def step(acc, c):
        free = ~F.arrays_overlap(acc["picked"], c["near"])
        if max_total is not None:
            free = free & (F.size(acc["sources"]) < max_total)
        if max_per_source is not None:
            free = free & (F.size(F.filter(acc["sources"], lambda s: s == c["source"])) < max_per_source)
        return F.when(free, F.struct(
            F.array_append(acc["picked"], c["pos"]).alias("picked"),
            F.array_append(acc["sources"], c["source"]).alias("sources"))).otherwise(acc)

    return (line.crossJoin(before)
            .select(F.explode(F.aggregate("line", start, step)["picked"]).alias("pos")))


def select_fleet(datasets: DataFrame, hashes: DataFrame, threshold: float = V.OVERLAP_THRESHOLD,
                 max_total: int | None = V.MAX_SAVED,
                 max_per_source: int | None = V.MAX_SAVED_PER_SOURCE,
                 exempt=V.DUPLICATE_EXEMPT, batch: int = PROBE_BLOCK) -> DataFrame:
    """Accept datasets in ``pos`` order unless more than ``threshold`` of the smaller one's
    rows occur in a dataset accepted before. Returns every dataset with ``status`` accepted,
    rejected (with ``matched`` and ``overlap``) or skipped (a quota was full at its turn).

    Rounds settle a bounded batch of the earliest undecided datasets and then drop, in one
    join, everything that overlaps what was just accepted. A round costs one pass over the
    hashes still undecided; with quotas in force there are few rounds. Exact copies (same
    hash set, same source) follow their first copy and never enter a round."""
    ordered = datasets.select("dataset_id", "source", F.col("pos").cast("bigint").alias("pos"))
    checked = ordered.where(~F.col("source").isin(list(exempt)))
    rows = with_positions(hashes, checked)
    sizes = cut(ordered.join(_set_signature(hashes), "dataset_id", "left")
                .withColumn("size", F.when(F.col("source").isin(list(exempt)), 0)
                            .otherwise(F.coalesce("size", F.lit(0)))))
    copies = ["source", "size", "s1", "s2"]
    leads = sizes.where(F.col("size") > 0).groupBy(*copies).agg(F.min("pos").alias("lead"))
    sizes = (sizes.join(leads, copies, "left")
             .withColumn("lead", F.coalesce("lead", "pos")))
    open_ = cut(sizes.where(F.col("lead") == F.col("pos")).select("pos", "source", "size"))
    pool_rows = cut(rows.join(open_.select("pos"), "pos", "left_semi").select("pos", "h"))
    sized = open_.select("pos", "size")
    taken = open_.select("pos", "source").limit(0)

    def overlaps(probe, other):
        pairs = shared_rows(probe, other)
        a = sized.select(F.col("pos").alias("a"), F.col("size").alias("sa"))
        b = sized.select(F.col("pos").alias("b"), F.col("size").alias("sb"))
        return (pairs.join(a, "a").join(b, "b")
                .select("a", "b", ratio(F.col("shared"), F.least("sa", "sb")).alias("overlap"))
                .where(F.col("overlap") > threshold))

    found = None
    while True:
        if max_per_source is not None:
            full = taken.groupBy("source").count().where(F.col("count") >= max_per_source)
            open_ = open_.join(full.select("source"), "source", "left_anti")
        now = cut(open_.orderBy("pos").limit(batch))
        n_now = now.count()
        if n_now == 0 or (max_total is not None and taken.count() >= max_total):
            break
        mine = pool_rows.join(F.broadcast(now.select("pos")), "pos", "left_semi")
        picked = cut(_batch_choice(now, overlaps(mine, mine), taken, max_total, max_per_source))
        chosen = now.join(F.broadcast(picked), "pos", "left_semi")
        taken = cut(taken.unionByName(chosen.select("pos", "source")))
        probe = pool_rows.join(F.broadcast(picked), "pos", "left_semi")
        hits = cut(overlaps(probe, pool_rows))
        found = hits if found is None else found.unionByName(hits)
        if n_now < batch:
            break
        gone = hits.select(F.col("b").alias("pos")).union(now.select("pos")).distinct()
        open_ = cut(open_.join(gone, "pos", "left_anti"))
        pool_rows = cut(pool_rows.join(gone, "pos", "left_anti"))

    if found is None:
        found = sized.limit(0).select(F.col("pos").alias("a"), F.col("pos").alias("b"),
                                      F.lit(0.0).alias("overlap"))
    first = found.groupBy("b").agg(F.min_by(F.struct("a", "overlap"), "a").alias("m"))
    led = sizes.select("dataset_id", "source", "pos", "lead", "size")
    by = led.select(F.col("pos").alias("m_pos"), F.col("dataset_id").alias("matched"))
    took = taken.select("pos", F.lit(True).alias("took"))
    lead_took = taken.select(F.col("pos").alias("lead"), F.lit(True).alias("lead_took"))
    m_pos = (F.when(F.col("lead_took") & (F.col("lead") < F.col("pos")), F.col("lead"))
             .otherwise(F.col("m.a")))
    overlap = F.when(F.col("lead_took") & (F.col("lead") < F.col("pos")), 1.0).otherwise(F.col("m.overlap"))
    out = (led.join(took, "pos", "left").join(lead_took, "lead", "left")
           .join(first.select(F.col("b").alias("lead"), "m"), "lead", "left")
           .withColumn("m_pos", m_pos).withColumn("overlap", overlap))
    # a quota that was already full at a candidate's turn means it was never looked at
    stop_all = taken.agg(F.count("*").alias("n"), F.max("pos").alias("p")).select(
        F.when(F.col("n") >= (max_total if max_total is not None else 2 ** 62), F.col("p")).alias("stop_all"))
    stop_src = taken.groupBy("source").agg(F.count("*").alias("n"), F.max("pos").alias("p")).select(
        "source", F.when(F.col("n") >= (max_per_source if max_per_source is not None else 2 ** 62),
                         F.col("p")).alias("stop_src"))
    late = (F.coalesce(F.col("pos") > F.col("stop_all"), F.lit(False))
            | F.coalesce(F.col("pos") > F.col("stop_src"), F.lit(False)))
    out = out.crossJoin(F.broadcast(stop_all)).join(F.broadcast(stop_src), "source", "left").join(by, "m_pos", "left")
    status = (F.when(F.col("took"), "accepted").when(late, "skipped").otherwise("rejected"))
    out = out.withColumn("status", status)
    rejected = F.col("status") == "rejected"
    return out.select("dataset_id", "source", "pos", "status",
                      F.when(rejected, F.col("matched")).alias("matched"),
                      F.when(rejected, F.col("overlap")).alias("overlap"))


def cross_duplicate_results(selection: DataFrame, exempt=V.DUPLICATE_EXEMPT) -> DataFrame:
    """A6 rule results; exempt sources and skipped candidates have none."""
    return (selection.where((F.col("status") != "skipped") & ~F.col("source").isin(list(exempt)))
            .select("dataset_id", F.lit("A6").alias("rule"), (F.col("status") == "accepted").alias("passed"),
                    F.when(F.col("status") == "rejected", F.concat(
                        F.lit("duplicate of "), "matched", F.lit(" (overlap="),
                        F.format_string("%.2f", "overlap"), F.lit(")"))).otherwise("").alias("reason")))
