"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are hashed into blocks within their source: about `block_words` words each, but however small
the source is at least `SHARD_BLOCKS` a shard or as many as it has documents, and however large at most
`MOST_BLOCKS`. A source whose target is r times its words is drawn floor(r) times in full; one more
permutation of its blocks is walked, documents in the order of their hash within each, and every
document no longer than what is still open of the target is taken; longer ones are skipped. The walk is
a fixed number of aggregations, whatever the sizes: two stretches by running sums of blocks and of the
block in which the sum crosses what is open, then, with less open than the second document that didn't
fit, the next `AHEAD` documents that would fit, one by one. Then the shortest document left is added if it
brings the source nearer to its target. Every block with a document taken is a draw. Block draws are then dealt to output shards: a binary tree over the shards splits the quotas of
all sources at once by exact multivariate hypergeometric draws, so every shard gets its exact number
of blocks and a random share of every source. A shard takes a range of the permuted blocks of a source that no
other shard has; the mixture is shuffled within shards only.

Defined results: a null or empty text has size 0 and is never drawn; null sources are one source,
ordered last; rows that share an id are separate documents; an empty table gives an empty mixture.
Only DataFrame functions run. What meets in one task is bounded: a row per source (targets, tree nodes),
the blocks of a source (`MOST_BLOCKS`), the documents of one block, `AHEAD` documents. Rows per source are
broadcast up to `FEW_SOURCES` of them, and joined by a shuffle beyond.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetsieve.llm.common import fresh, one_row_each, word_count
from fleetsieve.session import cut

WEIGHTS = (5, 2, 1)
#: Blocks a source has at least for each shard, if it has as many documents.
SHARD_BLOCKS = 16
#: Blocks a source has at most for its size alone.
MOST_BLOCKS = 1 << 14
#: Stretches of a walk, and documents that fit which it looks at after them.
STRETCHES, AHEAD = 2, 1 << 12
#: Rows that are broadcast at most.
FEW_SOURCES = 1 << 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=1.5, max_repeat=2) -> DataFrame:
    """source -> source_size, docs, target. Targets share `share` of all sizes by weight; what exceeds
    `max_repeat` sizes is shared again among the others: the level at which the water stands is the
    first one, by rising cap per weight, below the next cap."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_at", "place")
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(max_repeat))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("to_share", share * F.sum("source_size").over(everything)
                    - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", F.col("to_share") / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everything)["level"])
    )
    target = F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))
    return rows.select("source", "source_size", "docs", target.alias("target"))


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once, inside an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(marked: Column, taken: Column, total: Column, u: Column) -> Column:
    """How many of `marked` among `total` things are among `taken` drawn ones, for a uniform u.

    Inversion of the distribution around its mode. Weights follow from each other by ratios; the
    walk covers 12 standard deviations on either side, beyond which a double holds no weight.
    """
    lo, hi = F.greatest(F.lit(0), taken + marked - total), F.least(marked, taken)
    mode = F.floor((taken + 1) * (marked + 1) / (total + 2))
    share = marked / F.greatest(total, F.lit(1))
    sd = F.sqrt(taken * share * (1 - share) * (total - taken) / F.greatest(total - 1, F.lit(1)))
    reach = F.ceil(12 * sd + 20)
    near = F.greatest(lo, F.least(hi, mode))
    span = F.struct(near.cast("long").alias("mode"), F.greatest(lo, near - reach).cast("long").alias("a"),
                    F.least(hi, near + reach).cast("long").alias("b"))

    def up(k):  # weight of k + 1 over the weight of k
        return (marked - k).cast("double") * (taken - k) / ((k + 1).cast("double") * (total - marked - taken + k + 1))

    def down(k):  # weight of k - 1 over the weight of k
        return k.cast("double") * (total - marked - taken + k) / ((marked - k + 1).cast("double") * (taken - k + 1))

    def walk(n, ratio):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(_steps(n), start, lambda acc, i: _bind(
            acc["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"))))

    def pick(s):
        below = walk(s["mode"] - s["a"], lambda i: down(s["mode"] - i + 1))
        above = walk(s["b"] - s["mode"], lambda i: up(s["mode"] + i - 1))
        return _bind(F.struct(below.alias("below"), above.alias("above")), lambda t: _bind(
            u * (1.0 + t["below"]["sum"] + t["above"]["sum"]),
            lambda aim: s["a"] + F.aggregate(
                _steps(s["b"] - s["a"]),
                F.struct(t["below"]["w"].alias("w"), t["below"]["w"].alias("sum"), F.lit(0).cast("long").alias("n")),
                lambda acc, i: _bind(acc["w"] * up(s["a"] + i - 1), lambda w: F.struct(
                    w.alias("w"), (acc["sum"] + w).alias("sum"),
                    (acc["n"] + F.when(acc["sum"] < aim, 1).otherwise(0)).cast("long").alias("n"))),
            )["n"]))

    return _bind(span, pick)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, q) -> (source, shard, q): every shard gets its equal share of all draws, exactly."""
    kind = "array<struct<source:string,q:bigint>>"
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("source", "q"))).cast(kind).alias("quotas")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas",
        F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["q"]).alias("all"))

    for _ in range(max(1, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        upto = lambda shard: F.floor(shard * F.col("all") / shards).cast("long")
        here = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        start = F.struct(here.alias("rest"), (upto(mid) - upto(F.col("lo"))).alias("open"), F.array().cast("array<bigint>").alias("out"))

        def step(acc, x):
            u = (F.pmod(F.xxhash64(F.lit(seed), "lo", "hi", F.coalesce(x["source"], F.lit("\0"))), F.lit(1 << 53)) + 0.5) / float(1 << 53)
            return _bind(hypergeometric(x["q"], acc["open"], acc["rest"], u).cast("long"), lambda h: F.struct(
                (acc["rest"] - x["q"]).alias("rest"), (acc["open"] - h).alias("open"), F.concat(acc["out"], F.array(h)).alias("out")))

        left = F.col("left")
        node = (
            node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("quotas", start, step, lambda acc: acc["out"])))
            .withColumn("child", F.explode(F.when(left.isNull(), F.array(F.struct("lo", "hi", "quotas"))).otherwise(F.array(
                F.struct("lo", mid.alias("hi"), F.transform("quotas", lambda x, i: F.struct(x["source"].alias("source"), F.get(left, i).alias("q"))).alias("quotas")),
                F.struct(mid.alias("lo"), "hi", F.transform("quotas", lambda x, i: F.struct(x["source"].alias("source"), (x["q"] - F.get(left, i)).alias("q"))).alias("quotas"))))))
            .select("child.lo", "child.hi", F.col("child.quotas").cast(kind).alias("quotas"), "all")
        )
        node = cut(node)  # a level of the tree
    return node.select(F.col("lo").cast("int").alias("shard"), F.inline("quotas")).filter("q > 0")


def _same_source(left, right, *also):
    on = left["source"].eqNullSafe(right["source"])
    for c in also:
        on = on & (left[c] == right[c])
    return on


def _walk(sized: DataFrame, state: DataFrame, small) -> DataFrame:
    """The next stretch of the walk of every open source, up to the first document that is longer than
    what is then left: source, until (its place, null at the end of the walk), left."""
    ahead = sized.join(small(state), _same_source(sized, state)).filter(
        (F.col("size") <= F.col("gap")) & (F.col("front").isNull() | (F.col("place") > F.col("front")))).select(sized["*"], "gap")
    order = Window.partitionBy("source").orderBy("place.turn", "place.block")
    crossed = F.col("upto") > F.col("gap")
    stops = (
        ahead.groupBy("source", "gap", "place.turn", "place.block").agg(F.sum("size").alias("words"))
        .withColumn("place", F.struct("turn", "block")).withColumn("upto", F.sum("words").over(order))
        .groupBy("source", "gap").agg(F.max("upto").alias("all"), F.min(F.when(crossed, F.struct(
            F.col("turn").alias("turn"), F.col("block").alias("block"), (F.col("gap") - F.col("upto") + F.col("words")).alias("room")))).alias("stop"))
        .select("source", (F.col("gap") - F.col("all")).alias("rest"), "stop"))
    inside = ahead.join(small(stops), _same_source(ahead, stops) & (ahead["place.turn"] == stops["stop.turn"]) & (ahead["place.block"] == stops["stop.block"]))
    inside = (
        inside.select(ahead["*"], F.col("stop.room").alias("room"))
        .withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("place"))).filter("upto > room")
        .groupBy("source").agg(F.min(F.struct("place", (F.col("room") - F.col("upto") + F.col("size")).alias("left"))).alias("at")))
    return stops.join(inside, _same_source(stops, inside), "left").select(
        stops["source"], F.col("at.place").alias("until"), F.coalesce("at.left", "rest").alias("left"))


def _pick(sized: DataFrame, state: DataFrame, small) -> DataFrame:
    """source, gap, picked: rows of the next documents that fit, one by one, and what is open after them."""
    ahead = sized.join(small(state), _same_source(sized, state)).filter((F.col("size") <= F.col("gap")) & (F.col("place") > F.col("front")))
    nth = F.row_number().over(Window.partitionBy(sized["source"]).orderBy("place"))
    ahead = ahead.select(sized["*"], "gap", nth.alias("nth")).filter(F.col("nth") <= AHEAD)
    steps = F.sort_array(F.collect_list(F.struct("nth", "size", F.col("place.row").alias("row"))))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("picked"))

    def step(acc, x):
        return F.when(x["size"] <= acc["gap"], F.struct(
            (acc["gap"] - x["size"]).alias("gap"), F.concat(acc["picked"], F.array(x["row"])).alias("picked"))).otherwise(acc)

    lists = ahead.groupBy("source", "gap").agg(steps.alias("steps"))
    return lists.select("source", F.aggregate("steps", start, step).alias("end")).select("source", "end.*")


def fill_targets(sized: DataFrame, rests: DataFrame, small=F.broadcast) -> DataFrame:
    """source -> gap, stretches, picked: a walk over the documents of a source by `place` that takes each one
    no longer than what is still open. In a stretch (limit, until) the longest document taken is `limit`;
    after the last one single rows are picked."""
    kind = sized.schema["place"].dataType.simpleString()
    state = rests.filter("rest > 0").select(
        "source", F.col("rest").alias("gap"), F.lit(None).cast(kind).alias("front"),
        F.array().cast(f"array<struct<limit:bigint,until:{kind}>>").alias("stretches"), F.lit(True).alias("open"))
    for _ in range(STRETCHES):
        found = _walk(sized, state.filter("open").select("source", "gap", "front"), small)
        state = cut(state.join(small(found), _same_source(state, found), "left").select(
            state["source"], F.coalesce("left", "gap").cast("long").alias("gap"), F.col("until").alias("front"),
            F.when(F.col("open"), F.concat("stretches", F.array(F.struct(F.col("gap").alias("limit"), "until")))).otherwise(F.col("stretches")).alias("stretches"),
            F.col("until").isNotNull().alias("open")))
    found = _pick(sized, state.filter("open").select("source", "gap", "front"), small)
    return cut(state.join(small(found), _same_source(state, found), "left").select(
        state["source"], F.coalesce(found["gap"], state["gap"]).alias("gap"), "stretches",
        F.coalesce("picked", F.array().cast("array<bigint>")).alias("picked")))


def plan_mix(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS, share=1.5, max_repeat=2,
             block_words=1 << 18, shards=16, seed=11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, shards (the output shard of
    each copy the mix takes; empty if it takes none), shuffle_key (order within a shard), text_hash."""
    source_col = F.col(source).cast("string").alias("source")
    slim = cut(docs.select(F.col(doc_id).alias("doc_id"), source_col, word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"))
               .withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("row", F.monotonically_increasing_id()))
    per_source = cut(
        source_targets(slim, weights, share, max_repeat)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
        .withColumn("n_blocks", F.greatest(
            F.lit(1), F.least("docs", F.lit(SHARD_BLOCKS * shards)), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("long")))
    small = F.broadcast if per_source.count() <= FEW_SOURCES else lambda rows: rows

    block = F.pmod("key", "n_blocks")
    turn = F.xxhash64(F.lit(seed + 1), slim["source"], "passes", block)
    placed = slim.join(small(per_source), _same_source(slim, per_source), "left").select(
        slim["*"], "source_size", "target", "passes", block.alias("block"),
        F.struct(turn.alias("turn"), block.alias("block"), "key", "text_hash", "row").alias("place"))
    sized = placed.filter("size > 0").select("source", "size", "place")
    filled = fill_targets(sized, per_source, small)
    placed = placed.join(small(filled), _same_source(placed, filled), "left").select(placed["*"], "gap", "stretches", "picked")
    stretch = F.get(F.filter("stretches", lambda x: x["until"].isNull() | (F.col("place") < x["until"])), F.lit(0))
    taken = (F.col("size") > 0) & ((F.col("size") <= stretch["limit"]) | F.array_contains("picked", F.col("row")))
    placed = cut(placed.withColumn("taken", F.coalesce(taken, F.lit(False))).drop("stretches", "picked"))
    # What is open now is less than any document that was skipped; the shortest one may still bring the source nearer.
    closing = cut(placed.filter("size > 0 and not taken and size < 2 * gap").groupBy("source").agg(F.min(F.struct("size", "place"))["place"].alias("last")))
    placed = placed.join(small(closing), _same_source(placed, closing), "left").select(placed["*"], "last")
    placed = placed.withColumn("taken", F.col("taken") | F.coalesce(F.col("place") == F.col("last"), F.lit(False))).drop("gap", "last", "place")

    blocks = placed.filter("size > 0").groupBy("source", "block", "passes").agg(F.bool_or("taken").alias("touched"))
    order = Window.partitionBy("source").orderBy("pass", F.xxhash64(F.lit(seed + 1), "source", "pass", "block"), "block")
    draws = cut(
        blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        .filter((F.col("pass") < F.col("passes")) | F.col("touched"))
        .select("source", "block", "pass", (F.col("pass") == F.col("passes")).alias("partly"), F.row_number().over(order).alias("draw")))
    dealt = split_quotas(draws.groupBy("source").agg(F.count("*").alias("q")), shards, seed + 2)
    last = F.sum("q").over(Window.partitionBy("source").orderBy("shard"))
    dealt = dealt.withColumn("last", last).select(
        "source", "shard", F.explode(F.sequence(F.col("last") - F.col("q") + 1, "last")).alias("draw"))
    drawn = draws.join(dealt, _same_source(draws, dealt, "draw")).groupBy(draws["source"], "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "partly", "shard"))).alias("drawn"))  # one entry a pass
    out = placed.join(drawn, _same_source(placed, drawn, "block"), "left").select(placed["*"], "drawn")
    mine = F.filter("drawn", lambda x: (F.col("size") > 0) & (~x["partly"] | F.col("taken")))
    shards_of = F.coalesce(F.transform(mine, lambda x: x["shard"]), F.array().cast("array<int>"))
    return out.select("doc_id", "source", "size", "source_size", "target", shards_of.alias("shards"), F.col("key").alias("shuffle_key"), "text_hash")


def mixture(docs: DataFrame, doc_id="doc_id", source="source", text="text", shards=16, seed=11, **settings) -> DataFrame:
    """The mix itself: the rows of the table, each as often as the mix takes it, partitioned by
    output shard and part of it, and shuffled within each. Rows equal in id and text count as one document of that many copies."""
    plan = plan_mix(docs, doc_id, source, text, shards=shards, seed=seed, **settings)
    copies = plan.select("doc_id", "text_hash", F.explode("shards").alias("shard")).groupBy("doc_id", "text_hash", "shard").agg(F.count("*").alias("copies"))
    dealt, shard, times, order, part = fresh(docs, "dealt", "shard", "copies", "order", "part")
    # The choice is written before it meets the texts; one entry a shard at most.
    copies = cut(copies.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("shard", "copies")).alias(dealt)))
    rows = one_row_each(docs, copies, doc_id, text, also=dealt).withColumn(dealt, F.explode(dealt))
    rows = rows.withColumn(shard, F.col(dealt)["shard"]).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(dealt)["copies"])))
    rows = rows.withColumn(order, F.xxhash64(F.lit(seed), F.xxhash64(text), doc_id, times))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = -(-parts // shards)  # a shard may be several parts, by ranges of the order in it
    rows = rows.withColumn(part, F.floor((F.col(order) / float(1 << 64) + 0.5) * each).cast("int"))
    return rows.repartition(shards * each, shard, part).sortWithinPartitions(shard, part, order).select(*docs.columns)
