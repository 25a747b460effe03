"""Source divergence audit: how far the sources of a language are apart, and by which terms.

Per language the terms in at least `min_docs` of its documents are kept. Every (language, source) gives
each kept term p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), the language as a whole q.

Terms of a source are grouped into cells (its count, the language's count); as p - q depends on the cell
alone, it is evaluated once per cell, cells of equal value are merged and ranked by their cumulative
multiplicity, and only the values that reach the first `top` ranks are opened into terms, in the order of
their UTF-8 bytes. Pairs of sources are summed over blocks of terms, a term's missing counts as zero.

Defined results: null text, lang and source count as ''; a group without a kept term has pairs (of value
0 where the language keeps no term) and no terms; rows that share an id are separate documents; an empty
table gives no rows. Tasks count terms before the shuffle, so the commonest terms and the largest source
are a row per task and group; nothing is gathered but one block of terms with the sources of its language.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fleetsieve.llm.terms import LETTERS, terms_of, texts_of
from fleetsieve.session import cut

SCALE, SMOOTH = 1_000_000_000, 5
#: Rows a task counts before it hands them on.
HELD = 300_000


def _count_terms(batches):
    """(lang, source, text) -> (lang, source, term, n, docs), counted within the task."""
    held, rows = {}, 0

    def out():
        keys = [(group, term, n) for group, (words, _) in held.items() for term, n in words.items()]
        return pa.RecordBatch.from_arrays([
            pa.array([g[0] for g, _, _ in keys], pa.string()), pa.array([g[1] for g, _, _ in keys], pa.string()),
            pa.array([t for _, t, _ in keys], pa.binary()).cast(pa.string()), pa.array([n for _, _, n in keys], pa.int64()),
            pa.array([held[g][1][t] for g, t, _ in keys], pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source", "text"))
        for group, text in zip(zip(langs.to_pylist(), sources.to_pylist()), texts_of(texts)):
            words, docs = held.setdefault(group, (Counter(), Counter()))
            found = Counter(terms_of(text, LETTERS))
            rows -= len(words)
            words.update(found)
            docs.update(found.keys())
            rows += len(words)
            if rows >= HELD:
                yield out()
                held, rows = {}, 0
    if held:
        yield out()


def shares(counts, sizes):
    """1 + floor(SCALE * counts / sizes) in whole numbers, three decimal digits at a time."""
    wide = np.max(sizes, initial=1) > 9 * 10 ** 15
    rest, sizes = (np.asarray(x).astype(object if wide else np.int64) for x in (counts, sizes))
    found = rest * 0
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // sizes, rest % sizes
    return (found + 1).astype(np.int64)


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of one block, for every two sources of its language."""
    names = sorted(right.column("source").to_pylist(), key=lambda s: s.encode())
    place = {s: i for i, s in enumerate(names)}
    order = np.argsort([place[s] for s in right.column("source").to_pylist()], kind="stable")
    terms_all = right.column("kept").to_numpy()[order].astype(np.int64)
    size = right.column("n").to_numpy()[order] + SMOOTH * terms_all
    sums = np.zeros((len(names), len(names)), np.int64)
    if left.num_rows:
        none = shares(np.full(len(names), SMOOTH), size)
        who = np.array([place[s] for s in left.column("source").to_pylist()])
        given = shares(left.column("n").to_numpy() + SMOOTH, size[who])
        _, term = np.unique(np.array(left.column("term").to_pylist(), dtype=object), return_inverse=True)
        by_term = np.argsort(term, kind="stable")
        who, given, term = who[by_term], given[by_term], term[by_term]
        slab = max(1, (1 << 21) // len(names))
        for first in range(0, int(term[-1]) + 1, slab):
            a, b = np.searchsorted(term, [first, first + slab])
            table = np.repeat(none[:, None], min(slab, int(term[-1]) + 1 - first), axis=1)
            table[who[a:b], term[a:b] - first] = given[a:b]
            for i in range(len(names) - 1):
                sums[i, i + 1:] += np.abs(table[i + 1:] - table[i]).sum(axis=1)
    one, two = np.triu_indices(len(names), 1)
    lang = right.column("lang").to_pylist()[0]
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array([names[i] for i in one], pa.string()),
                     "item": pa.array([names[i] for i in two], pa.string()), "value": pa.array(sums[one, two], pa.int64())})


def kept_counts(docs: DataFrame, min_docs=30, lang="lang", source="source", text="text") -> DataFrame:
    """lang, source, term, n (in the group), n_lang, lead (one row a term of a language), for kept terms."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = texts.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    by_term = Window.partitionBy("lang", "term")
    return (
        parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("n_lang", F.sum("n").over(by_term)).withColumn("all_docs", F.sum("docs").over(by_term))
        .withColumn("lead", F.row_number().over(by_term.orderBy("source")) == 1)
        .filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "lead"))


def group_sizes(docs: DataFrame, counts: DataFrame, lang="lang", source="source") -> DataFrame:
    """lang, source, n, kept (terms of the language), n_lang of every group that occurs."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))]
    groups = docs.select(*names).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.when(F.col("lead"), 1)).alias("kept"))
    langs = own.groupBy("lang").agg(F.sum("kept").alias("kept"), F.sum("n").alias("n_lang"))
    none = F.lit(0).cast("long")
    return groups.join(own.drop("kept"), ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n", "kept", "n_lang")])


def source_pairs(counts: DataFrame, sizes: DataFrame, blocks=256) -> DataFrame:
    """lang, source, item, value for every two sources of a language, both ways."""
    left = counts.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "source", "term", "n")
    right = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(
        _pair_sums, "lang string, source string, item string, value bigint")
    sums = cut(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    return sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def leading_terms(counts: DataFrame, sizes: DataFrame, top=50) -> DataFrame:
    """lang, source, item, value, rank of the terms a source uses more than its language."""
    def share(n, size):
        return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0))) div cast({size} + {SMOOTH} * kept as decimal(19,0))")

    cell = ["lang", "source", "n", "n_lang"]
    cells = counts.groupBy(*cell).agg(F.count("*").alias("many"))
    of = sizes.select("lang", "source", F.col("n").alias("size"), F.col("n_lang").alias("lang_size"), "kept")
    cells = cut(cells.join(of, ["lang", "source"]).withColumn("value", share("n", "size") - share("n_lang", "lang_size"))
                .filter("value > 0").select(*cell, "many", "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = (
        cells.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
        .withColumn("nth", F.row_number().over(by_value)).filter(F.col("nth") <= top)  # a value is one rank at least
        .withColumn("before", F.coalesce(F.sum("many").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter(F.col("before") < top).select("lang", "source", "value"))
    opened = counts.join(cells.join(values, ["lang", "source", "value"]).select(*cell, "value"), cell)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return opened.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_divergence(docs: DataFrame, lang="lang", source="source", text="text", min_docs=30, top=50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module."""
    counts = cut(kept_counts(docs, min_docs, lang, source, text))
    sizes = cut(group_sizes(docs, counts, lang, source))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = source_pairs(counts, sizes).withColumn("rank", rank)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        leading_terms(counts, sizes, top).withColumn("part", F.lit("term")).select(*columns))
