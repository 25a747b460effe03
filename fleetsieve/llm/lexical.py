"""Ranked lexical search: the best documents of every item, by presence masks.

Documents are read in chunks. Within a chunk each term of the items has a bitmap of the documents that
hold it; an item's bitmaps, one bit of a mask each, group its documents by the set of its terms they hold.
A mask can score no more than the sum of the chunk's best contributions of its terms. Distinct masks are
evaluated by descending bound until the next bound is below the item's k-th score so far, which a task
carries from chunk to chunk; a bound equal to it is still evaluated, as a smaller id may win the tie.

Items go in blocks of about `block_chars` characters, so what tasks get is bounded; documents are never
shuffled, a task hands on its k best of each item, and those are ranked in two steps, first by task.

Defined results: a null or empty text has no terms and is no document of the statistics; a null id is one
like any other, before all numbers; rows that share an id are ranked separately; rows of `items` that share
an id are one item with the terms of all; an item without terms, or whose terms occur nowhere, has no rows.
"""
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fleetsieve.llm.common import LOWER, UPPER
from fleetsieve.llm.terms import LETTERS_AND_DIGITS, terms_of, texts_of
from fleetsieve.session import cut

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and words of a chunk.
CHUNK_DOCS, CHUNK_WORDS = 1 << 14, 1 << 22
_NULL_FIRST = np.iinfo(np.int64).min


def _statistics(vocabulary: frozenset):
    """Rows (term, docs, words) of a task: documents with a term, and under a null term all of them."""
    def run(batches):
        found, docs, words = Counter(), 0, 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                terms = terms_of(text, LETTERS_AND_DIGITS)
                docs += bool(terms)
                words += len(terms)
                found.update(vocabulary.intersection(terms))
        names = [t.decode() for t in found]
        yield pa.RecordBatch.from_arrays([pa.array([None, *names], pa.string()), pa.array([docs, *found.values()], pa.int64()),
                                          pa.array([words] + [0] * len(names), pa.int64())], ["term", "docs", "words"])
    return run


def length_factors(sizes: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of a document: 100 - 50 + (50 * n * N) div L."""
    if int(sizes.max(initial=0)) * docs * 50 < 1 << 63:
        return 50 + (50 * sizes * docs) // words
    return np.array([50 + (50 * int(n) * docs) // words for n in sizes], np.int64)


def distinct_masks(masks: np.ndarray):
    """masks (words, docs) -> distinct masks (words, kinds), docs in the order of their mask, where each kind starts."""
    order = np.lexsort(masks) if len(masks) > 1 else np.argsort(masks[0], kind="stable")
    ordered = masks[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return ordered[:, starts], order, np.append(starts, len(order))


def best_of_chunk(postings, n_docs: int, floor_score: int, k: int):
    """Documents of one item in a chunk that may be among its k best: places, scores.

    postings: one (documents, contributions) pair a term, contributions above 0."""
    masks = np.zeros(((len(postings) + 63) // 64, n_docs), np.uint64)
    for j, (docs, _) in enumerate(postings):
        masks[j // 64, docs] |= np.uint64(1 << (j % 64))
    matched = np.flatnonzero(masks.any(axis=0))
    kinds, order, starts = distinct_masks(masks[:, matched])
    bound = np.zeros(kinds.shape[1], np.int64)
    for j, (_, gains) in enumerate(postings):
        bound += ((kinds[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * gains.max()
    ranked = np.argsort(-bound, kind="stable")
    sizes = (starts[1:] - starts[:-1])[ranked]
    reach = np.cumsum(sizes)
    scores, chosen = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    at, step, found = 0, 2 * k, np.zeros(0, np.int64)
    while at < len(ranked) and bound[ranked[at]] >= max(floor_score, 1):
        upto = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + step, "right")))
        picked = ranked[at:upto]
        picked = picked[bound[picked] >= floor_score]
        docs = matched[order[np.concatenate([np.arange(starts[i], starts[i + 1]) for i in picked])]]
        chosen[:] = False
        chosen[docs] = True
        for places, gains in postings:
            own = chosen[places]
            scores[places[own]] += gains[own]
        found = np.concatenate([found, docs])
        if len(found) >= k:
            floor_score = max(floor_score, int(np.partition(scores[found], len(found) - k)[len(found) - k]))
        at, step = upto, step * 4
    found = found[scores[found] >= max(floor_score, 1)]
    return found, scores[found]


def _search(items, vocabulary, weights, n_all, l_all, k, id_type):
    """Rows (item, doc_id, score): the k best documents of every item in the task."""
    weights = np.array(weights, np.int64)

    def run(batches):
        best = {}
        ids, sizes, docs, terms, times, words = [], [], [], [], [], 0

        def settle():
            m = length_factors(np.array(sizes, np.int64), n_all, l_all)
            doc, term, tf = np.array(docs, np.int64), np.array(terms, np.int64), np.array(times, np.int64)
            gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            order = np.argsort(term, kind="stable")
            doc, term, gain = doc[order], term[order], gain[order]
            ends = np.searchsorted(term, np.arange(len(weights) + 1))
            key = np.array([_NULL_FIRST if i is None else i for i in ids], np.int64)
            null = np.array([i is None for i in ids])
            for place, wanted in enumerate(items):
                postings = [(doc[ends[t]:ends[t + 1]], gain[ends[t]:ends[t + 1]]) for t in wanted if ends[t] < ends[t + 1] and weights[t] > 0]
                postings = [(d, g) for d, g in postings if g.max() > 0]
                if not postings:
                    continue
                scores, keys, nulls = best.get(place, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)))
                found, new = best_of_chunk(postings, len(sizes), int(scores[k - 1]) if len(scores) >= k else 1, k)
                scores, keys, nulls = np.concatenate([scores, new]), np.concatenate([keys, key[found]]), np.concatenate([nulls, null[found]])
                top = np.lexsort((keys, ~nulls, -scores))[:k]
                best[place] = scores[top], keys[top], nulls[top]

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = terms_of(text, LETTERS_AND_DIGITS)
                if not found:
                    continue
                own = Counter(filter(vocabulary.__contains__, found))
                docs.extend([len(ids)] * len(own))
                terms.extend(vocabulary[t] for t in own)
                times.extend(own.values())
                ids.append(i)
                sizes.append(len(found))
                words += len(found)
                if len(ids) >= CHUNK_DOCS or words >= CHUNK_WORDS:
                    settle()
                    ids, sizes, docs, terms, times, words = [], [], [], [], [], 0
        if ids:
            settle()
        for place, (scores, keys, nulls) in best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(scores), place, np.int32)), pa.array(keys, pa.int64(), mask=nulls).cast(id_type), pa.array(scores)],
                ["item", "doc_id", "score"])
    return run


def item_terms(items: DataFrame, item_id="item_id", text="text") -> DataFrame:
    """item_id, terms (distinct, sorted) of every item that has any."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0))).alias("term"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def rank_documents(docs: DataFrame, items: DataFrame, k=50, doc_id="doc_id", text="text", item_id="item_id", item_text="text",
                   block_chars=1 << 23, ways=64) -> DataFrame:
    """item_id, rank (from 1, unique), doc_id, score of each item's k best documents; see the module.

    Ids of documents are whole numbers. The driver holds one block of items at a time, and for its terms
    the number of documents each; every block reads the documents twice."""
    wanted = cut(item_terms(items, item_id, item_text))
    chars = wanted.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t)))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    spark = docs.sparkSession
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[dict(docs.dtypes)[doc_id]]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    item_type = wanted.schema["item_id"].dataType.simpleString()
    parts = []
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about block_chars of them
        names = sorted({t for r in rows for t in r["terms"]})
        vocabulary = {t.encode(): i for i, t in enumerate(names)}
        counts = texts.select("text").mapInArrow(_statistics(frozenset(vocabulary)), "term string, docs bigint, words bigint")
        counts = {r["term"]: r for r in counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()}
        everything = counts.pop(None, None)
        if not names or everything is None or not everything["docs"]:
            continue
        n_all = everything["docs"]
        weights = [floor(1000 * log((2 * n_all + 2) / (2 * counts[t]["docs"] + 1))) if t in counts else 0 for t in names]
        place = [[vocabulary[t.encode()] for t in r["terms"]] for r in rows]
        found = texts.mapInArrow(_search(place, vocabulary, weights, n_all, everything["words"], k, id_type),
                                 f"item int, doc_id {dict(docs.dtypes)[doc_id]}, score bigint")
        way = F.pmod(F.spark_partition_id(), F.lit(ways))
        order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
        first = F.row_number().over(Window.partitionBy("item", "way").orderBy(*order))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        found = found.withColumn("way", way).withColumn("rank", first).filter(F.col("rank") <= k)
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {item_type}")
        parts.append(cut(found.join(ids, "item").select("item_id", "rank", "doc_id", "score")))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {dict(docs.dtypes)[doc_id]}, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
