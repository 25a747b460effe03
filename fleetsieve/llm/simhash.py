"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint's 64 bits are 32 segments of two; the bits set in each segment make a point with 32
coordinates. Flipping a bit moves one coordinate by one, so the Manhattan distance of two points never
exceeds the Hamming distance of their fingerprints. For up to 2 differing bits, 5 groups of
coordinates leave at least 3 groups alike; a cell of the grid is the values of 3 whole groups, and
each point lies in 10 cells. Within a cell, pairs pass the Manhattan bound first and are then compared
bit by bit. A cell that holds more than `pairwise` fingerprints isn't paired at all: two fingerprints
differ in at most 2 bits exactly if they have a common neighbour at 1 bit or less, so each fingerprint
is listed under its 65 neighbours and lists are chained, which is linear and loses no link.

Copies of a text share a fingerprint and are folded before anything is compared.
"""
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fleetsieve.llm.common import one_row_each
from fleetsieve.llm.components import components
from fleetsieve.session import cut

SPACE = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20  # bytes of a text whose words are held at a time
_GROUPS = np.array_split(np.arange(32), 5)
_PAIRS = np.uint64(0x5555555555555555)


def _word_blocks(data: bytes):
    """Words of a text in lists; cuts only at white space."""
    at = 0
    while at < len(data):
        to = at + BLOCK
        while to < len(data) and data[to] not in SPACE:
            to += 1
        yield data[at:to].split()
        at = to


def fingerprint(data: bytes, words=3, seed=42) -> int:
    """Of a text in UTF-8: a bit is set if it is in over half of the hashes of its shingles."""
    digest, ones, total, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for some in _word_blocks(data.lower()):
        some = carry + some
        carry = some[-(words - 1):] if words > 1 else []
        if len(some) < words:
            carry = some
            continue
        joined = b" ".join(some)
        ends = np.cumsum([len(x) + 1 for x in some]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(some) - words + 1].tolist(), ends[words - 1:].tolist())], np.uint64)
        for at in range(0, len(hashes), 8192):
            ones += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    if total == 0:
        return digest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", words=3) -> DataFrame:
    """doc_id, fp (bigint with the bits of the fingerprint), text_hash. Null, empty and blank texts have 0."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return source.mapInArrow(run, f"doc_id {kind}, fp bigint, text_hash bigint")


def _points(fps: np.ndarray) -> np.ndarray:
    """Counts of set bits of the 32 segments, two bits each, packed where the segments stand."""
    return (fps & _PAIRS) + (fps >> np.uint64(1) & _PAIRS)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a), np.int64)
    for shift in range(0, 64, 2):
        total += np.abs((a >> np.uint64(shift) & np.uint64(3)).astype(np.int64) - (b >> np.uint64(shift) & np.uint64(3)).astype(np.int64))
    return total


def _cells(batches):
    masks = []
    for kept in combinations(range(5), 3):
        segments = np.concatenate([_GROUPS[g] for g in kept])
        masks.append(np.bitwise_or.reduce(np.uint64(3) << (2 * segments).astype(np.uint64)))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        points = _points(fps)
        for k, mask in enumerate(masks):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array((points & mask).view(np.int64)), batch.column(0)], names=["grid", "cell", "fp"])


def _links(batches, bits, pairwise):
    """Links within the cells of one partition, which holds its cells whole."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    grid, cell, fp = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((fp, cell, grid))
    grid, cell, fp = grid[order], cell[order], fp[order].view(np.uint64)
    new = np.concatenate(([True], (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(fp)])))

    def batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for size in np.unique(sizes[(sizes > 1) & (sizes <= pairwise)]).tolist():
        left, right = np.triu_indices(size, 1)
        for some in np.array_split(starts[sizes == size], max(1, int((sizes == size).sum()) * len(left) >> 20)):
            a, b = fp[(some[:, None] + left).ravel()], fp[(some[:, None] + right).ravel()]
            near = _manhattan(_points(a), _points(b)) <= bits
            a, b = a[near], b[near]
            near = np.bitwise_count(a ^ b) <= bits
            yield batch(a[near], b[near])
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for start, size in zip(starts[sizes > pairwise].tolist(), sizes[sizes > pairwise].tolist()):
        own = fp[start:start + size]
        for part in range(8):  # an eighth of the neighbours at a time
            near = (own[:, None] ^ flips).ravel()
            kept = np.flatnonzero(near % np.uint64(8) == part)
            near, of = near[kept], own[kept // 65]
            by = np.argsort(near, kind="stable")
            near, of = near[by], of[by]
            same = near[1:] == near[:-1]
            chained = np.unique(np.stack([of[:-1][same], of[1:][same]], 1), axis=0)
            yield batch(np.ascontiguousarray(chained[:, 0]), np.ascontiguousarray(chained[:, 1]))


def links(classes: DataFrame, pairwise=256) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) that differ in at most 2 bits: enough of them that the
    components are those of all such pairs."""
    kind = "a bigint, b bigint"
    grid = classes.select("fp").mapInArrow(_cells, "grid int, cell bigint, fp bigint")
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.repartition(partitions, "grid", "cell").mapInArrow(lambda batches: _links(batches, 2, pairwise), kind).distinct()


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", words=3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component) of each row,
    component (the same for all rows of one, and for no others), text_hash.

    Null, empty and blank texts have fingerprint zero and are linked like any other; rows that share
    an id are rows of their own; null ids never name a component unless all of its ids are null.
    """
    marked = cut(fingerprints(docs, doc_id, text, words))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes))
    grown = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grown.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grown.join(named, "root").select("fp", "component_id", F.col("root").alias("component"))
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", "text_hash")


def drop_near_copies(docs: DataFrame, doc_id="doc_id", text="text", words=3) -> DataFrame:
    """The table with one row of each component: that of the smallest id (nulls first), then text hash."""
    found = near_duplicates(docs, doc_id, text, words)
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select("kept.*")
    return one_row_each(docs, kept, doc_id, text)
