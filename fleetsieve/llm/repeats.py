"""Repeated passages: maximal repeats from an enhanced suffix array, cut over a cluster.

Texts are bytes. A window is a string of `min_len` bytes; it belongs to the smallest hash among its
`gram`-byte strings, so equal windows belong to the same hash wherever they stand. Consecutive windows of a
text with the same hash make a stretch. Equal windows inside one stretch (a line of dashes, short periods)
bring the hash there twice, so a hash of a single stretch that holds it once has no repeat; the stretches of
every other hash meet in one bucket, each distinct one once with the number of its occurrences.

A task takes several buckets and builds one enhanced suffix array over their stretches: window starts in
the order of their suffixes, with the common prefix of neighbours (a stretch with more than one occurrence
stands there twice). A scan with a stack finds the intervals of common prefixes of `min_len` bytes or more,
with all their members; an interval whose members have different left neighbours, or of which one begins
its stretch, is a maximal repeat (within stretches: a longer passage is covered by the repeats of the
stretches it runs through). Every window that occurs twice lies in one, so their members cover exactly the
bytes that a repeated string of `min_len` bytes covers.

A bucket of more than `heavy` distinct window starts (a passage in very many contexts) is cut again: its
stretches become the texts of the same procedure with longer grams, in the end as long as the window, where
a bucket has one distinct stretch. Hashes that very many documents share are spread over the join by salts.

Defined results: null counts as empty; a text shorter than `min_len` has no repeat; rows equal in id and
text are separate occurrences with the same result; an empty table gives no rows; other columns, whatever
their names, are ignored, or kept by `drop_repeats`.
"""
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fleetsieve.llm.common import fresh
from fleetsieve.session import cut

MIN_LEN = 400
#: Lengths of the grams that choose a window's bucket, then those of buckets that are cut again.
GRAMS = (0.32, 0.9, 0.98, 1.0)
HEAVY = 1 << 17
#: Windows a stretch has at most, and window starts a task looks at together.
LONGEST, SLICE, HELD = 512, 1 << 17, 40_000
_BASE = 0x9E3779B97F4A7C15
_WIDE = (1 << 64) - 1


def _random_words(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _WIDE
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _WIDE
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _WIDE
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def _sliding(best: np.ufunc, x: np.ndarray, w: int, pad: int) -> np.ndarray:
    """The least or largest of every w neighbours."""
    if w == 1:
        return x
    rows = np.concatenate([x, np.full(-len(x) % w, pad, np.uint64)]).reshape(-1, w)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return best(behind[:m], ahead[w - 1:w - 1 + m])


class Grams:
    """Hashes of all strings of `gram` bytes and their minimum in every window."""

    def __init__(self, min_len: int, gram: int):
        self.min_len, self.gram, self.width = min_len, gram, min_len - gram + 1
        n = SLICE + min_len + 1
        self.bytes = _random_words(256, 7)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

    def minima(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One hash for each window of the bytes, and that of every gram."""
        n, k, w = len(data), self.gram, self.width
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[:n], out=sums[1:])
        x = (sums[k:] - sums[:-k]) * self.inverse[:n - k + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return _sliding(np.minimum, x, w, _WIDE), x

    def chosen_twice(self, least: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of neighbouring equal ones among the grams that some window chose (a gram chosen by a window
        is as large as the largest choice of all windows over it). Two places of a hash in its stretch
        have no other chosen gram between them: a window between them would have neither."""
        w = self.width
        hits = np.flatnonzero(x == _sliding(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, 0))
        pairs = np.flatnonzero(x[hits[1:]] == x[hits[:-1]])
        return hits[pairs], hits[pairs + 1]


def stretches(data: np.ndarray, ends: np.ndarray, grams: Grams):
    """Runs of windows of one hash in texts that lie one after the other: (text, first byte, bytes, hash),
    in slices, so that a text of any length takes the same memory."""
    for *run, _ in _marked(data, ends, grams):
        yield tuple(run)


def _marked(data: np.ndarray, ends: np.ndarray, grams: Grams):
    """:func:`stretches`, and of each whether it may hold a window twice."""
    size = grams.min_len
    begins = np.concatenate([[0], ends[:-1]])
    shut = np.maximum(begins, ends - size + 1)  # no window starts from here to the end of the text
    for first in range(0, max(len(data) - size + 1, 0), SLICE):
        last = min(first + SLICE, len(data) - size + 1)
        found, every = grams.minima(data[first:last + size - 1])
        ones, others = grams.chosen_twice(found, every)
        a, b = np.searchsorted(ends, first, "right"), np.searchsorted(begins, last, "left")
        step = np.zeros(last - first + 1, np.int32)
        np.add.at(step, np.clip(shut[a:b], first, last) - first, 1)
        np.add.at(step, np.clip(ends[a:b], first, last) - first, -1)
        valid = np.cumsum(step[:-1]) == 0
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (valid[1:] != valid[:-1])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(found)))
        own = valid[starts]
        starts, counts = starts[own], counts[own]
        if len(counts) and counts.max() > LONGEST:
            pieces = -(-counts // LONGEST)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            whole = np.repeat(counts, pieces)
            starts = np.repeat(starts, pieces) + nth * LONGEST
            counts = np.minimum(whole - nth * LONGEST, LONGEST)
        at = starts + first
        reach = np.append(others, len(every))[np.searchsorted(ones, starts)]
        yield np.searchsorted(begins, at, "right") - 1, at, counts + size - 1, found[starts].view(np.int64), reach < starts + counts + grams.width - 1


def _emit_stretches(min_len: int, gram: int):
    """(a, b, body, n) -> (a, b, start, len, h, g, n, within); g tells the bytes of a stretch, within whether
    it may repeat itself."""
    def run(batches):
        grams = Grams(min_len, gram)
        for batch in batches:
            a, b, body, n = (batch.column(i) for i in range(4))
            body = body.cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
            if len(body) == 0 or offsets[-1] == offsets[0]:
                continue
            held = memoryview(body.buffers()[2])[offsets[0]:offsets[-1]]
            ends = offsets[1:] - offsets[0]
            begins = offsets[:-1] - offsets[0]
            a, b, n = (np.asarray(x) for x in (a, b, n))
            for text, at, size, h, within in _marked(np.frombuffer(held, np.uint8), ends, grams):
                if len(at):
                    g = np.fromiter((xxhash.xxh3_64_intdigest(held[p:p + s]) for p, s in zip(at.tolist(), size.tolist())), np.uint64, len(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (a[text], b[text], (at - begins[text]).astype(np.int64), size.astype(np.int32), h, g.view(np.int64), n[text], within)],
                        ["a", "b", "start", "len", "h", "g", "n", "within"])
    return run


def suffix_array(bodies: list[bytes], twice: list[bool], min_len: int):
    """Enhanced suffix array of the window starts of some stretches: stretch, offset, common prefix with
    the entry before (0 where it is shorter than min_len), byte before (-1 at the begin). A stretch marked twice stands there
    as two neighbours in every place."""
    base = np.cumsum([0] + [len(x) for x in bodies])
    text = b"".join(bodies)
    who = np.concatenate([np.full(len(x) - min_len + 1, i) for i, x in enumerate(bodies)])
    at = np.concatenate([np.arange(len(x) - min_len + 1) for x in bodies])
    keys = [text[p:e] for p, e in zip((base[who] + at).tolist(), base[who + 1].tolist())]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    del keys
    who, at = who[order], at[order]
    left = base[who + 1] - base[who] - at
    lcp = np.zeros(len(order), np.int64)
    wide = max(len(x) for x in bodies)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(wide), np.uint8), wide)
    place = base[who] + at
    head = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), min_len)
    block = max(1, (1 << 22) // wide)
    for i in range(1, len(order), block):
        p, q = place[i:i + block], place[i - 1:i - 1 + len(place[i:i + block])]
        near = np.flatnonzero((head[p, -1] == head[q, -1]) & (head[p, 0] == head[q, 0]))
        near = near[(head[p[near]] == head[q[near]]).all(axis=1)]
        if len(near):
            differ = view[p[near]] != view[q[near]]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
            lcp[i + near] = np.minimum(same, np.minimum(left[i:i + block][near], left[i - 1:i - 1 + len(p)][near]))
    times = 1 + np.array(twice, np.int64)[who]
    twin = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) > 0
    lcp = np.repeat(lcp, times)
    who, at, left = np.repeat(who, times), np.repeat(at, times), np.repeat(left, times)
    lcp[twin] = left[twin]
    before = np.where(at > 0, np.frombuffer(text, np.uint8)[base[who] + at - 1].astype(np.int64), -1)
    return who, at, lcp, before


def maximal_repeats(bodies: list[bytes], twice: list[bool], min_len: int):
    """(length, first, last) of every maximal repeat, as an interval of the suffix array, and that array.

    `left` of an interval on the stack is the byte before all its members, or -1 once two differ; members
    that begin a stretch differ from all."""
    who, at, lcp, before = suffix_array(bodies, twice, min_len)
    found, stack, lcps, before = [], [], lcp.tolist(), before.tolist()
    for i in range(1, len(lcps) + 1):
        depth = lcps[i] if i < len(lcps) else 0
        if not stack and depth < min_len:
            continue
        first, byte = i - 1, before[i - 1]
        while stack and stack[-1][0] > depth:
            length, first, seen = stack.pop()
            byte = seen if seen == byte else -1
            if byte < 0:
                found.append((length, first, i - 1))
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != byte:
                stack[-1][2] = -1
        elif depth >= min_len:
            stack.append([depth, first, byte])
    return found, who, at


def _scan(min_len: int, groups: bool):
    """Stretches (h, g, n, body), sorted by h and g -> (h, g, lo, hi, repeat): the members of all maximal
    repeats, or, without `groups`, what they cover of each stretch."""
    def settle(hs, gs, many, bodies):
        found, who, at = maximal_repeats(bodies, many, min_len)
        if not found:
            return None
        if groups:
            rows = [(w, a, a + length, name) for length, first, last in found
                    for name in (xxhash.xxh3_64_intdigest(bodies[who[first]][at[first]:at[first] + length]),)
                    for w, a in dict.fromkeys(zip(who[first:last + 1].tolist(), at[first:last + 1].tolist()))]
            own, lo, hi = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            name = np.array([r[3] for r in rows], np.uint64).view(np.int64)
        else:
            reach = np.zeros(len(who), np.int64)
            for length, first, last in found:
                np.maximum(reach[first:last + 1], length, out=reach[first:last + 1])
            some = np.flatnonzero(reach)
            some = some[np.lexsort((at[some], who[some]))]
            own, lo, hi = who[some], at[some], at[some] + reach[some]
            gap = 1 + max(len(x) for x in bodies)  # one line for all stretches: no range reaches the next one
            far = np.maximum.accumulate(own * gap + hi)
            new = np.ones(len(own), bool)
            new[1:] = own[1:] * gap + lo[1:] > far[:-1]
            starts = np.flatnonzero(new)
            own, lo, hi = own[starts], lo[starts], far[np.append(starts[1:] - 1, len(far) - 1)] - own[starts] * gap
            name = np.zeros(len(own), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.int64)[own]), pa.array(np.array(gs, np.int64)[own]), pa.array(lo.astype(np.int64)),
                                           pa.array(hi.astype(np.int64)), pa.array(name)], ["h", "g", "lo", "hi", "repeat"])

    def run(batches):
        hs, gs, many, bodies, held = [], [], [], [], 0
        for batch in batches:
            for h, g, n, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if hs and h != hs[-1] and held >= HELD:
                    if (out := settle(hs, gs, many, bodies)) is not None:
                        yield out
                    hs, gs, many, bodies, held = [], [], [], [], 0
                if hs and (h, g) == (hs[-1], gs[-1]):
                    continue  # rows equal in id and text bring the same stretch again
                hs.append(h)
                gs.append(g)
                many.append(n > 1)
                bodies.append(body)
                held += len(body) - min_len + 1
        if hs and (out := settle(hs, gs, many, bodies)) is not None:
            yield out
    return run


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str, share=1 << 11, salts=64) -> DataFrame:
    """rows joined with a lookup of distinct keys and the `count` of rows each has. A key with more than one
    of `share` of all rows, of which there are at most `share`, is spread over `salts` tasks; the list of
    those is small whatever the data, and is all that is broadcast."""
    total = lookup.agg(F.sum(count)).first()[0] or 0
    hot = cut(lookup.filter(F.col(count) * share > total).select(*keys, F.lit(True).alias("hot")))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    opened = lookup.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(every)).drop("hot")
    return marked.join(opened, [*keys, "salt"]).drop("salt")


def _joined(ranges: Column) -> Column:
    """An array of ranges (lo, hi, repeat) with those that overlap or touch made one."""
    kind = "array<struct<lo:bigint,hi:bigint,repeat:bigint>>"

    def step(done, x):
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"), last["repeat"].alias("repeat"))
        return F.when(x["lo"] <= last["hi"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x))).cast(kind)

    return F.aggregate(F.sort_array(ranges), F.array().cast(kind), step)


def repeated_ranges(texts: DataFrame, min_len=MIN_LEN, heavy=HEAVY, groups=False, level=0) -> DataFrame:
    """texts (a, b, body, n) with two longs that name a text -> (a, b, lo, hi, repeat), see `_scan`."""
    gram = max(1, min(min_len, round(min_len * GRAMS[level])))
    schema = "a bigint, b bigint, start bigint, len int, h bigint, g bigint, n bigint, within boolean"
    found = texts.select("a", "b", "body", "n").mapInArrow(_emit_stretches(min_len, gram), schema)
    shared = cut(found.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("rows"), F.max("within").alias("within"))
                 .filter((F.col("all") > 1) | F.col("within")).select("h", "rows"))
    placed = cut(spread_join(found.drop("within"), shared, ["h"], "rows").drop("rows"))
    kinds = cut(placed.groupBy("h", "g").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("a", "b", "start", "len")).alias("at")))
    starts = F.sum(F.col("at.len") - min_len + 1)
    large = cut(kinds.groupBy("h").agg(starts.alias("k"), F.count("*").alias("kinds")).filter((F.col("k") > heavy) & (F.col("kinds") > 1))
                .select("h", F.lit(True).alias("large")))
    last = level + 1 == len(GRAMS)
    again = not last and not large.isEmpty()
    one = kinds.join(large, "h", "left")
    one = one.groupBy(F.col("at.a").alias("a"), F.col("at.b").alias("b")).agg(
        F.collect_list(F.struct("h", "g", "n", "large", "at.start", "at.len")).alias("own"))  # stretches of one text
    bodies = texts.select("a", "b", "body").join(one, ["a", "b"]).select(F.explode(F.transform("own", lambda x: F.struct(
        x["h"].alias("h"), x["g"].alias("g"), x["n"].alias("n"), x["large"].alias("large"),
        F.substring(F.col("body"), (x["start"] + 1).cast("int"), x["len"]).alias("body")))).alias("x")).select("x.*")
    bodies = cut(bodies) if again else bodies
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = bodies.filter("large is null") if not last else bodies
    ranges = small.select("h", "g", "n", "body").repartition(tasks, "h").sortWithinPartitions("h", "g").mapInArrow(
        _scan(min_len, groups), "h bigint, g bigint, lo bigint, hi bigint, repeat bigint")
    if again:
        more = bodies.filter("large").select(F.col("h").alias("a"), F.col("g").alias("b"), "body", "n").dropDuplicates(["a", "b"])
        more = repeated_ranges(more, min_len, heavy, groups, level + 1)
        ranges = ranges.unionByName(more.select(F.col("a").alias("h"), F.col("b").alias("g"), "lo", "hi", "repeat"))
    listed = F.collect_list(F.struct("lo", "hi", "repeat"))  # of one stretch
    own = cut(ranges.groupBy("h", "g").agg((listed if groups else _joined(listed)).alias("ranges")))
    own = own.join(kinds.select("h", "g", "rows"), ["h", "g"])
    return spread_join(placed.select("a", "b", "start", "h", "g"), own, ["h", "g"], "rows").select("a", "b", F.explode(F.transform("ranges", lambda x: F.struct(
        (F.col("start") + x["lo"]).alias("lo"), (F.col("start") + x["hi"]).alias("hi"), x["repeat"].alias("repeat")))).alias("x")).select("a", "b", "x.*")


def _named(docs: DataFrame, doc_id: str, text: str):
    """Two hashes that name a row by its id and text: columns a and b."""
    return F.xxhash64(F.lit(1), F.col(doc_id)), F.xxhash64(text)


def _texts(docs, doc_id, text):
    a, b = _named(docs, doc_id, text)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(a.alias("a"), b.alias("b"), body.alias("body"), F.lit(1).cast("long").alias("n"))


def repeat_groups(docs: DataFrame, doc_id="doc_id", text="text", min_len=MIN_LEN, heavy=HEAVY) -> DataFrame:
    """repeat (a hash of its bytes), length, doc_id, start: all occurrences of every maximal repeat."""
    found = repeated_ranges(_texts(docs, doc_id, text), min_len, heavy, groups=True)
    a, b = _named(docs, doc_id, text)
    ids = docs.select(F.col(doc_id).alias("doc_id"), a.alias("a"), b.alias("b")).distinct()
    return found.join(ids, ["a", "b"]).select("repeat", (F.col("hi") - F.col("lo")).alias("length"), "doc_id", F.col("lo").alias("start")).distinct()


def _kept(text: bytes, ranges) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, the number of maximal removed runs."""
    out, at, spans = [], 0, 0
    for lo, hi in sorted(ranges):
        if lo > at or not spans:
            out.append(text[at:lo])
            spans += 1
        at = max(at, hi)
    kept = b"".join([*out, text[at:]])
    return kept, len(text) - len(kept), spans


def _with_ranges(rows: DataFrame, texts: DataFrame, min_len, heavy) -> DataFrame:
    """rows (a, b, ...) with the array `ranges` of what goes of their text, null if nothing does."""
    found = repeated_ranges(texts, min_len, heavy)
    found = found.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))  # of one text
    return rows.join(found, ["a", "b"], "left")


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text", min_len=MIN_LEN, heavy=HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = _texts(docs, doc_id, text)
    a, b = _named(docs, doc_id, text)
    rows = docs.select(a.alias("a"), b.alias("b"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))

    def digest(batches):
        for batch in batches:
            ids, bodies, ranges = (batch.column(i) for i in range(3))
            out = []
            for body, own in zip(bodies, ranges):
                body = body.as_py()
                kept, gone, spans = _kept(body, [(r["lo"], r["hi"]) for r in own.as_py() or []])
                out.append((len(body), gone, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], pa.int64()) for i in range(3)),
                                              pa.array([r[3] for r in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_ranges(rows, texts, min_len, heavy).select("doc_id", "body", "ranges").mapInArrow(
        digest, f"doc_id {dict(docs.dtypes)[doc_id]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def drop_repeats(docs: DataFrame, doc_id="doc_id", text="text", min_len=MIN_LEN, heavy=HEAVY) -> DataFrame:
    """The table with the repeats cut out of its texts, all copies of them; half characters at the cuts go."""
    a, b = _named(docs, doc_id, text)
    one, two, held = fresh(docs, "a", "b", "ranges")
    found = repeated_ranges(_texts(docs, doc_id, text), min_len, heavy)
    found = found.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias(held)).withColumnsRenamed({"a": one, "b": two})

    @F.pandas_udf("string")
    def cut_out(bodies, ranges):
        def clean(body, own):
            if body is None or own is None:
                return body
            return _kept(body.encode(), [(r["lo"], r["hi"]) for r in own])[0].decode(errors="ignore")
        return bodies.combine(ranges, clean)

    rows = docs.withColumn(one, a).withColumn(two, b).join(found, [one, two], "left")
    return rows.withColumn(text, F.when(F.col(held).isNull(), F.col(text)).otherwise(cut_out(text, held))).select(*docs.columns)
