"""Repeated passages, source divergence and lexical search against brute force; odd rows and empty tables."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from fleetsieve.llm import divergence, language_id, lexical, mixing, repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, h string, n double, rank int, item string"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, la, s, "h", 0.5, 1, "x") for i, t, la, s in rows], SCHEMA).repartition(3)


def brute_repeats(rows, size):
    """What `remove_repeats` returns, by a table of all windows."""
    bodies = [(t or "").encode() for _, t, *_ in rows]
    windows = Counter(b[i:i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for (doc_id, *_), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if windows[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, docs=60):
    """Texts over few letters with shared passages, copies, repeats within a text and periodic stretches."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    shared = [word(rnd.randint(15, 90)) for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "a"), (4, "a" * 700), (5, "ab" * 300), (6, "ab" * 301), (7, word(39)), (8, "same " * 30), (8, "same " * 30), (None, "same " * 30)]
    for i in range(docs):
        rows.append((10 + i, "".join(rnd.choice([word(rnd.randint(1, 60)), rnd.choice(shared), shared[0]]) for _ in range(rnd.randint(1, 5)))))
    rows += [(200 + i, rows[12][1]) for i in range(5)]
    return [(i, t, "en", "s") for i, t in rows]


@pytest.mark.parametrize("size, heavy", [(20, 1 << 17), (20, 30), (33, 1)])
def test_repeats_are_removed_as_by_all_windows(spark, size, heavy):
    rows = passages(size)
    found = repeats.remove_repeats(table(spark, rows), min_len=size, heavy=heavy).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_repeats(rows, size)


def test_repeats_of_long_texts_cross_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 64)
    monkeypatch.setattr(repeats, "LONGEST", 16)
    rows = passages(5, 20)
    grams = repeats.Grams(20, 6)
    held = [(t or "").encode() for _, t, *_ in rows]
    import numpy as np
    ends = np.cumsum([len(b) for b in held])
    covered = [set() for _ in held]
    for text, at, size, _ in repeats.stretches(np.frombuffer(b"".join(held), np.uint8), ends, grams):
        assert (size <= 16 + 19).all()
        for i, p, s in zip(text, at, size):
            starts = range(p - (ends[i] - len(held[i])), p - (ends[i] - len(held[i])) + s - 19)
            assert not covered[i].intersection(starts)
            covered[i].update(starts)
    assert [len(c) for c in covered] == [max(0, len(b) - 19) for b in held]  # every window is in one stretch


def test_suffix_scan_finds_all_maximal_repeats():
    rnd = random.Random(3)
    for _ in range(30):
        bodies = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(6, 30))) for _ in range(6)]
        bodies = list(dict.fromkeys(bodies))
        many = [rnd.random() < 0.3 for _ in bodies]
        found, who, at = repeats.maximal_repeats(bodies, many, 6)
        got = {bodies[who[a]][at[a]:at[a] + n]: sorted(zip(who[a:b + 1].tolist(), at[a:b + 1].tolist())) for n, a, b in found}
        places = defaultdict(list)
        for w, body in enumerate(bodies):
            for a in range(len(body)):
                for b in range(a + 6, len(body) + 1):
                    places[body[a:b]] += [(w, a)] * (2 if many[w] else 1)
        want = {}
        for s, spots in places.items():
            lefts = {bodies[w][a - 1] if a else (w, "begin", k) for k, (w, a) in enumerate(spots)}
            rights = {bodies[w][a + len(s)] if a + len(s) < len(bodies[w]) else (w, "end", k) for k, (w, a) in enumerate(spots)}
            if len(spots) > 1 and len(lefts) > 1 and len(rights) > 1:
                want[s] = sorted(spots)
        assert got == want


def test_groups_list_all_occurrences(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    rows = [(i, f"{i}!" * 20 + "|" + passage + "|" + chr(97 + i) * 50, "en", "s") for i in range(12)]
    found = repeats.repeat_groups(table(spark, rows), min_len=40).collect()
    places = defaultdict(set)
    for r in found:
        places[rows[r["doc_id"]][1][r["start"]:r["start"] + r["length"]]].add((r["doc_id"], r["start"]))
    for string, spots in places.items():
        assert spots == {(i, at) for i, t, *_ in rows for at in range(len(t)) if t.startswith(string, at)} and len(spots) > 1
    assert any(len(spots) == 12 and string in f"!|{passage}|" for string, spots in places.items())
    kept = repeats.drop_repeats(table(spark, rows), min_len=40)
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert all(passage not in r["text"] and r["text"].startswith(f"{r['doc_id']}!") for r in kept.collect())


def test_new_operators_on_empty_tables(spark):
    none = table(spark, []).filter("false")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert repeats.remove_repeats(none).count() == repeats.repeat_groups(none).count() == repeats.drop_repeats(none).count() == 0
    assert divergence.source_divergence(none).count() == 0
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(table(spark, [(1, "a", "en", "s")]), items.filter("false")).count() == 0
    assert lexical.rank_documents(table(spark, [(1, None, None, None), (2, " 	", None, None)]), items).count() == 0


def words(text, digits):
    kept = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return re.findall(kept, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def odd_texts(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "ÀB", "a1b", "x_y", "漢字", "don't", "UPPER", "\u0085z"]
    rows = [(i, " ".join(rnd.choice(vocabulary[:rnd.randint(3, len(vocabulary))]) for _ in range(rnd.randint(1, 60))),
             rnd.choice(["en", "en", "fr", None]), rnd.choice(["a", "a", "a", "b", "é", None])) for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", "fr", "lonely"), (n + 2, "1 2 3", "de", "a"), (n + 3, None, "de", "b"), (None, rows[0][1], "en", "a")]
    return rows + rows[5:8] + [(n + 9, "w1 " * 20_000, "fr", "b")]


def brute_divergence(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        own = Counter(words(text, False))
        counts[lang or "", source or ""].update(own)
        docs[lang or ""].update(own.keys())
    out = []
    for lang in {la for la, _ in counts}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        groups = {s: c for (la, s), c in counts.items() if la == lang}
        every = sum((Counter(c) for c in groups.values()), Counter())
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(every)
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


@pytest.mark.parametrize("min_docs, top", [(3, 4), (30, 50), (10_000, 5)])
def test_divergence_as_by_hand(spark, monkeypatch, min_docs, top):
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = odd_texts(1)
    found = divergence.source_divergence(table(spark, rows), min_docs=min_docs, top=top).collect()
    assert sorted(map(tuple, found)) == brute_divergence(rows, min_docs, top)


def test_shares_are_exact_for_large_counts():
    for c, n in [(7, 3 * 10 ** 6), (10 ** 13 + 7, 10 ** 15 + 9), (8 * 10 ** 18, 9 * 10 ** 18)]:
        assert divergence.shares([c], [n])[0] == 1 + 10 ** 9 * c // n


def brute_search(rows, items, k):
    docs = [(i, Counter(words(t, True))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n_all, l_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item in {i for i, _ in items}:
        terms = {t for i, x in items if i == item for t in words(x, True)}
        scored = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, chunk, chars", [(3, 16, 1 << 23), (50, 1 << 14, 40), (1000, 7, 1 << 23)])
def test_search_as_by_hand(spark, monkeypatch, k, chunk, chars):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", chunk)
    rows = odd_texts(2)
    items = [(1, "w1 W2 w1"), (2, "É é zzz"), (3, None), (4, ""), (5, "nowhere"), (6, " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"n{i} x" for i in range(60)) + " a1b x y 漢字 don t upper"),
             (1, "w30"), (None, "w7 w8"), (8, "w1")]
    table_of_items = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, rank int, term string")
    found = lexical.rank_documents(table(spark, rows), table_of_items, k=k, block_chars=chars).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_search(rows, items, k)


def test_more_than_64_terms_take_two_words_of_a_mask():
    import numpy as np
    rnd = random.Random(4)
    postings = [(np.array(sorted(rnd.sample(range(300), rnd.randint(1, 80)))), None) for _ in range(130)]
    postings = [(d, np.array([rnd.randint(1, 50) for _ in d])) for d, _ in postings]
    whole = np.zeros(300, np.int64)
    for d, g in postings:
        whole[d] += g
    found, scores = lexical.best_of_chunk(postings, 300, 1, 10)
    assert (whole[found] == scores).all() and set(np.argsort(-whole, kind="stable")[:10]) <= set(found)


def test_a_walk_takes_few_jobs_whatever_the_sizes(spark):
    sizes = [x for i in range(12) for x in (1, 12 - i)]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id bigint, text string, source string")
    spark.sparkContext.setJobGroup("walk", "walk")
    plan = mixing.plan_mix(docs, share=12 / sum(sizes)).toPandas()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk")) < 120
    taken = plan[plan.shards.map(len) > 0]
    left = 12 - taken["size"].sum()
    assert abs(left) <= 1 and plan.shards.map(len).max() == 1


def test_an_unlabelled_corpus_is_kept(spark):
    rows = [(1, "some words", None, "s"), (2, "42", None, "s"), (3, None, None, "s"), (4, "more words", None, "s")]
    assert {r["doc_id"] for r in language_id.known_language(table(spark, rows)).collect()} == {1, 4}
