"""The corpus operators on small fixtures: brute force, round trips, nulls, ties, repeats, empty tables."""
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetsieve.llm import (components, exact_dedup, html_extract, language_id, licenses, mixing, piece_codec,
                            simhash, token_counts, url_filter, vector_search)
from fleetsieve.llm.common import tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, size string, fp string, _n double"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "One two\n three"), (6, "One  two three"), (None, "lost"),
       (7, "The MIT-license, or the general public license. MIT license!"), (8, "é 漢字 <|endoftext|> ▁x  y"), (9, "word " * 70_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, ["b", "a", None][(i or 0) % 3], "s", "f", 0.5) for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_odd_rows_and_empty_tables(docs, empty):
    n = len(ODD)
    for work in (mixing.plan_mix, language_id.identify, simhash.near_duplicates, token_counts.token_counts,
                 licenses.scan_licenses, exact_dedup.exact_dedup, piece_codec.encode_documents):
        assert work(docs).count() == n, work
        assert work(empty).count() == 0, work
    for work in (mixing.mixture, language_id.known_language, simhash.drop_near_copies, exact_dedup.drop_copies):
        assert work(docs).columns == docs.columns
        assert work(empty).count() == 0


def test_water_level(spark):
    sizes = spark.createDataFrame([(s, n) for s, n in zip("abcdef", (10, 400, 30, 500, 20, 0))] + [(None, 40)], "source string, size bigint")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    size, weight = dict(zip([*"abcdef", None], (10, 400, 30, 500, 20, 0, 40))), dict(zip([*"abcdef", None], (5, 2, 1, 5, 2, 1, 5)))
    target, full, rest = {}, set(), 1500.0
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in size if x not in full) for s in size if s not in full}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        rest = 1500.0 - sum(2 * size[s] for s in full)
    target = {s: 2.0 * size[s] if s in full else share[s] for s in size}
    assert all(abs(found[s] - target[s]) < 1e-6 for s in size)


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"a": 1000, "b": 37, None: 3}
    rows = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, q bigint"), 7, 5).collect()
    by = {s: sum(r["q"] for r in rows if r["source"] == s) for s in quotas}
    shards = [sum(r["q"] for r in rows if r["shard"] == k) for k in range(7)]
    assert by == quotas and max(shards) - min(shards) <= 1
    a = [r["q"] for r in rows if r["source"] == "a"]
    assert len(a) == 7 and max(a) - min(a) < 40


def test_hypergeometric_mean(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(30), F.lit(50), F.lit(100), (F.col("id") + 0.5) / 4000).alias("h"))
    mean, var = draws.agg(F.avg("h"), F.variance("h")).first()
    assert abs(mean - 15) < 0.05 and abs(var - 50 * .3 * .7 * 50 / 99) < 0.15


def test_mix_meets_targets(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randint(1, 60), "abc"[i % 3] if i % 7 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first, again = (mixing.plan_mix(docs.repartition(k), block_words=500).toPandas() for k in (2, 5))
    taken = first.assign(taken=first["size"] * first.shards.map(len))
    assert (taken.taken <= 2 * taken["size"]).all()
    for _, g in taken.fillna("null").groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 0.01 * g.target.iloc[0] + 2
    key = lambda p: {i: sorted(s) for i, s in zip(p.doc_id, p.shards)}
    assert key(first) == key(again)
    assert mixing.mixture(docs, block_words=500).count() == first.shards.map(len).sum()


def test_language_of_held_out_texts(spark):
    rnd = random.Random(2)
    words = {"en": "the of and to house".split(), "de": "der die und nicht haus".split()}
    rows = [(i, " ".join(rnd.choices(words[k], k=30)), k) for i, k in ((i, ("en", "de")[i % 2]) for i in range(300))] + [(900, "12 34", "en"), (901, None, "de")]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).toPandas().set_index("doc_id")
    assert all(out.lang_pred[i] == k for i, _, k in rows[:300]) and list(out.lang_pred[[900, 901]]) == ["und", "und"]
    assert out.score.between(0, 1).all() and list(out.score[[900, 901]]) == [0.0, 0.0]


def _brute_components(fps):
    fps, roots = sorted(set(fps)), {}
    for x in fps:
        roots[x] = x
    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                roots[find(x)] = find(y)
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("pairwise", [1, 256])
def test_links_have_the_components_of_all_pairs(spark, pairwise):
    rnd = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    found = {r["node"]: r["root"] for r in components.components(simhash.links(spark.createDataFrame(signed, "fp bigint"), pairwise)).collect()}
    expected = _brute_components(fps)
    back = {int(np.uint64(x).astype(np.int64)): x for x in fps}
    groups = {}
    for s, x in back.items():
        groups.setdefault(found.get(s, s), set()).add(expected[x])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_fingerprint_by_definition():
    import xxhash
    text = "The cat  sat\ton THE mat the cat sat".encode()
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_fingerprint_across_blocks(monkeypatch):
    text = " ".join(random.Random(4).choices("abcdefg", k=500)).encode()
    whole = simhash.fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert simhash.fingerprint(text) == whole


TEXT = st.text(alphabet="ab \n\té漢'1!▁<|endoftext|>\u3000\x1c😀", max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_token_counts_are_the_library_s(text):
    encoder = token_counts.Encoder("byte_bpe_50k.json")
    n = len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(text, encoder) == token_counts.count_tokens(text, encoder, chunk=8, overlap=2) == n


def test_counts_while_the_memo_overflows(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 20)
    encoder = token_counts.Encoder("byte_bpe_50k.json")
    texts = ["a few words " + "x" * 100, " ".join(map(str, range(500))), "more words at the end", "y" * 90 + " a few"] * 2
    assert token_counts.count_all(texts, encoder, chunk=200, overlap=20) == [
        len(encoder.tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_are_the_library_s(text):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    codec, ids = piece_codec._codec("piece_bpe_32k.model"), model.encode(text, add_bos=True, add_eos=True)
    assert codec.encode(text) == ids and codec.decode(ids) == model.decode(ids)
    assert codec.digest(text)[1:] == (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_round_trip_of_documents(docs):
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(piece_codec.encode_documents(docs, with_ids=True)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in ODD)


def test_licenses(docs):
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    r = out[7]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (10, 3, 1, 8, "gpl,mit", 1.0)
    assert (out[1]["n_words"], out[1]["first_word"], out[1]["labels"], out[1]["score"]) == (0, None, "", 0.0)
    assert len(licenses.rules()) > 200


def test_contained_detections_are_suppressed(spark):
    docs = spark.createDataFrame([(1, "Licensed under the BSD 3-Clause License, version 2. Zlib license")], "doc_id bigint, text string")
    found = licenses.scan_licenses(docs).first()["detections"]
    assert [(x["start"], x["end"], x["label"]) for x in found] == [(0, 9, "bsd-3-clause"), (9, 11, "zlib")]


def test_exact_dedup(docs):
    out = exact_dedup.exact_dedup(docs).collect()
    by = {}
    for i, t in ODD:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert sum(r["kept"] for r in out) == len(by) == exact_dedup.drop_copies(docs).count()
    ids = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in by.items()}
    for r in out:
        own = ids[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == min((x for x in own if x is not None), default=None)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    rows = [(i, base[i % 40].tolist()) for i in range(300)] + [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (600, []), (700, [2.0])]
    out = vector_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0, k=10, block=2).collect()
    whole = {i: np.floor(1024 * np.array(v + [0.0] * (6 - len(v)))).astype(int) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:10]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == best


def test_url_rules(spark):
    urls = [None, "", "example.com/en/", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "ftp://x.net/es/1", "x://net/fr", "s://com", "s://com/", "s://notcom/", "q?u=http://e.net/fr/"]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    assert [out[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/", None, "net/fr/"]
    assert (out[3]["host"], out[3]["path"], out[3]["verdict"], out[4]["verdict"]) == ("a.example.com", "/en/x", "block", "allow")


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.cascade(universe, universe.filter("key like '%7'"), error=0.3)
    hashes = universe.select("key", F.xxhash64("key").alias("h")).toPandas()
    assert len(levels) > 2 and (url_filter.listed(levels, hashes.h.to_numpy().view(np.uint64)) == hashes.key.str.endswith("7")).all()


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<br>b\n c", "a b c"),
    ("<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>Short.<p>x &lt; y</article><footer>c</footer>", "T\n\nShort.\n\nx < y"),
    ("<main><p>in</p><section class='comments'><p>the reply of the reader and more</p></section><form>f</form></main>", "in"),
    ("<script>var a='</p>'</script><style>b</style><!-- c --><div class=ad>buy</div><p title='a>b'>ok</p>", "ok")])
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_extract_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p>" + "very long " * 50_000)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in out) == [(1, 0), (2, 0), (2, 0), (3, 499_999)]


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choices("the of and to house is on it was very".split(), k=80))
    rows = [(i, text(), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, r[1].replace(" ", "  "), "en", "s", 1) for i, r in enumerate(rows[:5])] + [(200, "42", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.known_languages(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {200}
    assert {r["doc_id"] for r in corpus_pipeline.without_copies(spark, docs, "").collect()} == {*range(60), 200}
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    texts = {r[0]: r[1] for r in rows}
    for r in piece_codec.decode_documents(done).collect():
        assert " ".join(r["text"].split()) == texts[r["doc_id"]]
    for r in done.collect():
        assert r["n_tokens"] == len(r["ids"]) and hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
