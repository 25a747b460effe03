"""Ceilings over all rows, a union that lacks no source, sums over equal binned rows, blocks of the signal test."""
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetsieve.functions.digests import md5_words
from fleetsieve.operators import grown as R
from fleetsieve.operators import signal as G
from fleetsieve.session import CLEAN, written
from fleetsieve.sources import matrices as X
from fleetsieve.sources import registry as S
from fleetsieve.workload import sources as W


def test_ceilings_are_given_every_row_of_a_strong_dataset(make_fleet):
    fleet = make_fleet({"strong": ("classification", [([float(i % 2), float(i * 7919 % 1009)], [], "ab"[i % 2], None, None) for i in range(6000)]),
                        "noise": ("classification", [([float(i * 7919 % 1009)], [], "ab"[i * 104729 % 1009 % 2], None, None) for i in range(200)])})
    given = {}

    def ceilings(rows):
        given.update({r["dataset_id"]: r["count"] for r in rows.groupBy("dataset_id").count().collect()})
        return rows.sparkSession.createDataFrame([("strong", 1.0)], "dataset_id string, ceiling_score double")

    found = {r["dataset_id"]: r["reason"] for r in G.signal_test(fleet, ceilings, 20).collect()}
    assert given == {"strong": 6000} and found["strong"].startswith("trivial")


def test_a_union_that_lacks_a_source_is_no_result(spark, make_fleet, tmp_path):
    fleet = make_fleet({"a": ("classification", [([1.0], [], "x", None, None)] * 3)})
    good, bad = S.Source(None, lambda s, root: fleet), S.Source(None, lambda s, root: s.read.parquet(f"{root}/missing"))
    assert W.every_source(S.fetch(spark, str(tmp_path), registry={"good": good})).samples.count() == 3
    with pytest.raises(RuntimeError, match="bad: "):
        W.every_source(S.fetch(spark, str(tmp_path), registry={"good": good, "bad": bad}))


@pytest.mark.parametrize("clf", [True, False])
def test_equal_binned_rows_are_added_up_before_they_meet_the_trees(clf, monkeypatch):
    rng = np.random.default_rng(6)
    full = rng.integers(0, 4, (3000, 3)).astype(np.uint8)
    xb, kind = R._kinds(full)
    assert len(xb) == 64 and np.array_equal(xb[kind], full)
    assert len(R._kinds(rng.integers(0, 32, (300, 4)).astype(np.uint8))[1]) == 0 and len(R._kinds(full.repeat(5, axis=1))[1]) == 0
    y = rng.integers(0, 3, 3000).astype(float) if clf else rng.normal(size=3000)
    block = dict(dataset_id="d", fit=0, part=0, trees=3, clf=clf, p=3, k=3, m=2 if clf else 3, block=1, target=y, fold=rng.integers(-1, 3, 3000))
    model = dict(feat=[1, -1, -1, -1, -1], bin=[1, 0, 0, 0, 0], left=[3, -1, -1, -1, -1], open_from=1)
    entries, leaf = [], R._leaf
    monkeypatch.setattr(R, "_leaf", lambda columns, *rest: entries.append(columns.shape[1]) or leaf(columns, *rest))
    sums = [R._level_sums(next(pd.DataFrame([block | model | {"xb": x.tobytes(), "kind": k.tobytes()}]).itertuples(index=False)))
            for x, k in ((full, np.empty(0, np.int32)), (xb, kind))]
    assert np.array_equal(sums[0][0], sums[1][0]) and np.allclose(sums[0][1], sums[1][1], rtol=1e-12, atol=1e-12)
    assert max(entries[3:]) <= 64 * 3 < 800 < min(entries[:3])


def test_votes_of_a_small_forest_are_not_exchanged(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [("cls", True, i, i % 3, [float(v) for v in rng.normal(size=3)], float(i % 2)) for i in range(200)] + [
        ("reg", False, i, i % 3, [float(v) for v in rng.normal(size=3)], float(i)) for i in range(200)]
    blocks = R.blocks(spark.createDataFrame(rows, "dataset_id string, clf boolean, row_id long, fold int, x array<double>, target double"))
    model = R.grow(blocks, range(3), 23, 3)
    plain = lambda df: {(r.dataset_id, r.fit, r.row_id): (r.target, r.votes) for r in df.collect()}
    one = R.predict(blocks, model, 23)
    assert "FlatMapGroupsInPandas" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(R, "MOST_NODES", 1)
    many, one = plain(R.predict(blocks, model, 23)), plain(one)
    assert one.keys() == many.keys() and len(one) == 400
    assert all(np.isclose(one[k][0], many[k][0]) and np.allclose(one[k][1], many[k][1]) for k in one)


def test_digests_of_many_texts_are_those_of_hashlib():
    heads = [b"", b"7", b"24", b"x" * 40]
    for tails in ([f"|{7 ** i}".encode() for i in range(20)] + [b"", b"|nan"], [b"y" * 20, b"z"], []):
        words = md5_words(heads, tails)
        assert words.shape == (4, len(tails), 4)
        assert all(tuple(words[g, i]) == tuple(np.frombuffer(hashlib.md5(h + t).digest(), ">u4")) for g, h in enumerate(heads) for i, t in enumerate(tails))


def test_shuffles_follow_the_digests_and_keep_the_order_of_equal_ids():
    ids = [3, 9, 3, 10 ** 17, -4, 0, 9]
    for p, order in G._orders(ids, 9):
        if p:
            key = [hashlib.md5(f"{(p - 1) // 4}|{r}".encode()).digest()[(p - 1) % 4 * 4:][:4] for r in ids]
            rows = sorted(range(7), key=lambda i: (key[i], i))
            assert [rows.index(i) for i in range(7)] == list(order)
    assert p == 9


def test_value_sums_of_a_shuffle_are_those_of_its_rows():
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"dataset_id": "d", "clf": False, "classes": None, "fold": rng.integers(0, 3, 50), "x": list(rng.normal(size=(50, 2))),
                        "row_id": rng.permutation(50), "scaled": rng.normal(size=50)})
    found = G._block_sums(5, 3)(pdf)
    block, x, fold = G._block(pdf)
    y = block["scaled"].to_numpy()
    assert list(block["row_id"]) == sorted(pdf["row_id"], key=lambda r: hashlib.md5(b"base|%d" % r).hexdigest())
    for (p, order), sums in zip(G._orders(block["row_id"], 5), found["sums"]):
        rows = [[x[own].sum(0), (x[own] ** 2).sum(0), y[order][own] @ x[own], [y[order][own].sum(), (y[order][own] ** 2).sum(), own.sum()]]
                for own in (fold[order] == f for f in range(3))]
        assert np.allclose(sums, np.concatenate([v for r in rows for v in r]))


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.endswith(".data")}


def test_shuffle_files_of_a_large_table_go_once_it_is_written(spark):
    before = _shuffle_files(spark)
    moved = spark.range(50000).repartition(4, F.col("id") % 7)
    table = written(moved, "moved", release=True)
    assert not _shuffle_files(spark) - before and table.count() == 50000
    assert spark.conf.get(CLEAN) == "false" and moved.count() == moved.count() == 50000


def test_the_signal_test_leaves_no_shuffle_files_of_its_passes(spark, make_fleet):
    rows = [([float(i % 3), float(i * 7919 % 1009)], [], "ab"[i % 2], None, None) for i in range(9000)]
    prepared = G.prepare_signal(make_fleet({"a": ("classification", rows)}))
    before = _shuffle_files(spark)
    assert G.permutation_scores(prepared, 4).count() == 5
    # what is left is from small tables: no pass over all rows
    assert len(_shuffle_files(spark) - before) <= 12


def test_long_lines_are_read_in_pieces(spark):
    lines = spark.createDataFrame([("f", "a\tbé\t\td\t"), ("g", "alone"), ("h", "x\ty\tz")], "file string, line string")
    found = {}
    for r in X.line_pieces(lines, "\t", 2).orderBy("file", "start").collect():
        found.setdefault((r["file"], r["first"]), []).append((r["start"], r["part"]))
    assert found == {("f", "a"): [(0, "a\tbé"), (2, "\td"), (4, "")], ("g", "alone"): [(0, "alone")], ("h", "x"): [(0, "x\ty"), (2, "z")]}


def test_feature_major_is_the_same_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "m.tsv").write_text("id\tdescription\t\"s1\"\ts2\ts3\n\ng1\ttext\t1\tx\t3\n\"g2\"\ttext\t4\t5\n")
    rows = lambda: sorted((r["feature"], r["sample"], r["value"]) for r in X.feature_major(X.text_lines(spark, str(tmp_path))).fillna(-1.0).collect())
    whole = rows()
    assert whole == [("g1", "s1", 1.0), ("g1", "s2", -1.0), ("g1", "s3", 3.0), ("g2", "s1", 4.0), ("g2", "s2", 5.0)]
    pieces = X.line_pieces
    monkeypatch.setattr(X, "line_pieces", lambda lines, sep: pieces(lines, sep, 2))
    assert rows() == whole
